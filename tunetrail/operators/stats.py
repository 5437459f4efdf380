"""Aggregations behind the reports.

Each reads plays once and shuffles only partial aggregates. Top-N lists come from
`orderBy().limit()`, which keeps N rows per task, never from a window over all groups.
"""

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Window, functions as F

from tunetrail.functions.time import clock_label, context_label, day_label
from tunetrail.functions.values import to_number
from tunetrail.operators.heavy import BUCKETS, heavy_rows
from tunetrail.schema import CORRELATED, TIME_OF_DAY


def row_count():
    return F.count(F.lit(1))


def _plays(times):
    """Plays behind rows that stand for `times` plays each, or for one."""
    return row_count() if times is None else F.sum(times)


def class_distribution(plays, label="skipped"):
    """Count, share in percent and listen : skip ratio, one row per class."""
    counts = plays.where(F.col(label).isNotNull()).groupBy(label).agg(row_count().alias("plays"))
    every = Window.partitionBy()
    of = lambda v: F.sum(F.when(F.col(label) == v, F.col("plays"))).over(every)
    return counts.select(
        label, "plays",
        F.round(F.col("plays") * 100.0 / F.sum("plays").over(every), 4).alias("percent"),
        F.round(of(0) / of(1), 4).alias("listen_skip_ratio"))


def tod_skip_rate(plays):
    """Skip rate per time of day against the overall rate, all four parts in fixed order."""
    spark = plays.sparkSession
    parts = spark.createDataFrame(list(enumerate(TIME_OF_DAY)), "position int, time_of_day string")
    counts = plays.groupBy("time_of_day").agg(F.sum("skipped").alias("skips"), F.count("skipped").alias("plays"))
    # At most five rows reach this window.
    every = Window.partitionBy()
    rates = counts.withColumns({"rate": F.try_divide("skips", "plays") * 100,
                                "overall": F.try_divide(F.sum("skips").over(every), F.sum("plays").over(every)) * 100})
    diff = F.col("rate") - F.col("overall")
    return (parts.join(rates, "time_of_day", "left")
            .select("position", "time_of_day",
                    F.round("rate", 4).alias("skip_rate"),
                    F.coalesce("plays", F.lit(0)).alias("plays"),
                    F.round(F.abs(diff), 4).alias("difference"),
                    F.when(diff > 0, "up").when(diff <= 0, "down").alias("direction"))
            .orderBy("position"))


def report_counts(plays):
    """Plays counted by (weekday, hour, class) and by (track, artist, genre text, class): two grouping sets, one shuffle.

    Column `plays` is the count, `by_time` tells the set. Reports that take `times` read these
    rows in place of plays. Plays are combined on the map side.
    """
    time, track = ["day_of_week", "hour"], ["track_name", "artist", "genres"]
    return plays.groupingSets([[*time, "skipped"], [*track, "skipped"]], *time, *track, "skipped").agg(
        row_count().alias("plays"), (F.grouping("hour") == 0).alias("by_time"))


def _skips_and_plays(times):
    """Sums of skips and of plays with a class, over rows that stand for `times` plays each, or for one."""
    if times is None:
        return F.sum("skipped").alias("total_skips"), F.count("skipped").alias("total_plays")
    known = F.when(F.col("skipped").isNotNull(), F.col(times)).otherwise(0)
    return F.sum(F.col("skipped") * F.col(times)).alias("total_skips"), F.sum(known).alias("total_plays")


def skip_heatmap(plays, times=None):
    """Skips and plays per weekday and hour, at most 168 rows."""
    return (plays.where(F.col("day_of_week").isNotNull() & F.col("hour").isNotNull())
            .groupBy("day_of_week", "hour")
            .agg(*_skips_and_plays(times))
            .withColumn("skip_rate", F.round(F.try_divide("total_skips", "total_plays"), 4))
            .withColumn("day_label", day_label(F.col("day_of_week"))))


def hourly_skip(plays, times=None):
    """Plays, skips and skip rate in percent per hour, with clock and context labels."""
    return (plays.where(F.col("hour").isNotNull()).groupBy("hour")
            .agg(*reversed(_skips_and_plays(times)))
            .withColumn("skip_rate", F.round(F.try_divide("total_skips", "total_plays") * 100, 2))
            .withColumn("time_label", clock_label(F.col("hour")))
            .withColumn("context", context_label(F.col("hour"))))


def hour_extremes(hourly):
    """The hour with the highest and the one with the lowest rate, earliest on ties."""
    row = F.struct(*hourly.columns)
    best = hourly.where(F.col("skip_rate").isNotNull()).agg(
        F.max_by(row, F.struct("skip_rate", -F.col("hour"))).alias("most"),
        F.min_by(row, F.struct("skip_rate", "hour")).alias("least"))
    return (best.select(F.explode(F.array(
        F.struct(F.lit("most impatient").alias("kind"), F.col("most").alias("r")),
        F.struct(F.lit("most chill").alias("kind"), F.col("least").alias("r")))).alias("x"))
        .select("x.kind", "x.r.*"))


def kpi_summary(plays, times=None):
    """Total plays, total skips and skip rate as a long table."""
    skips, _ = _skips_and_plays(times)
    totals = plays.agg(F.coalesce(_plays(times), F.lit(0)).cast("double").alias("Total Songs"),
                       F.coalesce(skips, F.lit(0)).cast("double").alias("Total Skips"))
    totals = totals.withColumn("Skip Rate", F.round(F.try_divide("Total Skips", "Total Songs"), 4))
    return totals.unpivot([], ["Total Songs", "Total Skips", "Skip Rate"], "Metric", "Value")


def track_counts(plays, key="track_id"):
    """Plays per track and class, combined on the map side: what joins and explodes start from."""
    return plays.groupBy(key, "skipped").agg(row_count().alias("plays"))


def exploded_genres(counts, tags="genres_list"):
    """One row per counted row and genre; rows without a genre are left out."""
    return counts.withColumn("genre", F.explode_outer(tags)).where(F.col("genre").isNotNull())


def genre_share(counts, n=10, tags="genres_list", times=None):
    """Top-n genre tags of listened and of skipped plays, with their share of that class' tags.

    Rows are plays, or counted rows (see `track_counts`) with `times` plays each.
    """
    per_class = exploded_genres(counts, tags).groupBy("skipped", "genre").agg(_plays(times).alias("plays"))
    totals = per_class.groupBy("skipped").agg(F.sum("plays").alias("total"))
    order = Window.partitionBy("skipped").orderBy(F.desc("plays"), "genre")
    return (per_class.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
            .join(totals, "skipped")
            .select("skipped", "position", "genre", "plays",
                    F.round(F.col("plays") / F.col("total") * 100, 1).alias("percent")))


def value_counts(df, col, n=None, times=None):
    """Frequency of each value, most frequent first; `times` names a column of repeats."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(_plays(times).alias("n")).orderBy(F.desc("n"), col)
    return counts if n is None else counts.limit(n)


def frequent_values(df, col, n, times=None, buckets=BUCKETS):
    """`value_counts` of the n most frequent values, for columns of very many values. Runs jobs, see `heavy_rows`."""
    weight = F.lit(1) if times is None else F.col(times)
    return value_counts(heavy_rows(df, col, [weight], n, buckets), col, n, times)


def top_genres(counts, n=20, tags="genres_list", times=None):
    """The n most frequent genre tags of plays, or of counted rows with `times` plays each."""
    return value_counts(exploded_genres(counts, tags), "genre", n, times)


def category_report(plays, col, default="Other"):
    """Frequency of a derived category with the number of categories and of default rows."""
    counts = plays.groupBy(col).agg(row_count().alias("plays"))
    totals = counts.agg(F.count(col).alias("categories"),
                        F.coalesce(F.sum(F.when(F.col(col) == default, F.col("plays"))), F.lit(0)).alias("default_plays"))
    packed = totals.select(F.struct("categories", "default_plays")).scalar()
    return counts.withColumn("_totals", packed).select(col, "plays", "_totals.categories", "_totals.default_plays")


def wide_stats(plays, keys, top_n=10, times=None):
    """Skipped and completed counts of the union of top-n skipped and top-n completed keys.

    `times` names a column that says how many plays a row stands for.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = F.lit(1).cast("bigint") if times is None else F.col(times)
    stats = plays.dropna(subset=keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("skipped") == 1, n)), F.lit(0)).alias("Skipped_Count"),
        F.coalesce(F.sum(F.when(F.col("skipped") == 0, n)), F.lit(0)).alias("Completed_Count"))
    top = lambda c: stats.where(F.col(c) > 0).orderBy(F.desc(c), *keys).limit(top_n)
    return (top("Skipped_Count").union(top("Completed_Count")).distinct()
            .orderBy(F.desc("Completed_Count"), F.desc("Skipped_Count"), *keys))


def wide_stats_of_many(plays, keys, top_n=10, times=None, buckets=BUCKETS):
    """`wide_stats` for very many keys: only keys that can be in a list are grouped. Runs jobs, see `heavy_rows`."""
    n = F.lit(1) if times is None else F.col(times)
    weights = [F.when(F.col("skipped") == v, n) for v in (1, 0)]
    return wide_stats(heavy_rows(plays, keys, weights, top_n, buckets), keys, top_n, times)


def play_counts(plays, keys=("track_name", "artist")):
    return plays.dropna(subset=list(keys)).groupBy(*keys).agg(row_count().alias("play_count"))


def count_quantile(counts, q, col="play_count"):
    """One-row table with the exact, linearly interpolated quantile of a count column.

    Equal counts are merged first: distinct counts are few (their sum is at most the number
    of plays), so the exact percentile holds a small table whatever the number of groups.
    """
    return (counts.groupBy(col).agg(row_count().alias("_times"))
            .agg(F.percentile(col, F.lit(q), F.col("_times")).alias("quantile")))


def frequent_only(counts, q=0.25, col="play_count"):
    """Groups strictly above the q-quantile of the count."""
    return counts.where(F.col(col) > count_quantile(counts, q, col).scalar())


def _complete_corr(data, cols):
    """Pearson correlations of columns without NULL, by one aggregate of moments about the mean."""
    pairs = list(combinations(cols, 2))
    varies = lambda c: F.when(F.max(c) > F.min(c), 1.0)
    pearson = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    sums = data.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs], *[varies(c).alias(f"{c}|{c}") for c in cols])
    cell = lambda a, b, name: F.struct(F.lit(a).alias("Variable1"), F.lit(b).alias("Variable2"), F.col(name).alias("Correlation"))
    cells = [cell(a, b, f"{a}|{b}") for a, b in pairs] + [cell(b, a, f"{a}|{b}") for a, b in pairs]
    return sums.select(F.inline(F.array(*cells, *[cell(c, c, f"{c}|{c}") for c in cols])))


def corr_long(df, cols=CORRELATED, deletion="pairwise", digits=2):
    """Pearson correlation of every pair of columns, as (Variable1, Variable2, Correlation).

    `pairwise` uses each pair's complete rows, `listwise` only rows complete in all columns, where one
    aggregate of engine moments shares the deviations. Pair-wise, one aggregate finds the means; a second one sums values less their mean, so that a large mean takes
    no digits, and their products, for each pattern of NULLs; pairs add up the patterns that have
    both columns. A constant column correlates with nothing (NULL).
    """
    data = df.select(*[to_number(F.col(c)).alias(c) for c in cols])
    if deletion == "listwise":
        return _complete_corr(data.dropna(), cols).withColumn("Correlation", F.round("Correlation", digits))
    places = range(len(cols))
    pairs = [(i, j) for i in places for j in places if i <= j]
    data = data.toDF(*[f"v{k}" for k in places])
    pivot = data.agg(F.array(*[F.avg(f"v{k}") for k in places]).alias("pivot")).scalar()
    moved = data.withColumn("pivot", pivot).select(*[(F.col(f"v{k}") - F.col("pivot")[k]).alias(f"v{k}") for k in places])
    known = F.concat(*[F.col(f"v{k}").isNotNull().cast("int").cast("string") for k in places])
    sums = moved.groupBy(known.alias("known")).agg(
        row_count().alias("n"), *[F.sum(f"v{k}").alias(f"s{k}") for k in places],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    place = {pair: at for at, pair in enumerate(pairs)}
    packed = sums.select("n", F.array(*[f"s{k}" for k in places]).alias("s"), F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("p"))
    entries = F.array(*[F.struct(*(F.lit(x).alias(n) for n, x in zip("ijabc", (i, j, place[i, j], place[i, i], place[j, j]))))
                        for i, j in pairs])
    both = packed.withColumn("e", F.explode(entries)).select(
        "e.i", "e.j", "n", F.col("p")[F.col("e.a")].alias("xy"), F.col("s")[F.col("e.i")].alias("x"),
        F.col("s")[F.col("e.j")].alias("y"), F.col("p")[F.col("e.b")].alias("xx"), F.col("p")[F.col("e.c")].alias("yy"))
    # A pattern without one of the columns has no product of the two and takes no part.
    total = both.where("xy IS NOT NULL").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(x, xx):
        # What rounding alone leaves of equal values is no variance.
        square = F.col("n") * F.col(xx) - F.col(x) * F.col(x)
        return F.when(square > 1e-12 * F.col("n") * F.col(xx), F.sqrt(square))

    value = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), spread("x", "xx") * spread("y", "yy"))
    found = total.withColumn("r", F.when(F.col("i") == F.col("j"), F.when(value.isNotNull(), 1.0)).otherwise(value))
    # Every pair has its row, also without data.
    every = df.sparkSession.createDataFrame([(i, j, cols[x], cols[y]) for i, j in pairs for x, y in {(i, j), (j, i)}],
                                            "i int, j int, Variable1 string, Variable2 string")
    return every.join(found, ["i", "j"], "left").select("Variable1", "Variable2", F.round("r", digits).alias("Correlation"))


def corr_matrix(df, cols=CORRELATED):
    """List-wise Pearson matrix as a driver-side array (at most len(cols)² numbers)."""
    data = df.select(*[to_number(F.col(c)).alias(c) for c in cols]).dropna()
    vectors = VectorAssembler(inputCols=list(cols), outputCol="features").transform(data)
    return Correlation.corr(vectors, "features").head()[0].toArray()


def session_summary(before, sessions):
    """Rows before and after the session filter, and the number of sessions kept."""
    kept = sessions.agg(row_count().alias("rows_kept"),
                        F.count_distinct("user_id", "session_no").alias("sessions"))
    total = before.agg(row_count().alias("n")).scalar()
    return kept.select(total.alias("rows_before"), "rows_kept", "sessions")
