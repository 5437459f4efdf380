"""Listening sessions and the play windows inside them.

Plays are shuffled once, by (listener, segment). An ordinary listener is one segment. A listener
with more than `hot_rows` plays is cut into segments of about that many plays, wherever these
fall in time, plays of one instant included, so that no task holds a whole heavy history. What crosses a segment edge (previous
time, session number, session size, the last few plays) is carried by a small table with one row
per segment. Both ways give the same sessions.

Plays without a time belong to no session and are left out. Plays without a listener are one
listener's.
"""

from pyspark.sql import Window, functions as F

from tunetrail.functions.time import micros
from tunetrail.session import checkpoint

HOT_ROWS = 5_000_000
# Plays of busy minutes that a task ranks.
RANK_ROWS = 250_000
MINUTE = 60_000_000

SEGMENT = "_segment"
MICROS = "_micros"
BACK = "_back"


def _hot_minutes(timed, by, hot_rows):
    """(_by, _minute, _base, _busy) of heavy listeners: first segment of a minute, and whether it is cut.

    Plays are counted per listener, then per minute for the heavy ones. A minute with more than
    `hot_rows` plays is busy: it has segments of its own, as many as its count calls for.
    """
    size = F.lit(max(1, hot_rows))
    heavy = timed.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    of_heavy = (timed.join(heavy, F.col(by).eqNullSafe(F.col("_by")), "left_semi")
                .withColumn("_minute", F.floor(F.col(MICROS) / MINUTE)))
    minutes = checkpoint(of_heavy.groupBy(F.col(by).alias("_by"), "_minute").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_by").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("_n") > size, F.ceil(F.col("_n") / size)).otherwise(0)
    plays, cuts = F.coalesce(F.sum("_n").over(before), F.lit(0)), F.coalesce(F.sum(cut).over(before), F.lit(0))
    return minutes.select("_by", "_minute", (F.floor(plays / size) + cuts).alias("_base"), (F.col("_n") > size).alias("_busy"), "_n")


def _cut_busy(inside, by, key, hot_rows, rows):
    """Plays of busy minutes with their segment, by their rank in (time, key) within the minute.

    A rank is the rank within a range of (listener, time, key) plus the plays of the ranges before it.
    The ranges follow the number of plays, not that of segments, and are stored, as both parts read
    them. Spark samples their bounds, which decide how evenly the work is spread, not any rank.
    """
    ranges = checkpoint(inside.repartitionByRange(-(-rows // RANK_ROWS), by, MICROS, key)
                        .withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_of", "_at").orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranges.groupBy(F.col(by).alias("_of"), F.col("_minute").alias("_at"), F.col("_part").alias("_at_part"))
               .agg(F.count(F.lit(1)).alias("_n"))
               .select("_of", "_at", "_at_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    rank = F.rank().over(Window.partitionBy(by, "_minute", "_part").orderBy(MICROS, key))
    placed = ranges.withColumn("_rank", rank).join(offsets, F.col(by).eqNullSafe(F.col("_of")) & (F.col("_minute") == F.col("_at"))
                                                   & (F.col("_part") == F.col("_at_part")))
    return placed.withColumn(SEGMENT, F.col("_base") + F.floor((F.col("_offset") + F.col("_rank") - 1) / F.lit(max(1, hot_rows))))


def with_segments(plays, by="user_id", ts="ts", hot_rows=HOT_ROWS, key="play_id"):
    """Timed plays with their segment: -1, or a number that grows with (time, key) for heavy listeners.

    Returns (plays, whether there is a heavy listener). Runs a job that counts plays per listener,
    with heavy ones also their minutes; plays of busy minutes are stored by ranges of (time, key).
    Only plays of one listener that agree in time and key always share a segment.
    """
    timed = plays.withColumn(MICROS, micros(plays, ts)).where(F.col(MICROS).isNotNull())
    if hot_rows is not None:
        hot = checkpoint(_hot_minutes(timed.select(by, MICROS), by, hot_rows))
        minutes, rows = hot.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_busy"), F.col("_n")))).first()
    if hot_rows is None or not minutes:
        return timed.withColumn(SEGMENT, F.lit(-1).cast("bigint")), False
    minute = F.floor(F.col(MICROS) / MINUTE)
    found = timed.join(hot.drop("_n"), F.col(by).eqNullSafe(F.col("_by")) & (minute == F.col("_minute")), "left")
    columns = [*timed.columns, F.coalesce("_base", F.lit(-1)).cast("bigint").alias(SEGMENT)]
    if not rows:
        return found.select(*columns), True
    cut = _cut_busy(found.where("_busy"), by, key, hot_rows, rows)
    rest = found.where(~F.coalesce("_busy", F.lit(False)))
    return rest.select(*columns).unionByName(cut.select(*timed.columns, F.col(SEGMENT).cast("bigint"))), True


def sessionize(plays, gap_minutes=20, min_plays=3, by="user_id", ts="ts", key="play_id", hot_rows=HOT_ROWS, tasks=None):
    """Number the sessions of each listener and keep those with `min_plays` plays.

    A play starts a session when it is the first or follows the previous one by more than
    `gap_minutes`. Adds `diff_minutes`, `session_no` (from 1) and `session_plays`. With a heavy
    listener the segmented plays are stored once, and all that follows reads them. `tasks` sets the
    number of tasks for wide plays, whose size Spark learns only after compression.
    """
    gap = int(gap_minutes * 60_000_000)
    order = Window.partitionBy(by, SEGMENT).orderBy(ts, key)
    segmented, heavy = with_segments(plays, by, ts, hot_rows, key)
    if tasks:
        segmented = segmented.repartition(tasks, by, *([SEGMENT] if heavy else []))
    runs = (segmented
            .withColumn("_wait", F.col(MICROS) - F.lag(MICROS).over(order))
            .withColumn("_run", F.sum((F.coalesce("_wait", F.lit(0)) > gap).cast("int")).over(
                order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_run_plays", F.count(F.lit(1)).over(Window.partitionBy(by, SEGMENT, "_run"))))
    if heavy:
        plays_after = F.count(F.lit(1)).over(Window.partitionBy(by, SEGMENT)) - F.row_number().over(order)
        runs = checkpoint(runs.withColumn(BACK, plays_after.cast("int")))
        rows = _join(runs, _carry(runs, by, gap), by).withColumns({
            "diff_minutes": F.coalesce("_wait", F.col(MICROS) - F.col("_previous")) / 6e7,
            "session_no": F.coalesce("_first_no", F.lit(1)) + F.col("_run"),
            "session_plays": F.when((F.col("_run") == 0), F.coalesce("_first_plays", "_run_plays"))
            .when(F.col("_run") == F.col("_last_run"), F.col("_last_plays"))
            .otherwise(F.col("_run_plays"))})
    else:
        rows = runs.withColumns({
            "diff_minutes": F.col("_wait") / 6e7,
            "session_no": F.col("_run") + 1,
            "session_plays": F.col("_run_plays"),
            BACK: F.lit(None).cast("int")})
    return (rows.where(F.col("session_plays") >= min_plays)
            .select(*plays.columns, "diff_minutes", "session_no", "session_plays", SEGMENT, BACK))


def _join(plays, table, by):
    """Left join of a table with one row per listener and segment; a missing listener matches itself."""
    right = table.withColumnsRenamed({by: "_by", SEGMENT: "_at_segment"})
    return (plays.join(right, F.col(by).eqNullSafe(F.col("_by")) & (F.col(SEGMENT) == F.col("_at_segment")), "left")
            .drop("_by", "_at_segment"))


def _carry(runs, by, gap):
    """Per segment of a heavy listener: what the segments before and after it decide.

    `_previous` is the time of the last play before the segment, `_first_no` the number of the
    session its first run belongs to, `_first_plays` / `_last_plays` the full sizes of the
    sessions that its first and last run belong to.
    """
    segments = runs.where(F.col(SEGMENT) != -1).groupBy(by, SEGMENT).agg(
        F.min(MICROS).alias("_from"), F.max(MICROS).alias("_to"), F.max("_run").alias("_last_run"),
        F.max(F.when(F.col("_run") == 0, F.col("_run_plays"))).alias("_head"),
        F.max_by("_run_plays", "_run").alias("_tail"))
    order = Window.partitionBy(by).orderBy(SEGMENT)
    starts = (segments.withColumn("_previous", F.lag("_to").over(order))
              .withColumn("_new", F.coalesce((F.col("_from") - F.col("_previous") > gap), F.lit(True)).cast("int"))
              .withColumn("_first_no", F.sum(F.col("_new") + F.col("_last_run")).over(
                  order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_last_run"))
              .withColumn("_last_no", F.col("_first_no") + F.col("_last_run")))
    edges = starts.select(by, SEGMENT, F.inline(F.filter(F.array(
        F.struct(F.lit(True).alias("_at_start"), F.col("_first_no").alias("_no"), F.col("_head").alias("_plays")),
        F.struct(F.lit(False).alias("_at_start"), F.col("_last_no").alias("_no"), F.col("_tail").alias("_plays"))),
        lambda e: e["_at_start"] | (F.col("_last_run") > 0))))
    sizes = edges.withColumn("_size", F.sum("_plays").over(Window.partitionBy(by, "_no")))
    totals = sizes.groupBy(by, SEGMENT).agg(
        F.max(F.when(F.col("_at_start"), F.col("_size"))).alias("_first_plays"),
        F.max(F.when(~F.col("_at_start"), F.col("_size"))).alias("_last_plays"))
    return _join(starts.select(by, SEGMENT, "_previous", "_first_no", "_last_run"), totals, by)


def sequence_windows(sessions, features, target="skipped", n_steps=5, by="user_id", ts="ts", key="play_id"):
    """For each play with `n_steps` earlier plays in its session: those plays, and its target.

    `seq` is array<struct<features>> in time order. Input is the output of `sessionize`; the
    shuffle made there is reused.
    """
    order = Window.partitionBy(by, SEGMENT).orderBy(ts, key)
    step = F.struct("session_no", *features)
    rows = sessions.withColumn("_steps", F.collect_list(step).over(order.rowsBetween(-n_steps, -1)))

    # Each segment of a heavy listener receives the last plays of the segments before it.
    last = F.when(F.col(BACK) < n_steps, F.struct((-F.col(BACK)).alias("_at"), step.alias("_step")))
    tails = (sessions.where(F.col(SEGMENT) != -1).groupBy(by, SEGMENT)
             .agg(F.sort_array(F.collect_list(last)).alias("_tail")))
    earlier = Window.partitionBy(by).orderBy(SEGMENT).rowsBetween(-n_steps, -1)
    halo = tails.select(by, SEGMENT, F.flatten(F.collect_list("_tail").over(earlier)).alias("_halo"))
    halo = halo.select(by, SEGMENT, F.transform("_halo", lambda s: s["_step"]).alias("_halo"))

    joined = _join(rows, halo, by)
    history = F.when(F.col("_halo").isNull() | (F.size("_steps") == n_steps), F.col("_steps")) \
        .otherwise(F.concat("_halo", "_steps"))
    recent = F.slice("_history", F.greatest(F.size("_history") - n_steps + 1, F.lit(1)), n_steps)
    same = F.filter(recent, lambda s: s["session_no"] == F.col("session_no"))
    return (joined.withColumn("_history", history)
            .withColumn("seq", F.transform(same, lambda s: F.struct(*[s[f].alias(f) for f in features])))
            .where(F.size("seq") == n_steps)
            .select(key, by, ts, "session_no", "seq", F.col(target).alias("target")))
