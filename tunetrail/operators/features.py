"""Model inputs: scaling, dummies, encodings, weights, vectors."""

from itertools import groupby

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Window, functions as F

from tunetrail.functions.genres import column_name, genre_flags
from tunetrail.operators.stats import top_genres
from tunetrail.schema import SCALED_AUDIO, TIME_OF_DAY
from tunetrail.session import checkpoint


def zscore_fit(df, cols=SCALED_AUDIO, times=None):
    """One row holding mean and population deviation of each column; `times` says how many plays a row stands for."""
    if times is not None:
        return _counted_zscores(df, cols, F.col(times))
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def _counted_zscores(df, cols, times):
    """The same over counted rows: sums of distances to the mean, so that large values lose no digits."""
    of = lambda c: F.when(F.col(c).isNotNull(), times)
    ends = df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"),
                                              (F.sum(F.col(c) * times) / F.sum(of(c))).alias(f"{c}_near"))])
    packed = ends.select(F.struct(*ends.columns).alias("s")).scalar()
    far = {c: F.col(c) - F.col(f"_e.{c}_near") for c in cols}
    sums = df.withColumn("_e", packed).agg(F.first("_e").alias("_e"), *[x for c in cols for x in (
        (F.sum(far[c] * times) / F.sum(of(c))).alias(f"{c}_off"), (F.sum(far[c] * far[c] * times) / F.sum(of(c))).alias(f"{c}_var"))])
    same = lambda c: F.col(f"_e.{c}_low") == F.col(f"_e.{c}_high")
    return sums.select(
        *[F.when(same(c), F.col(f"_e.{c}_low").cast("double")).otherwise(F.col(f"_e.{c}_near") + F.col(f"{c}_off")).alias(f"{c}_mean") for c in cols],
        *[F.when(same(c), 0.0).otherwise(F.sqrt(F.col(f"{c}_var") - F.col(f"{c}_off") * F.col(f"{c}_off"))).alias(f"{c}_std") for c in cols])


def zscore_apply(df, stats, cols=SCALED_AUDIO):
    """Centre and scale with fitted statistics; a constant column becomes 0."""
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    scaled = {c: F.when(F.col(f"_s.{c}_std") == 0, F.col(c) * 0.0)
              .otherwise((F.col(c) - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_std")) for c in cols}
    return df.withColumn("_s", packed).withColumns(scaled).drop("_s")


def tod_dummies(df, col="time_of_day"):
    """0/1 columns for the parts of the day, without the first in alphabetical order."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in sorted(TIME_OF_DAY)[1:]})


def genre_onehot(df, n=20, tags="genres_list", fit_on=None, times=None):
    """Flags of the n most frequent genres of plays, or of counted rows with `times` plays each. Collects the n names."""
    names = [r.genre for r in top_genres(df if fit_on is None else fit_on, n, tags, times).collect()]
    return genre_flags(df, names, tags), [column_name(g) for g in names]


def label_encode(df, col, out=None):
    """Alphabetical code of a categorical column, from 0.

    Ranks the distinct values, not the rows: ranges of values are numbered each by itself, after
    the number of values in the ranges before.
    """
    values = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col) \
        .withColumn("_range", F.spark_partition_id())
    values = checkpoint(values)
    sizes = values.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range reaches this window.
    before = sizes.select("_range", (F.sum("_n").over(Window.partitionBy().orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(col)) - 1
    codes = values.withColumn("_place", place).join(before, "_range").select(
        col, (F.col("_before") + F.col("_place")).cast("int").alias("_code"))
    return df.join(codes, col, "left").withColumn(out or f"{col}_encoded", F.col("_code")).drop("_code")


def class_weights(df, label="skipped", mode="balanced", times=None):
    """(label, weight): n / (2·n_c) for `balanced`; neg / pos on the positive class for `positive`.

    `times` names a column that says how many rows a row stands for.
    """
    rows = F.count(F.lit(1)) if times is None else F.sum(times)
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(rows.alias("n"))
    every = Window.partitionBy()
    if mode == "balanced":
        weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    else:
        of = lambda v: F.sum(F.when(F.col(label) == v, F.col("n"))).over(every)
        weight = F.when(F.col(label) == 1, of(0) / of(1)).otherwise(1.0)
    return n.select(label, weight.cast("double").alias("weight"))


def with_class_weight(df, label="skipped", mode="balanced", out="weight", times=None, keep=False):
    """Add the weight of each row's class, that of all rows it stands for with `times`. The joined table has one row per class.

    With `keep` a job works that table out and stores it, else every use of the rows counts the classes again.
    """
    weights = class_weights(df, label, mode, times).withColumnRenamed("weight", out)
    weighted = df.join(F.broadcast(checkpoint(weights) if keep else weights), label, "left")
    return weighted if times is None else weighted.withColumn(out, F.col(out) * F.col(times))


def count_equal(df, columns, out="plays"):
    """One row per value of the columns, with the number of rows that share it."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def class_ratio(df, label="skipped"):
    """Negatives per positive."""
    return df.agg(F.try_divide(F.sum(1 - F.col(label)), F.sum(label)).alias("ratio"))


def assemble(df, columns, output="features"):
    """One vector column out of numeric and vector columns, which hold no NULL.

    Neighbouring numeric columns are packed in an array first. Its transform, which ends the job on NULL and
    NaN as the assembler does, keeps Spark from making one method of all their expressions: beyond 8000 bytes of code
    the JVM does not compile a method (25 microseconds a row for 33 columns).
    """
    parts = []
    for is_vector, group in groupby(columns, lambda c: isinstance(df.schema[c].dataType, VectorUDT)):
        names = list(group)
        if not is_vector:
            packed = f"_{output}_{len(parts)}"
            numbers = array_to_vector(F.transform(F.array(*[F.col(c).cast("double") for c in names]), _known))
            df = VectorSizeHint(inputCol=packed, size=len(names), handleInvalid="optimistic").transform(df.withColumn(packed, numbers))
            names = [packed]
        parts += names
    return VectorAssembler(inputCols=parts, outputCol=output).transform(df).drop(*[p for p in parts if p not in columns])


def _known(number):
    return F.when(number.isNull() | F.isnan(number), F.raise_error(F.lit("a feature holds NULL or NaN"))).otherwise(number)
