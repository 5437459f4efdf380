"""Duplicates."""

from pyspark.sql import Window, functions as F

#: Copies of a row that one task writes out.
PORTION = 100_000


def first_per_key(df, keys, order_by):
    """First row per key in the given order; rows with a NULL key are dropped.

    Spark cuts each map task to one row per key before the shuffle, so a key with many
    copies sends at most one row per task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return (df.dropna(subset=keys)
            .withColumn("_rank", F.row_number().over(order))
            .where("_rank = 1").drop("_rank"))


def duplicate_count(df, keys):
    """Rows that repeat an earlier key; NULL counts as one key value."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
            .select("rows", "keys", (F.col("rows") - F.col("keys")).alias("duplicates")))


def write_out(counted, times, number, portion=PORTION):
    """Each row `times` times, with its copy's number from 0; a row with many copies is spread over tasks in portions."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(portion).cast("bigint"))
    spread = counted.where(F.col(times) > 0).withColumn("_start", F.explode(starts)).repartition(*counted.columns, "_start")
    last = F.least(F.col("_start") + portion, F.col(times)) - 1
    return spread.withColumn(number, F.explode(F.sequence(F.col("_start"), last))).drop("_start")


def number_copies(df, key, number):
    """Number, from 1, the rows of each key, equal rows as counts: only rows that differ otherwise are put in order."""
    variants = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key])
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = variants.withColumn("_before", upto - F.col("_n"))
    return (write_out(placed, "_n", "_copy")
            .withColumn(number, F.col("_before") + F.col("_copy") + 1).drop("_n", "_before", "_copy"))
