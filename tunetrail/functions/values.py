"""Casts, flags and bins."""

from pyspark.sql import functions as F, types as T


def to_number(c):
    """Numeric cast; text that is no number becomes NULL."""
    return c.try_cast("double")


def to_flag(c):
    """Mixed boolean text → 0/1; anything unknown is 0."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0"), 1).otherwise(0)


def bools_to_int(df):
    """Cast every boolean column to 0/1."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({n: F.col(n).cast("int") for n in names}) if names else df


def numeric_columns(df, exclude=()):
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def prefixed(df, prefix):
    return [n for n in df.columns if n.startswith(prefix)]


def skip_or_listen(c):
    return F.when(c > 0, "skip").otherwise("listen")


def bin3(c):
    """[0, 1/3] Low, (1/3, 2/3] Mid, (2/3, 1] High, NULL outside."""
    return (F.when((c >= 0) & (c <= 1 / 3), "Low")
            .when((c > 1 / 3) & (c <= 2 / 3), "Mid")
            .when((c > 2 / 3) & (c <= 1), "High"))


def remap(df, col, mapping, keep_unmatched=True, key="from", value="to"):
    """Replace values through a two-column table; of repeated keys the smallest value counts."""
    pairs = mapping.groupBy(F.col(key).alias(col)).agg(F.min(value).alias("_to"))
    mapped = F.coalesce("_to", col) if keep_unmatched else F.col("_to")
    return df.join(pairs, col, "left").withColumn(col, mapped).select(df.columns)
