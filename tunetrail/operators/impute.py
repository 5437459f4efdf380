"""Genre imputation by precedence of lookup tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tunetrail.operators.dedupe import first_per_key
from tunetrail.schema import AUDIO_CORE


def list_text(c):
    """array<string> → the text of a Python list, as the genres column stores it."""
    quoted = F.transform(c, lambda g: F.when(
        g.contains("'") & ~g.contains('"'), F.concat(F.lit('"'), g, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.regexp_replace(g, r"(['\\])", r"\\$1"), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _packed(keys, tables, rules):
    """One row per key: of each named lookup its genres, and the rules of the key as one small array in order.

    Of repeated lookup keys the smallest genre list counts, so plays never multiply.
    """
    rows = []
    if rules is not None:
        rule = F.struct("priority", F.lower("title").alias("title"), "negate", "genres")
        rows = [rules.select(*keys, F.lit("").alias("_table"), F.lit(None).cast("array<string>").alias("_genres"), rule.alias("_rule"))]
    kind = rows[0].schema["_rule"].dataType if rows else "struct<genres: array<string>>"
    rows += [table.select(*keys, F.lit(name).alias("_table"), F.col("genres").alias("_genres"), F.lit(None).cast(kind).alias("_rule"))
             for name, table in tables.items()]
    smallest = [F.min(F.when(F.col("_table") == name, F.col("_genres"))).alias(name) for name in tables]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(
        *smallest, *([] if rules is None else [F.sort_array(F.collect_list("_rule")).alias("_rules")]))


def impute_genres(plays, empties=(), rules=None, nulls=()):
    """Fill `genres` where it is '[]' (artist tables, then title rules) or NULL (tables in order).

    Tables hold their key columns (`artist` or `track_uri`) and `genres array<string>`; rules hold
    (priority, artist, title, negate, genres). The order given is the precedence: the first table
    with the key wins, of the rules the first that matches. Tables with the same key columns are
    packed into one, so plays are joined once per kind of key. Spark broadcasts a packed table when
    its size allows, and otherwise splits hot keys of the plays side at run time.
    """
    empty_names = [f"_empty{i}" for i in range(len(empties))]
    null_names = [f"_null{i}" for i in range(len(nulls))]
    kinds = {} if rules is None else {("artist",): {}}
    for name, table in zip(empty_names + null_names, [*empties, *nulls]):
        keys = tuple(sorted(c for c in table.columns if c != "genres"))
        kinds.setdefault(keys, {})[name] = table
    df = plays
    for keys, tables in kinds.items():
        df = df.join(_packed(keys, tables, rules if keys == ("artist",) else None), list(keys), "left")
    found = {name: list_text(F.col(name)) for name in empty_names + null_names}
    of_empty = [found[name] for name in empty_names]
    if rules is not None:
        matched = F.filter("_rules", lambda r: (r["title"] == F.lower("track_name")) != r["negate"])
        of_empty.append(list_text(F.try_element_at(matched, F.lit(1))["genres"]))
    filled = F.col("genres")
    if of_empty:
        filled = F.when(F.trim("genres") == "[]", F.coalesce(*of_empty, "genres")).otherwise(filled)
    if null_names:
        filled = F.when(F.col("genres").isNull(), F.coalesce(*[found[name] for name in null_names])).otherwise(filled)
    return df.withColumn("genres", filled).select(plays.columns)


def impute_candidates(plays, order_by=("ts", "play_id"), needed=tuple(AUDIO_CORE) + ("lyrics",)):
    """Tracks worth a manual genre: genre NULL, everything else known, one row per track."""
    gaps = plays.where(F.col("genres").isNull()).dropna(subset=list(needed))
    return first_per_key(gaps, ["track_uri"], list(order_by))
