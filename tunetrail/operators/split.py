"""Exact train / test splits without ranking every row in one task."""

import os
from functools import reduce

from pyspark.sql import Window, functions as F, types as T

from tunetrail.functions.time import micros
from tunetrail.operators.dedupe import PORTION, write_out

RANK_ROWS = 1_000_000


def rank_cut(df, order, levels, fraction, by=None, rank_rows=RANK_ROWS, needs=None):
    """{group: (order key at the cut, rows of that key before the cut, rows of that key)}.

    The cut is row number floor(fraction · rows of the group), or that of `needs` by group. `levels` are columns that coarsen
    the order, each finer than the one before. For each level one job counts rows per value
    (combined on the map side) and one row per group comes back: the value that holds the cut.
    The next job reads that value only. Where more than `rank_rows` keys are left after all
    levels, ever longer prefixes of the last order column follow. Then the keys, counted, are
    ranked. Groups whose cut is row 0 are left out.
    """
    rows = df.withColumn("_group", F.lit(0) if by is None else F.col(by)).where(F.col("_group").isNotNull())
    left = None
    for level in levels:
        rows, needs, left = _narrow(rows, F.col(level), needs, fraction)
        if not needs:
            return {}
        if left <= rank_rows:
            break
    last = order[-1]
    while left > rank_rows and isinstance(df.schema[last].dataType, T.StringType):
        ends = rows.groupBy("_group").agg(F.min(last).alias("low"), F.max(last).alias("high")).collect()
        if all(r["low"] == r["high"] for r in ends):
            break
        shared = {r["_group"]: len(os.path.commonprefix([r["low"], r["high"]])) for r in ends}
        rows, needs, left = _narrow(rows, F.substr(F.col(last), F.lit(1), _per_group(shared) + 2), needs, fraction)
    counts = rows.groupBy("_group", *order).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    need = _per_group(needs)
    found = (counts.withColumn("_upto", upto).where((need <= F.col("_upto")) & (need > F.col("_upto") - F.col("_n")))
             .select("_group", *order, "_n", (need - F.col("_upto") + F.col("_n")).alias("_quota")).collect())
    return {r["_group"]: (tuple(r[c] for c in order), r["_quota"], r["_n"]) for r in found}


def _narrow(rows, value, needs, fraction):
    """Rows whose value holds the cut, what the cut needs of them, and the most rows of a group."""
    valued = rows.withColumn("_value", value)
    counts = valued.groupBy("_group", "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_group")
    need = F.floor(F.sum("_n").over(group) * F.lit(fraction)) if needs is None else _per_group(needs)
    upto = F.sum("_n").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    cuts = (counts.withColumns({"_need": need, "_upto": upto})
            .where((F.col("_need") <= F.col("_upto")) & (F.col("_need") > F.col("_upto") - F.col("_n")))
            .select("_group", "_value", "_n", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"))).collect()
    if not cuts:
        return rows, {}, 0
    inside = reduce(lambda a, b: a | b, [(F.col("_group") == c["_group"]) & (F.col("_value") == c["_value"]) for c in cuts])
    return valued.where(inside).drop("_value"), {c["_group"]: c["_need"] for c in cuts}, max(c["_n"] for c in cuts)


def _per_group(values):
    """Literal of the row's group."""
    return F.coalesce(*[F.when(F.col("_group") == g, F.lit(v)) for g, v in values.items()])


def _before(columns, cut):
    """columns < cut, in lexicographic order."""
    first, rest = columns[0], columns[1:]
    return first < cut[0] if not rest else (first < cut[0]) | ((first == cut[0]) & _before(rest, cut[1:]))


def _labelled(df, label, keys, cuts, rank_rows=RANK_ROWS, tie=None):
    """Add `split`: train before each group's cut; of rows that share the key at a cut, as many as it needs.

    Where keys repeat at a cut, those rows are in no order of their own: they follow a hash of all
    their columns (column `tie` if given), with a cut of its own. Of rows that are equal throughout, copies are counted and
    written again, as many as the cut needs for train.
    """
    of = lambda group: F.lit(True) if label is None else F.col(label) == group
    either = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))
    before = either([of(g) & _before(keys, cut) for g, (cut, _, _) in cuts.items()])
    at = {g: of(g) & reduce(lambda a, b: a & b, [k == v for k, v in zip(keys, cut)]) for g, (cut, _, _) in cuts.items()}
    known = F.lit(True) if label is None else F.col(label).isNotNull()
    named = lambda train: F.when(known, F.when(train, "train").otherwise("test"))
    shared = [g for g, (_, quota, copies) in cuts.items() if quota < copies]
    plain = before | either([at[g] for g in cuts if g not in shared])
    if not shared:
        return df.withColumn("split", named(plain))
    tied = F.coalesce(either([at[g] for g in shared]), F.lit(False))
    out = df.where(~tied).withColumn("split", named(plain))

    digest = F.xxhash64(*df.columns) if tie is None else F.col(tie)
    ties = df.where(tied).select(*([] if label is None else [label]), digest.alias("_tie"))
    ties = ties.withColumns({f"_range{bits}": F.shiftright("_tie", bits) for bits in (40, 20)})
    inner = rank_cut(ties, ["_tie"], ["_range40", "_range20", "_tie"], None, label, rank_rows,
                     {g: cuts[g][1] for g in shared})
    first = either([of(g) & (digest < tie) for g, ((tie,), _, _) in inner.items()])
    equal = {g: of(g) & (digest == tie) for g, ((tie,), _, _) in inner.items()}
    cut_again = [g for g, (_, quota, copies) in inner.items() if quota < copies]
    whole = first | either([equal[g] for g in inner if g not in cut_again])
    copied = either([equal[g] for g in cut_again])
    out = out.unionByName(df.where(tied & ~copied).withColumn("split", named(whole)))
    if not cut_again:
        return out
    quota = F.coalesce(*[F.when(of(g), F.lit(inner[g][1])) for g in cut_again])
    return out.unionByName(_copies(df.where(tied & copied), label, quota))


def _copies(rows, label, quota):
    """Rows with equal hashes, their first `quota` copies train: counted, then written again in portions."""
    columns = rows.columns
    order = Window.partitionBy(F.lit(0) if label is None else F.col(label)).orderBy(*columns)
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", upto)
    train = F.least(F.col("_n"), F.greatest(F.lit(0), quota - (F.col("_upto") - F.col("_n"))))
    halves = counted.select(*columns, F.explode(F.array(
        F.struct(F.lit("train").alias("split"), train.alias("n")),
        F.struct(F.lit("test").alias("split"), (F.col("_n") - train).alias("n")))).alias("_half"))
    halves = halves.select(*columns, "_half.split", F.col("_half.n").alias("_n"))
    return write_out(halves, "_n", "_copy", PORTION).select(*columns, "split")


def stratified_split(df, label="skipped", key="play_id", fraction=0.8, seed=42, rank_rows=RANK_ROWS, tie=None):
    """Add `split`: exactly floor(fraction · n) rows of each class are 'train'.

    Rows are ordered by a seeded hash of the key, so the split is the same on every run and
    cluster. The hash is uniform: four digits leave 1/65536 of a class, eight leave next to
    nothing. The input is read once per step: pass a stored table. Rows that share a key at the cut
    follow a hash of all columns, or column `tie`, which holds that hash of a wider table.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    keys = df.select(label, F.col(key).alias("_key"), digest.alias("_hash")) \
        .withColumns({f"_start{n}": F.substring("_hash", 1, n) for n in (4, 8)})
    cuts = rank_cut(keys, ["_hash", "_key"], ["_start4", "_start8"], fraction, label, rank_rows)
    return _labelled(df, label, [digest, F.col(key)], cuts, rank_rows, tie)


def time_split(windows, fraction=0.8, ts="ts", key="play_id", rank_rows=RANK_ROWS):
    """Add `split`: the first floor(fraction · n) rows in (time, key) order are 'train'.

    The cut is searched by day, second and microsecond, and among rows of one microsecond by
    ranges or prefixes of the key, until few enough rows are left to rank. The input is read
    once per step: pass a stored table.
    """
    at = micros(windows, ts)
    keys = windows.select(at.alias("_at"), F.col(key).alias("_key")).withColumns({
        "_day": F.floor(F.col("_at") / 86_400_000_000), "_second": F.floor(F.col("_at") / 1_000_000)})
    ranges = {}
    if isinstance(windows.schema[key].dataType, T.NumericType):
        ranges = {f"_range{bits}": F.floor(F.col("_key") / F.lit(2 ** bits)) for bits in (40, 20)}
    cuts = rank_cut(keys.withColumns(ranges) if ranges else keys, ["_at", "_key"], ["_day", "_second", "_at", *ranges],
                    fraction, rank_rows=rank_rows)
    return _labelled(windows, None, [at, F.col(key)], cuts, rank_rows)
