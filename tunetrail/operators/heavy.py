"""Top lists over very many keys, without a shuffle of all keys.

Keys are dealt to a fixed number of buckets by hash. The sum of a bucket bounds each of its keys from
above; the n-th largest key of the heaviest buckets bounds the n-th largest key of all from below.
Only rows in buckets that reach that bound are grouped by key, so the answer is exact whatever the
data; where no key stands out, every bucket reaches the bound and all keys are grouped as usual.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tunetrail.session import checkpoint

# Buckets by default: a task sends at most this many partial sums, the row filter holds as many numbers.
BUCKETS = 1 << 16


def heavy_rows(rows, keys, weights, n, buckets=BUCKETS):
    """The rows whose key can be among the n heaviest by one of the weights.

    `weights` are columns of whole numbers from 0 on (NULL counts as 0); a key weighs the sum over
    its rows, and keys of weight 0 are in no list. The rows kept hold every row of every key of the
    n heaviest, ties included, so top lists of them equal those of all rows. Rows with a NULL key
    are left out. Runs jobs: `rows` are read twice here and once by whatever reads the result.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [f"_w{i}" for i in range(len(weights))]
    marked = rows.dropna(subset=keys).withColumns(
        {"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"),
         **{name: F.coalesce(w, F.lit(0)).cast("bigint") for name, w in zip(names, weights)}})
    sums = [F.sum(name).alias(name) for name in names]
    top = lambda df, name, *order: df.where(F.col(name) > 0).orderBy(F.desc(name), *order).limit(n)

    totals = checkpoint(marked.groupBy("_bucket").agg(*sums))
    first = reduce(DataFrame.union, [top(totals, name, "_bucket").select("_bucket") for name in names]).distinct()
    seeds = checkpoint(marked.join(F.broadcast(first), "_bucket", "left_semi").groupBy(*keys).agg(*sums))
    bounds = [top(seeds, name).agg(F.min(name)).scalar() for name in names]
    reach = [(F.col(name) > 0) & (F.col(name) >= bound) for name, bound in zip(names, bounds)]
    # At most `buckets` numbers, whatever the rows.
    wanted = totals.where(reduce(lambda a, b: a | b, reach)).select("_bucket")
    return marked.join(F.broadcast(wanted), "_bucket", "left_semi").select(*rows.columns)
