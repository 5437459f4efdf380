"""SimHash fingerprints and their links by multi-index hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints at distance 4 or less agree on
the third segment, or differ by one bit at most in one of the first two: every fingerprint is put
into the table of each segment, the Hamming ball of the segment's radius is enumerated, table
matches are fetched by key, and the complete distance is verified.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.components import components
from tunetrail.llm.shared import extended, free_name, other_columns, quoted, stored

#: Contracted values.
SHINGLE, DISTANCE, SEED = 4, 4, 42
BITS = 64
SMALL = 32


def segments(distance: int = DISTANCE, count: int = 3) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius): by the pigeonhole one segment is within its radius."""
    cuts = [BITS * k // count for k in range(count + 1)]
    radius, over = divmod(distance, count)
    return [(cuts[k], cuts[k + 1] - cuts[k], radius if k <= over else radius - 1) for k in range(count)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, k = ends - sizes, min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())],
                     np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(codes), 1 << 16):
        part = codes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(codes)).tobytes(), "big")


def _fingerprints(batches, position, shingle, name):
    for batch in batches:
        texts = batch.column(position).cast(pa.binary()).to_pylist()
        codes = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=[*batch.schema.names, name])


def ball(bits: int, radius: int) -> list[int]:
    """Masks of the Hamming ball around zero."""
    masks, shell = [0], [(0, 0)]
    for _ in range(radius):
        shell = [(m | 1 << b, b + 1) for m, low in shell for b in range(low, bits)]
        masks += [m for m, _ in shell]
    return masks


def _roots(n: int, links) -> list[tuple[int, int]]:
    """Links of a spanning forest."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _bucket_links(table: np.ndarray, probes: np.ndarray, distance: int):
    """Verified links of one key that span the same components as all its verified links.

    Breadth-first: a fingerprint that is reached is not compared again with others that are, so a
    dense group costs little more than its size.
    """
    near = lambda values, x: np.bitwise_count(values ^ x) <= distance
    links = []
    while len(table):
        frontier, table = [(table[0], True)], table[1:]
        while frontier:
            x, in_table = frontier.pop()
            hit = near(table, x)
            reached, table = table[hit], table[~hit]
            frontier += [(y, True) for y in reached]
            links += [(x, y) for y in reached if y != x]
            if in_table:
                hit = near(probes, x)
                reached, probes = probes[hit], probes[~hit]
                frontier += [(y, False) for y in reached]
                links += [(x, y) for y in reached if y != x]
    return links


def _links(batches, distance):
    """Links of key-sorted rows (key, code, probe); a key may run over several batches."""
    rest = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        codes = batch.column(1).to_numpy().view(np.uint64)
        probes = batch.column(2).to_numpy(zero_copy_only=False)
        if rest is not None:
            keys, codes, probes = (np.concatenate(x) for x in zip(rest, (keys, codes, probes)))
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        rest = keys[whole:], codes[whole:], probes[whole:]
        yield from _key_links(keys[:whole], codes[:whole], probes[:whole], distance)
    if rest is not None:
        yield from _key_links(*rest, distance)


def _key_links(keys, codes, probes, distance):
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    members = np.add.reduceat(~probes, starts)
    out = []
    for start, size in zip(starts[(members > 0) & (sizes > 1)].tolist(), sizes[(members > 0) & (sizes > 1)].tolist()):
        part, kind = codes[start:start + size], probes[start:start + size]
        if size <= SMALL:
            a, b = np.nonzero(np.bitwise_count(part[:, None] ^ part[None, :]) <= distance)
            fits = (a < b) & (part[a] != part[b]) & ~(kind[a] & kind[b])
            if fits.any():
                out += [(part[x], part[y]) for x, y in _roots(size, zip(a[fits].tolist(), b[fits].tolist()))]
        else:
            out += _bucket_links(part[~kind], part[kind], distance)
    if out:
        ends = np.array(out, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])


def fingerprint_links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column code) that span all pairs within `distance`."""
    entries = []
    for number, (first, bits, radius) in enumerate(segments(distance)):
        low = BITS - first - bits
        part = F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << bits) - 1))
        key = part + F.lit(number << 40)
        entries.append(codes.select(key.alias("key"), "code", F.lit(False).alias("probe")))
        if radius == 0:
            continue
        masks = F.array(*(F.lit(m).cast("long") for m in ball(bits, radius)[1:]))
        entries.append(codes.select(F.explode(F.transform(masks, lambda m: part.bitwiseXOR(m) + F.lit(number << 40)))
                                    .alias("key"), "code", F.lit(True).alias("probe")))
    rows = entries[0]
    for more in entries[1:]:
        rows = rows.unionByName(more)
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _links(batches, distance), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                   distance: int = DISTANCE, kept: str | None = None) -> DataFrame:
    """All columns of `docs`, the fingerprint (16 hex digits) and the component_id of each row.

    component_id is the smallest id linked over any chain of fingerprints within `distance` bits;
    equal fingerprints link. NULL and empty texts have fingerprint zero and link like any other.
    NULL ids take part and are never a component_id (NULL if a component has no other). With the
    name of a column in `kept`, it is added and true for one row of each component: the smallest
    id, NULL last, then a hash of the text, then any. Input columns with the name of an added one
    are replaced. Runs jobs; the fingerprinted rows and the links are stored in the shared folder.
    """
    names = other_columns(docs, "fingerprint", "component_id", *([kept] if kept else []))
    plain = docs.select(*quoted(names))
    code, row, best, position = *(free_name(plain, n) for n in ("_code", "_row", "_best")), names.index(text)
    coded = plain.mapInArrow(lambda batches: _fingerprints(batches, position, shingle, code),
                             extended(plain, f"{code} long"))
    if kept:
        coded = coded.withColumn(row, F.monotonically_increasing_id())
    coded = stored(coded, "fingerprints")
    first = [F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"),
                      F.col(row).alias("row"))] if kept else []
    codes = coded.groupBy(F.col(code).alias("code")).agg(F.min(doc_id).alias("least"),
                                                         *(F.min(f).alias("first") for f in first))
    roots = components(fingerprint_links(codes.select("code"), distance))
    # A root is linked to, but has no row of its own.
    roots = roots.unionByName(roots.select(F.col("root").alias("u"), "root")).distinct()
    linked = roots.join(codes, roots["u"] == codes["code"]).drop("u")
    # Stored, so that the join below shuffles both sides and a hot group can be split.
    least_of = stored(linked.groupBy("root").agg(F.min("least").alias("group_least"),
                                                 *(F.min("first").alias("group_first") for _ in first)), "groups")
    grouped = linked.join(least_of, "root").drop("root", "least", "first")
    named = codes.join(grouped, "code", "left").select(
        F.col("code").alias(code), F.coalesce("group_least", "least").alias("component_id"),
        *(F.coalesce("group_first", "first")["row"].alias(best) for _ in first))
    hexed = F.lower(F.lpad(F.hex(code), 16, "0"))
    return coded.join(named, code).select(*quoted(names), hexed.alias("fingerprint"), "component_id",
                                          *((F.col(row) == F.col(best)).alias(kept) for _ in first))
