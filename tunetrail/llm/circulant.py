"""Near-duplicate groups by circulant MinHash, confirmed on full shingle sets.

Two permutations of the 64-bit numbers make every signature coordinate: `scattered` places a
document's shingles on a circle, `ranked` orders the circle, and coordinate k is the least rank of
the shingles after the circle is turned by k. Coordinates are banded; documents that share a band
are candidates, and a candidate is linked only if the full sets reach the similarity.

Equal sets are one node. Links need to span the same groups as all links, so a bucket is not
expanded into pairs: each node is first compared with the least node it shares a bucket with. The
nodes of buckets that then still hold several groups meet again under each of their rarest
shingles, of which similar sets have one in common (prefix filter, with the places of the common
shingle). Few nodes under one shingle are compared pair by pair between groups, many against a
growing number of pivots, until no shingle holds several groups.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunetrail.llm.components import components
from tunetrail.llm.shared import (binary_values, joined, mix, prefix_sums, slices, stored, window_hashes,
                                  word_hashes, word_spans)

#: Contracted values: words of a shingle, similarity in percent.
SHINGLE, PERCENT = 5, 85
#: Bands and rows of a band: a pair at 85 % shares no band with probability (1 - 0.85^6)^40 = 6e-9.
BANDS, ROWS = 40, 6
#: Nodes under a shingle that are compared pair by pair, pivots of more in the first round.
SMALL, PIVOTS = 16, 4
#: Members that meet one copy of their pivot's text.
FAN = 64
#: Bytes of texts, shingles hashed at once.
PIECE, BLOCK = 1 << 18, 1 << 15
LAST = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, A-Z lower-cased; shorter texts are one shingle."""
    data, offsets = joined([t.lower() for t in texts])
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    grams = window_hashes(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(grams[a:b - shingle + 1]))
        elif b > a:
            out.append(mix(prefix_sums(words[a:b])[-1:], 100 + b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def scattered(codes: np.ndarray) -> np.ndarray:
    """First permutation: shingle hashes to places on the circle."""
    return mix(codes, 41)


def ranked(places: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation: ranks of places (odd multiplier, xor-shift, odd multiplier), in `out`."""
    np.multiply(places, np.uint64(0x9E6C63D0876A9A47), out=out)
    np.right_shift(out, np.uint64(32), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, np.uint64(0xC2B2AE3D27D4EB4F), out=out)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Coordinates (rows) of each set (columns); no set may be empty."""
    out = np.full((size, len(sets)), LAST)
    places = scattered(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    starts = np.searchsorted(owner, np.arange(len(sets)))
    turned, ranks, spare = np.empty((3, BLOCK), np.uint64)
    for a in range(0, len(places), BLOCK):
        b = min(a + BLOCK, len(places))
        low, high, n = owner[a], owner[b - 1] + 1, b - a
        local = np.maximum(starts[low:high] - a, 0)
        for k in range(size):
            np.subtract(places[a:b], np.uint64(k), out=turned[:n])
            least = np.minimum.reduceat(ranked(turned[:n], ranks[:n], spare[:n]), local)
            np.minimum(out[k, low:high], least, out=out[k, low:high])
    return out


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys (one row per set) out of coordinates."""
    keys = np.empty((signs.shape[1], bands), np.uint64)
    for band in range(bands):
        key = np.full(signs.shape[1], band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = mix(key ^ signs[k], 3)
        keys[:, band] = key
    return keys


def _signed(batches, shingle, bands, rows):
    """Rows (doc_id, text, n_shingles, digest, keys); texts without words have neither digest nor keys."""
    for batch in batches:
        texts = [t or b"" for t in binary_values(batch.column(1))]
        for a, b in slices(texts, PIECE):
            sets = shingle_sets(texts[a:b], shingle)
            full = [s for s in sets if len(s)]
            keys = band_keys(signatures(full, bands * rows), bands, rows) if full else np.empty((0, bands), np.uint64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            offsets = np.concatenate([[0], np.cumsum([bands * bool(len(s)) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(a, b - a).columns, pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "text", "n_shingles", "digest", "keys"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct hashes."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(batches, shingle, percent):
    """Links (u, v) out of rows (pivot, salt, role, node, text) sorted by the first three; role 0 is the pivot."""
    now, base = None, None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        roles, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts, links = [t or b"" for t in binary_values(batch.column(4))], []
        for a, b in slices(texts, PIECE):
            for k, codes in enumerate(shingle_sets(texts[a:b], shingle), a):
                if roles[k] == 0:
                    now, base = keys[k], codes
                elif keys[k] == now and similar(base, codes, percent):
                    links.append((keys[k][0], nodes[k]))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()),
                                          pa.array([v for _, v in links], pa.int64())], names=["u", "v"])


def _links(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The stored pairs (pivot, node) whose full sets are similar, as (u, v); texts are (node, text).

    Every block of a pivot's nodes gets its own copy of the pivot's text, so no task gets all of a pivot.
    """
    blocks = stored(pairs.groupBy("pivot").agg(F.ceil(F.count("node") / FAN).cast("int").alias("blocks")), "blocks")
    members = pairs.join(blocks, "pivot").select(
        "pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("salt"), F.lit(1).alias("role"), "node")
    heads = blocks.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"),
                          F.lit(0).alias("role"), F.col("pivot").alias("node"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (members.unionByName(heads).join(texts, "node").select("pivot", "salt", "role", "node", "text")
             .repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "role"))
    part = functools.partial(_confirmed, shingle=shingle, percent=percent)
    return stored(dealt.mapInArrow(part, "u long, v long"), "links")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (.., node) with the label of their group so far, stored."""
    labels = components(links).withColumnRenamed("u", "node")
    return stored(members.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")


def _open(labelled: DataFrame, *more) -> DataFrame:
    """Keys whose members are of several groups, stored, with their number of members."""
    return stored(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                              F.count("node").alias("size"), *more)
                  .where("low < high").drop("low", "high"), "open")


def _exploded(batches, shingle):
    """Rows (node, n, code): the shingles of each text."""
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        texts = [t or b"" for t in binary_values(batch.column(1))]
        for a, b in slices(texts, PIECE):
            sets = shingle_sets(texts[a:b], shingle)
            sizes = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes[a:b], sizes)), pa.array(np.repeat(sizes, sizes)),
                 pa.array(np.concatenate(sets).view(np.int64))], names=["node", "n", "code"])


def _prefixes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (key, node, n, place): the rarest shingles of each text, numbered from the rarest on.

    Similar sets have their first common shingle among the n - ceil(n * percent / 100) + 1 rarest
    ones of both, whatever the order, if it is the same for all: here frequency among these texts.
    A shingle of one text only takes a place and no row.
    """
    codes = stored(texts.mapInArrow(functools.partial(_exploded, shingle=shingle), "node long, n long, code long"), "codes")
    common = stored(codes.groupBy("code").agg(F.count("node").alias("df")).where("df > 1"), "common")
    rows = codes.join(common, "code")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("df", "code")) + F.col("n") - F.count("code").over(own)
    limit = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.withColumn("place", place).where(F.col("place") <= limit).select(F.col("code").alias("key"), "node", "n", "place")


def _may_be_similar(percent: int, n, place, other_n, other_place):
    """Whether sets whose first common shingle has these places can reach the similarity."""
    most = 1 + F.least(n - place, other_n - other_place)
    return (100 + percent) * most >= percent * (n + other_n)


def spanning_links(signed: DataFrame, nodes: DataFrame, shingle: int, percent: int, small: int, pivots: int) -> DataFrame:
    """Links that span the groups of all similar nodes with a bucket in common. Runs jobs."""
    entries = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), F.explode("keys").alias("key"))
    entries = stored(entries, "entries")
    least = stored(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("node").alias("size"))
                   .where("size > 1").drop("size"), "least")
    members = stored(entries.join(least, "key"), "members")
    tested = stored(members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pivot")), "tested")
    texts = stored(signed.select(F.col("row").alias("node"), "text").join(members.select("node").distinct(), "node"), "texts")
    links = _links(texts, tested, shingle, percent)
    labelled = _labelled(members.select("key", "node"), links)
    opened = _open(labelled)
    if opened.isEmpty():
        return links
    left = labelled.join(opened, "key").select("node").distinct()
    texts = stored(texts.join(left, "node"), "texts")
    members = stored(_prefixes(texts, shingle, percent), "prefixes")
    while True:
        labelled = _labelled(members, links)
        opened = _open(labelled, F.min("n").alias("shortest"))
        if opened.isEmpty():
            return links
        rest = stored(labelled.join(opened, "key").where(
            (100 + percent) * (1 + F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("shortest"))), "rest")
        few, many = rest.where(F.col("size") <= small), rest.where(F.col("size") > small)
        chosen = stored(many.groupBy("key", F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots)).alias("slot"))
                        .agg(F.min(F.struct("node", "label", "n", "place")).alias("pivot")).select("key", "pivot"), "chosen")
        other = few.select("key", F.struct("node", "label", "n", "place").alias("pivot")).unionByName(chosen)
        ordered = (F.col("size") > small) | (F.col("pivot.node") < F.col("node"))
        pairs = rest.join(other, "key").where(
            ordered & (F.col("pivot.node") != F.col("node")) & (F.col("pivot.label") != F.col("label"))
            & _may_be_similar(percent, F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"))).select(
                F.least("pivot.node", "node").alias("pivot"), F.greatest("pivot.node", "node").alias("node"))
        pairs = stored(pairs.distinct().join(tested, ["pivot", "node"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs.select(*tested.columns))
        members = stored(many.join(chosen.select("key", F.col("pivot.node").alias("node")), ["key", "node"], "left_anti")
                         .select("key", "node", "n", "place"), "members")
        if not pairs.isEmpty():
            links = links.unionByName(_links(texts, pairs, shingle, percent))
        pivots *= 8


def minhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                   percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, small: int = SMALL,
                   pivots: int = PIVOTS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every row of `docs`.

    A document's set holds its distinct shingles of words (runs of bytes other than 0x20 and
    0x09-0x0D, A-Z lower-cased); with fewer words the whole sequence is its one shingle. Rows with
    100 * intersection >= percent * union are linked, component_id is the smallest id linked over
    any chain, and `kept` tells the rows with that id. NULL texts and texts without words have no
    shingles and are linked with nothing, equal ones neither. NULL ids take part and are never a
    component_id; if a group has no other id, its component_id is NULL and all its rows are kept.
    Rows that repeat an id are judged one by one. Other columns are left out; ids must be integers.
    Runs jobs; texts with their keys and all links are stored in the shared folder.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    part = functools.partial(_signed, shingle=shingle, bands=bands, rows=rows)
    signed = plain.mapInArrow(part, "doc_id long, text string, n_shingles long, digest binary, keys array<long>")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    nodes = stored(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"),
                                                                        F.min("doc_id").alias("least")), "nodes")
    roots = components(spanning_links(signed, nodes, shingle, percent, small, pivots)).withColumnRenamed("u", "node")
    rooted = stored(nodes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")),
                    "rooted")
    groups = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "groups")
    named = stored(rooted.join(groups, "root").select("digest", "component"), "named")
    found = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.withColumn("component_id", component).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
