"""Ranked lexical search: exact inner products, found in sparse ball trees.

A document is a sparse vector of integer term scores, an item a set of terms, and the score of a
document their inner product. Documents go into ball trees of bounded size. A node has a centroid c
and radii: as an item q is zero but for its terms, the space is cut into slices of terms and
the node has one radius per slice, so no document x below it scores more than
sum(c over the terms of q) + sum over slices(sqrt(terms of q in the slice) * radius in the slice).
Bounds are rounded up. Each item visits subtrees best first and leaves out those whose bound is
below its worst kept score; leaves are scored in 64-bit integers.

Terms that no item has cannot change a score, so vectors hold the items' terms only; document
lengths and frequencies are those of all documents and whole texts.
"""

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunetrail.llm.shared import binary_values, found, joined, runs, slices, stored, word_hashes

#: Bytes of terms: digits, letters and all of a character beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Best documents of an item.
BEST = 50
#: Bytes of item texts searched at once.
ITEM_BYTES = 1 << 18
#: Documents and vector entries of one tree, documents of a leaf, slices of the terms.
TREE, ENTRIES, LEAF, SLICES = 4096, 1 << 21, 64, 64
#: Parts whose best documents are merged in one group.
FAN = 256


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, A-Z lower-cased, and the number of its text."""
    data, offsets = joined([t.lower() for t in texts])
    starts, ends = runs(TERM[data])
    return word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def _vectors(batches, vocabulary):
    """Rows (doc_id, n, terms, tfs): number of terms, and the vocabulary's terms with their occurrences."""
    width = len(vocabulary)
    for batch in batches:
        texts = [t or b"" for t in binary_values(batch.column(1))]
        ids = batch.column(0).cast(pa.int64())
        for a, b in slices(texts):
            codes, owner = terms_of(texts[a:b])
            known, at = found(codes, vocabulary)
            keys, counts = np.unique(owner[known] * width + at[known], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(b - a + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)),
                 pa.ListArray.from_arrays(offsets, pa.array((keys % max(width, 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
                names=["doc_id", "n", "terms", "tfs"])


class Rows:
    """Sparse rows with integer values."""

    def __init__(self, starts, terms, values):
        self.starts, self.terms, self.values = starts, terms, values

    def __len__(self):
        return len(self.starts) - 1

    def take(self, chosen: np.ndarray) -> "Rows":
        sizes = np.diff(self.starts)[chosen]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[chosen] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.terms[at], self.values[at])

    def dots(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.terms], self.starts[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        part = slice(self.starts[row], self.starts[row + 1])
        out[self.terms[part]] = self.values[part]
        return out


class Tree:
    """Ball tree over rows without empty ones: per node its centroid, radii, children or leaf rows."""

    def __init__(self, rows: Rows, ids: np.ndarray, width: int, leaf: int = LEAF):
        self.centroids, self.radii, self.children, self.leaves, self.parents = [], [], [], [], []
        todo = [(rows, ids, -1)]
        while todo:
            rows, ids, parent = todo.pop()
            node = len(self.centroids)
            if parent >= 0:
                self.children[parent].append(node)
            far = self._ball(rows, width)
            self.parents.append(parent)
            self.children.append([])
            if len(rows) <= leaf:
                self.leaves.append((rows, ids))
                continue
            self.leaves.append(None)
            one = rows.dense(int(np.argmax(far)), width)
            other = rows.dense(int(np.argmax(self._distances(rows, one))), width)
            order = np.argsort(rows.dots(one - other), kind="stable")
            half = len(order) // 2
            todo += [(rows.take(part), ids[part], node) for part in (order[:half], order[half:])]
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)

    @staticmethod
    def _distances(rows, centre):
        return np.add.reduceat(rows.values * (rows.values - 2 * centre[rows.terms]), rows.starts[:-1])

    def _ball(self, rows, width):
        """Add a node's ball; returns the rows' squared distances from its centroid."""
        count = len(rows)
        centre = np.bincount(rows.terms, rows.values, width) / count
        values = rows.values.astype(np.float64)
        owner = np.repeat(np.arange(count), np.diff(rows.starts))
        cell = owner * SLICES + rows.terms % SLICES
        square = np.bincount(np.arange(width) % SLICES, centre * centre, SLICES)
        apart = np.bincount(cell, values * (values - 2 * centre[rows.terms]), count * SLICES).reshape(count, SLICES)
        size = np.bincount(cell, values * values, count * SLICES).reshape(count, SLICES)
        apart += square
        # The sums are off by far less than this share of their largest terms.
        safe = np.maximum(apart, 0) + 1e-10 * (size + square)
        self.centroids.append(centre)
        self.radii.append(np.sqrt(safe.max(axis=0)) * (1 + 1e-9))
        return apart.sum(axis=1)

    def bounds(self, items: "Items") -> np.ndarray:
        """Upper bound of the scores below each node (row) for each item (column)."""
        inner = np.add.reduceat(self.centroids[:, items.terms], items.starts[:-1], axis=1)
        out = (inner + self.radii @ items.reach.T) * (1 + 1e-9) + 1
        for node, parent in enumerate(self.parents):
            if parent >= 0:
                np.minimum(out[node], out[parent], out=out[node])
        return out


class Items:
    """The terms of each item, all items with one at least."""

    def __init__(self, starts, terms):
        self.starts, self.terms = starts, terms
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        shape = (len(starts) - 1, SLICES)
        self.reach = np.sqrt(np.bincount(owner * SLICES + terms % SLICES, minlength=shape[0] * SLICES).reshape(shape))

    def __len__(self):
        return len(self.starts) - 1


class Best:
    """The best (score, id) of an item; equal scores by the smaller id."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score cannot enter."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores, ids):
        good = scores >= self.least
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[:self.most]
            self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, items: Items, best: list[Best], width: int) -> int:
    """Put the documents of a tree into the items' best ones; returns the number of leaves scored."""
    bounds, chosen, scored = tree.bounds(items), np.zeros(width, bool), 0
    for k, kept in enumerate(best):
        column = bounds[:, k]
        if column[0] < kept.least:
            continue
        terms = items.terms[items.starts[k]:items.starts[k + 1]]
        chosen[terms] = True
        queue = [(-column[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kept.least:
                break
            if tree.leaves[node] is None:
                for child in tree.children[node]:
                    heapq.heappush(queue, (-column[child], child))
                continue
            rows, ids = tree.leaves[node]
            kept.add(np.add.reduceat(np.where(chosen[rows.terms], rows.values, 0), rows.starts[:-1]), ids)
            scored += 1
        chosen[terms] = False
    return scored


def _values(n, sizes, terms, tfs, weights, documents, words):
    """Integer score of each entry."""
    m = np.fromiter((50 + 50 * x * documents // max(words, 1) for x in n), np.int64, len(n))
    tf = tfs.astype(np.int64)
    return weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes)))


NULL_ID = np.iinfo(np.int64).max


def _search(batches, items, weights, documents, words, most):
    """Rows (item, doc_id, score): the best documents of this part for each item."""
    best = [Best(most) for _ in range(len(items))]
    for batch in batches:
        ids = batch.column(0).fill_null(NULL_ID).to_numpy()
        lists = batch.column(2)
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        terms, tfs = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        values = _values(batch.column(1).to_pylist(), np.diff(starts), terms, tfs, weights, documents, words)
        filled = np.flatnonzero(np.diff(starts) > 0)
        rows, ids = Rows(starts, terms, values).take(filled), ids[filled]
        a = 0
        while a < len(rows):
            b = min(a + TREE, max(a + 1, int(np.searchsorted(rows.starts, rows.starts[a] + ENTRIES))), len(rows))
            part = np.arange(a, b)
            search(Tree(rows.take(part), ids[part], len(weights)), items, best, len(weights))
            a = b
    for k, kept in enumerate(best):
        if len(kept.ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kept.ids), k, np.int32)),
                 pa.array(kept.ids, mask=kept.ids == NULL_ID), pa.array(kept.scores)], names=["item", "doc_id", "score"])


def _blocks(items: DataFrame, item_id: str, text: str, most: int):
    """Items (id, text) in lists of bounded bytes, streamed."""
    block, size = [], 0
    for row in items.select(F.col(item_id), F.coalesce(F.col(text), F.lit("")).cast("binary")).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
    if block:
        yield block


def _block_ranks(docs, block, most):
    """Rows (item, doc_id, score, rank) for one block of items."""
    spark = docs.sparkSession
    codes, owner = terms_of([t for _, t in block])
    vocabulary, at = np.unique(codes, return_inverse=True)
    pairs = np.unique(owner * max(len(vocabulary), 1) + at)
    owner, at = pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1)
    numbers = np.unique(owner)
    items = Items(np.append(np.searchsorted(owner, numbers), len(owner)), at)
    vectors = stored(docs.mapInArrow(functools.partial(_vectors, vocabulary=vocabulary),
                                     "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    documents, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row per term of the block.
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    part = functools.partial(_search, items=items, weights=weights, documents=documents, words=words, most=most)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    hits = vectors.mapInArrow(part, "item int, doc_id long, score long").withColumn(
        "fan", F.floor(F.spark_partition_id() / FAN))
    for keys in (("item", "fan"), ("item",)):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= most)
    names = spark.createDataFrame([(k, block[int(number)][0]) for k, number in enumerate(numbers)],
                                  "item int, item_id long")
    return stored(hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranks")


def best_documents(docs: DataFrame, items: DataFrame, most: int = BEST, text: str = "text", doc_id: str = "doc_id",
                   item_id: str = "item_id", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the `most` best documents of each item with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased. With
    N documents that have terms, L terms in all, n in the document and df documents that hold it, a
    term weighs floor(1000 ln((2N+2)/(2df+1))) and adds weight * (10^9 tf div (1000 tf + 20 m)),
    m = 50 + 50 n N div L. Equal scores go by ascending id. NULL and empty texts have no terms and
    are never found; NULL ids rank behind all others of their score; rows that repeat, documents or
    items, count each by itself. Other columns are left out; ids must be integers.

    Items are taken in blocks of `item_bytes` of text, which the driver reads one by one; each
    block's vectors, weights and results are stored before the next. Tasks hold one block, one tree
    and `most` documents per item. Results of a part are merged with those of others, at most `FAN`
    parts at once. Runs jobs.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")),
                         "item_id", "text", item_bytes):
        if not len(terms_of([t for _, t in block])[0]):
            continue
        ranks = _block_ranks(plain, block, most)
        out = ranks if out is None else out.unionByName(ranks)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
