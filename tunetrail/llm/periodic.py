"""Periodic runs of words, found by a descending-LCP Kruskal over suffix classes.

The words of a batch of texts get one suffix order by prefix doubling; the alphabets of two texts
share no symbol, so that suffixes of different texts have no common prefix. Neighbours in that
order are united by decreasing length of their common prefix (LCP). Union-find classes hold their
positions in order: when a union at LCP `l` brings positions i and j = i + d next to each other and
d <= l, words i to j + l have period d. Nothing between them shares the prefix, so d is the smallest
period; and if the words before i and j differ, i is where the run starts. Every run is seeded so
at its first two periods.
"""

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tunetrail.llm.shared import (binary_values, extended, joined, mix, other_columns, quoted, slices, window_hashes,
                                  word_hashes, word_spans)

#: Words of a run at least; a run also has two periods at least.
LEAST = 12
RUN = "array<struct<start: long, length: long, period: long>>"
ADDED = f"n_words long, runs {RUN}, collapsed binary"


def doubling(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks by prefix doubling: entry k ranks the 2**k symbols from each place; the last one has no ties.

    The ranks keep suffix order. Only places that still share a rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    change = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(change)[np.cumsum(change) - 1]
    levels = [rank]
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            return levels
        ahead = tied + (1 << (len(levels) - 1))
        follows = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + follows
        order = np.argsort(key, kind="stable")
        tied, key, old = tied[order], key[order], rank[tied[order]]
        at = np.arange(len(tied))
        first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        first_new = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank = rank.copy()
        rank[tied] = old + first_new - first_old
        levels.append(rank)


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by the ranks of doubling."""
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        size += (levels[k][a + size] == levels[k][b + size]).astype(np.int64) << k
    return size


def kruskal(left: np.ndarray, right: np.ndarray, lcp: np.ndarray, symbols: np.ndarray, least: int = LEAST):
    """Runs (start, length, period) out of suffix neighbours with their LCP; a symbol precedes every position."""
    places = np.unique(np.concatenate([left, right]))
    order = np.argsort(-lcp, kind="stable")
    edges = zip(np.searchsorted(places, left[order]).tolist(), np.searchsorted(places, right[order]).tolist(),
                lcp[order].tolist())
    place, ahead = places.tolist(), symbols[places - 1].tolist()
    parent, classes = list(range(len(place))), [[k] for k in range(len(place))]
    found = []

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def adjacent(i, j, size):
        gap = place[j] - place[i]
        if gap <= size and gap + size >= least and ahead[i] != ahead[j]:
            found.append((place[i], gap + size, gap))

    for a, b, size in edges:
        a, b = top(a), top(b)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        many, few = classes[a], classes[b]
        parent[b], classes[b] = a, None
        for k, x in enumerate(few):
            at = bisect_left(many, x)
            if at and (not k or few[k - 1] < many[at - 1]):
                adjacent(many[at - 1], x, size)
            if at < len(many) and (k + 1 == len(few) or many[at] < few[k + 1]):
                adjacent(x, many[at], size)
        if len(few) * 8 < len(many):
            for x in few:
                insort(many, x)
        else:
            many += few
            many.sort()
    return found


def runs_of(texts: list[bytes], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) in words, by start and period."""
    out = [[] for _ in texts]
    data, offsets = joined(texts)
    starts, ends = word_spans(data)
    if not len(starts):
        return out
    words = word_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = words ^ mix(owner.astype(np.uint64), 17)  # the same word of another text is another symbol
    # A run has words i to i+g equal to those a period later, g = least/2 or more: texts without such a repeat have none.
    gram = (least + 1) // 2
    grams = window_hashes(words, gram)
    inside = owner[:len(grams)] == owner[gram - 1:gram - 1 + len(grams)] if len(grams) else np.empty(0, bool)
    ranked = np.flatnonzero(inside)
    ranked = ranked[np.argsort(grams[ranked], kind="stable")]
    twice = grams[ranked[1:]] == grams[ranked[:-1]]
    suspects = np.unique(owner[ranked[1:][twice]])
    chosen = np.flatnonzero(np.isin(owner, suspects))
    if not len(chosen):
        return out
    # One symbol per word and text, and one of its own before the first word and after each text.
    own = owner[chosen]
    text_at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    number = np.cumsum(np.isin(np.arange(len(chosen)), text_at))
    symbols = np.empty(len(chosen) + len(text_at) + 1, np.int64)
    names, codes = np.unique(words[chosen], return_inverse=True)
    spot = np.arange(len(chosen)) + number
    symbols[spot] = codes
    marks = np.append(text_at + np.arange(len(text_at)), len(symbols) - 1)
    symbols[marks] = len(names) + np.arange(len(marks))
    levels = doubling(symbols)
    suffixes = np.empty(len(symbols), np.int64)
    suffixes[levels[-1]] = np.arange(len(symbols))
    lcp = common_prefixes(levels, suffixes[:-1], suffixes[1:])
    far = lcp >= gram
    del levels
    for start, length, period in kruskal(suffixes[:-1][far], suffixes[1:][far], lcp[far], symbols, least):
        k = int(np.searchsorted(marks, start, "right")) - 1
        out[int(own[text_at[k]])].append((start - int(marks[k]) - 1, length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside all runs or in the first period of every run that holds them, joined by a space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def _batches(batches, position, least, shape):
    for batch in batches:
        texts = [t or b"" for t in binary_values(batch.column(position))]
        for a, b in slices(texts):
            words = [t.split() for t in texts[a:b]]
            runs = runs_of(texts[a:b], least)
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            kept = [collapsed(w, r) for w, r in zip(words, runs)]
            columns = [[len(w) for w in words], listed, kept]
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(a, b - a).columns, *(pa.array(c, f.type) for c, f in zip(columns, shape))],
                names=[*batch.schema.names, *(f.name for f in shape)])


SHAPE = (pa.field("n_words", pa.int64()),
         pa.field("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
         pa.field("collapsed", pa.binary()))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of `docs` with n_words, the runs of each text and the text without repeated periods.

    A word is a run of bytes other than 0x20 and 0x09-0x0D, compared byte by byte. A run is a
    stretch of words with smallest period q and at least max(least, 2 q) words that cannot be
    extended; runs are listed by start (a word number from 0) and period. `collapsed` (UTF-8) holds
    the words that no run repeats, joined by one space. NULL and empty texts have no words and no
    runs; repeated rows are judged one by one; ids take no part. Input columns with the name of an
    added one are replaced. One narrow pass: a task holds one batch of texts and the suffix ranks of
    about 4 MB of text, or of one longer text.
    """
    names = other_columns(docs, "n_words", "runs", "collapsed")
    plain = docs.select(*quoted(names))
    schema = T.StructType(extended(plain, ADDED).fields)
    position = names.index(text)
    return plain.mapInArrow(lambda batches: _batches(batches, position, least, SHAPE), schema)
