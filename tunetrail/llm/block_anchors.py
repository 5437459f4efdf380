"""Repeated word windows by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; the blocks are
indexed by their hash and probed with the hash of every rolling block of every document. Any window
that two documents share holds a whole reference block of the one, found at its place in the other.
Around the hits the full windows are compared by a 96-bit hash, the smallest document of each is
found, and overlapping windows grow to maximal repeats.

Documents are dealt into parts by hash. A part sends each bucket of the hash range one message with
its distinct hashes, and gets back those that matter, so a passage of any number of documents
reaches its bucket once for each part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import (binary_values, bucket_cuts, found, from_planes, id_values, in_parts, joined,
                                  mix, owned, parts_for, planes, runs, text_bytes, window_hashes, word_hashes, word_spans)

#: Words of a window.
WINDOW = 50
SPAN = "array<struct<start: long, end: long>>"


class Words:
    """Word hashes of the texts of a part, one after the other."""

    def __init__(self, table: pa.Table):
        self.ids = id_values(table["doc_id"])
        self.texts = [t or b"" for t in binary_values(table["text"])]
        data, offsets = joined(self.texts)
        starts, ends = word_spans(data)
        self.codes = word_hashes(data, starts, ends)
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word, and whether it lies in one document."""
        hashes = window_hashes(self.codes, length)
        return hashes, self.doc[:len(hashes)] == self.doc[length - 1:]

    def anchors(self, block: int):
        """Top 48 bits of the rolling block hashes, which are whole, and which are reference blocks."""
        hashes, whole = self.windows(block)
        place = np.arange(len(hashes)) - self.first[self.doc[:len(hashes)]]
        return hashes >> np.uint64(16), whole, whole & (place % block == 0)


def _probe(block, buckets):
    """Message rows (bucket, part, high, low, flags): distinct block hashes of a part by bucket."""

    def run(table: pa.Table) -> pa.Table:
        words = Words(table)
        codes, whole, reference = words.anchors(block)
        at = np.flatnonzero(whole)
        order = at[np.argsort(codes[at], kind="stable")]
        ranked = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else at
        doc = words.doc[order]
        shared = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts) if len(starts) else starts > 0
        indexed = np.logical_or.reduceat(reference[order], starts) if len(starts) else starts > 0
        unique = ranked[starts]
        cuts = bucket_cuts(unique << np.uint64(16), buckets)
        part, rows = table["part"][0].as_py(), []
        for b in range(buckets):
            low, high = cuts[b], cuts[b + 1]
            if low < high:
                rows.append({"bucket": b, "part": part, "high": planes((unique[low:high] >> np.uint64(32)).astype(np.uint16)),
                             "low": (unique[low:high] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                             "flags": np.packbits(np.stack([indexed[low:high], shared[low:high]])).tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("high", pa.binary()),
                                                     ("low", pa.binary()), ("flags", pa.binary())]))

    return run


MESSAGE = "bucket int, part int, high binary, low binary, flags binary"
REPLY = "part int, codes binary, checks binary, least binary"
REPLY_SCHEMA = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("checks", pa.binary()), ("least", pa.binary())])


def _index(table: pa.Table) -> pa.Table:
    """Block hashes that are indexed and occur in two documents or more, for each part that has them."""
    parts, codes, flags, owner = table["part"].to_pylist(), [], [], []
    for k, (high, low, flag) in enumerate(zip(*(table[c].to_pylist() for c in ("high", "low", "flags")))):
        low = np.frombuffer(low, np.uint32).astype(np.uint64)
        codes.append(from_planes(high, np.uint16).astype(np.uint64) << np.uint64(32) | low)
        flags.append(np.unpackbits(np.frombuffer(flag, np.uint8), count=2 * len(low)).reshape(2, -1).astype(bool))
        owner.append(np.full(len(low), k, np.int32))
    codes, flags, owner = np.concatenate(codes), np.concatenate(flags, axis=1), np.concatenate(owner)
    order = np.argsort(codes, kind="stable")
    codes, flags, owner = codes[order], flags[:, order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.append(starts, len(codes)))
    hit = np.logical_or.reduceat(flags[0], starts) & ((sizes > 1) | np.logical_or.reduceat(flags[1], starts))
    hits = np.repeat(hit, sizes)
    rows = [{"part": parts[k], "codes": own.tobytes()} for k, (own,) in owned(owner[hits], codes[hits])]
    return pa.Table.from_pylist(rows, REPLY_SCHEMA)


def _windows_of(words, replies, window, block):
    """Hash, check and validity of every window that holds an anchor hit."""
    codes, whole, _ = words.anchors(block)
    known = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in replies)]))
    hit = np.concatenate([[0], np.cumsum(whole & found(codes, known)[0])])
    hashes, inside = words.windows(window)
    n = len(hashes)
    reach = window - block + 1
    near = inside & (hit[reach:reach + n] > hit[:n]) if n else inside
    at = np.flatnonzero(near)
    return at, hashes[at]


def _check(words, at, window):
    """A second, 32-bit hash of the windows at the given places."""
    return (window_hashes(mix(words.codes, 5), window)[at] >> np.uint64(32)).astype(np.uint32)


def _extend(window, block, buckets):
    """Message rows: distinct windows around the hits of a part, with their smallest document."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        shape = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()),
                           ("flags", pa.binary())])
        if not len(docs) or not len(replies):
            return shape.empty_table()
        words = Words(docs)
        at, hashes = _windows_of(words, replies["codes"].to_pylist(), window, block)
        if not len(at):
            return shape.empty_table()
        check, ids = _check(words, at, window), words.ids[words.doc[at]]
        order = np.lexsort((check, hashes))
        hashes, check, ids = hashes[order], check[order], ids[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])])
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids, starts)
        several = np.maximum.reduceat(ids, starts) != least
        hashes, check = hashes[starts], check[starts]
        cuts = bucket_cuts(hashes, buckets)
        rows = []
        for b in range(buckets):
            low, high = cuts[b], cuts[b + 1]
            if low < high:
                rows.append({"bucket": b, "part": docs["part"][0].as_py(), "high": planes(hashes[low:high]),
                             "low": check[low:high].tobytes() + planes(least[low:high]),
                             "flags": np.packbits(several[low:high]).tobytes()})
        return pa.Table.from_pylist(rows, shape)

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """The smallest document of each window, for every part with a larger one."""
    parts, columns = table["part"].to_pylist(), [[], [], [], [], []]
    for k, (high, low, flag) in enumerate(zip(*(table[c].to_pylist() for c in ("high", "low", "flags")))):
        code = from_planes(high, np.uint64)
        n = len(code)
        for column, values in zip(columns, (code, np.frombuffer(low[:4 * n], np.uint32), from_planes(low[4 * n:], np.int64),
                                            np.unpackbits(np.frombuffer(flag, np.uint8), count=n).astype(bool),
                                            np.full(n, k, np.int32))):
            column.append(values)
    code, check, own, several, owner = (np.concatenate(c) for c in columns)
    order = np.lexsort((check, code))
    code, check, own, several, owner = (x[order] for x in (code, check, own, several, owner))
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (check[1:] != check[:-1])]))
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(code))))
    told = (own > least) | several
    rows = [{"part": parts[k], "codes": planes(a), "checks": b.tobytes(), "least": planes(c)}
            for k, (a, b, c) in owned(owner[told], code[told], check[told], least[told])]
    return pa.Table.from_pylist(rows, REPLY_SCHEMA)


def _remove(window):
    """Spans covered by windows that a smaller document has too, and the words that are left."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        words = Words(docs)
        covered = np.zeros(len(words.codes), bool)
        if len(replies) and len(docs):
            parts = [replies[c].to_pylist() for c in ("codes", "checks", "least")]
            code = np.concatenate([from_planes(x, np.uint64) for x in parts[0]])
            check = np.concatenate([np.frombuffer(x, np.uint32) for x in parts[1]])
            least = np.concatenate([from_planes(x, np.int64) for x in parts[2]])
            order = np.argsort(code, kind="stable")
            code, check, least = code[order], check[order], least[order]
            hashes, inside = words.windows(window)
            at = np.flatnonzero(inside & found(hashes, code)[0])
            own, ids = _check(words, at, window), words.ids[words.doc[at]]
            low, removed = np.searchsorted(code, hashes[at]), np.zeros(len(at), bool)
            step = 0
            while True:  # equal first hashes are next to each other
                place = low + step
                live = place < len(code)
                live[live] = code[place[live]] == hashes[at][live]
                if not live.any():
                    break
                removed[live] |= (check[place[live]] == own[live]) & (least[place[live]] < ids[live])
                step += 1
            grown = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(grown, at[removed], 1)
            np.add.at(grown, at[removed] + window, -1)
            covered = np.cumsum(grown[:-1]) > 0
        spans, kept = [], []
        for k, text in enumerate(words.texts):
            first, last = words.first[k], words.first[k + 1]
            low, high = runs(covered[first:last])
            spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())])
            parts = text.split()
            if len(low):
                edges = [0, *np.column_stack([low, high]).ravel().tolist(), len(parts)]
                parts = [w for a, b in zip(edges[0::2], edges[1::2]) for w in parts[a:b]]
            kept.append(b" ".join(parts).decode())
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(np.diff(words.first), pa.int64()),
                         "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept_text": pa.array(kept, pa.string())})

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, removed, kept_text) of every row of `docs` (doc_id, text).

    Removed are the words covered by a window of `window` consecutive words whose sequence also
    starts in a row with a smaller doc_id; spans count words, kept words are joined by a space.
    Windows are judged on the input. NULL and empty texts have no words; a NULL id is larger than
    any other; rows with the same id do not remove from each other. Other columns are left out.
    Runs one job for the size of the texts.
    """
    total = text_bytes(docs)
    count, block = parts_for(total), window // 2
    rows = in_parts(docs, count)
    parts = rows.groupBy("part")
    hits = parts.applyInArrow(_probe(block, count), MESSAGE).groupBy("bucket").applyInArrow(_index, REPLY)
    wide = parts.cogroup(hits.groupBy("part")).applyInArrow(_extend(window, block, count), MESSAGE)
    answers = wide.groupBy("bucket").applyInArrow(_smallest, REPLY)
    return parts.cogroup(answers.groupBy("part")).applyInArrow(
        _remove(window), f"doc_id long, n_words long, removed {SPAN}, kept_text string")


def removed_length(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
