"""Suffix arrays by grouping on Lyndon prefixes, and substring dedup with them.

`suffix_array` works in two linear phases without renaming: suffixes are grouped by their Lyndon
prefix, groups taken in descending order through previous-smaller pointers, then every group's
order is emitted from left to right along the same pointers.

`drop_substrings` finds repeated strings of a fixed length in a corpus. The smallest gram of each
window anchors it; windows that share an anchor gram meet in one bucket as context strings, and one
suffix array over contexts of a bucket tells which windows recur. Its alphabet is content-cut
tokens, so the array is many times shorter than the text; where a context lacks cuts the alphabet
gets finer, down to bytes. Grams with very many occurrences skip the contexts: their windows are
counted by a 96-bit hash, so that no task gets all documents that share a passage.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import (SPACE, binary_values, bucket_cuts, found, from_planes, in_parts, joined, mix, owned,
                                  parts_for, planes, powers, prefix_sums, runs, text_bytes, window_hashes)

#: Bytes of a repeated string, of an anchor gram.
LENGTH, GRAM = 400, 48
#: Occurrences from which a gram's windows are counted by hash.
FREQUENT = 2048
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20
#: A cut follows a space byte with no other among so many bytes before it; -1: every byte is cut off.
CALM = (11, 5, 0, -1)
SPAN = "array<struct<start: long, end: long>>"


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes; the last symbol is the smallest and occurs once."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n
    start = 0
    for k, s in enumerate(order):
        if symbols[s] != symbols[order[start]]:
            start = k
        place[s], group[s], last[start] = k, start, k
    before = _lyndon_groups(n, order, place, group, last)
    return _emit(n, group, before)


def _lyndon_groups(n, order, place, group, last):
    """Refine groups to Lyndon prefixes; returns each suffix's previous smaller one (-1: none)."""
    before = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        members = order[start:end + 1]
        if end > start:
            members.sort()
        pointed = {}
        for j in members:
            p = j - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            if p >= 0 and group[p] == start:
                p = before[p]
            before[j] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            batches = [list(pointed)]
        else:
            levels = {}
            for p, times in pointed.items():
                levels.setdefault(times, []).append(p)
            batches = [levels[k] for k in sorted(levels, reverse=True)]
        for batch in batches:
            stops = {}
            for p in batch:
                g = group[p]
                if last[g] == g:
                    continue
                e = last[g] if g not in stops else stops[g][1]
                if g not in stops:
                    stops[g] = [e, e, []]
                at, other = place[p], order[e]
                order[at], order[e] = other, p
                place[other], place[p] = at, e
                stops[g][1] = e - 1
                stops[g][2].append(p)
            for g, (old, new, moved) in stops.items():
                if new >= g:
                    last[g], last[new + 1] = new, old
                    for p in moved:
                        group[p] = new + 1
        end = start - 1
    return before


def _emit(n, group, before):
    """Place suffixes from left to right: each placed one places its left neighbour's chain."""
    out, free = [-1] * n, list(range(n))
    done = bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    free[0] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out


class Anchors:
    """Anchors of a part's texts: place x, the windows lo..hi it anchors, its document and gram hash."""

    BLOCK, BITS = 1 << 18, 20

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length = length
        self.texts = [t or b"" for t in binary_values(table["text"])]
        self.data, self.offsets = joined(self.texts)
        count = length - gram + 1
        parts = [[], [], [], []]
        low_bits = np.uint64((1 << self.BITS) - 1)
        for s in range(0, len(self.data) - length + 1, self.BLOCK):
            segment = self.data[s:s + self.BLOCK + length - 1]
            codes = window_hashes(segment, gram)
            keys = (codes & ~low_bits) | np.arange(len(codes), dtype=np.uint64)
            n = len(segment) - length + 1
            pad = -len(keys) % count
            rows = np.concatenate([keys, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, count)
            left = np.minimum.accumulate(rows, axis=1).ravel()
            right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            least = (np.minimum(right[:n], left[count - 1:count - 1 + n]) & low_bits).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            for part, values in zip(parts, (least[starts] + s, starts + s, np.append(starts[1:], n) - 1 + s,
                                            codes[least[starts]])):
                part.append(values)
        x, lo, hi, code = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
        if len(x):
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            x, lo, hi, code = x[starts], lo[starts], hi[np.append(starts[1:], len(x)) - 1], code[starts]
        doc = np.searchsorted(self.offsets, x, "right") - 1
        lo = np.maximum(lo, self.offsets[doc])
        hi = np.minimum(hi, self.offsets[doc + 1] - 1 - length) if len(x) else hi
        good = lo <= hi
        self.x, self.lo, self.hi, self.doc = x[good], lo[good], hi[good], doc[good]
        self.code = mix(code[good].astype(np.uint64), 21)  # minima are small: spread them over the buckets again

    def context(self, k: int) -> bytes:
        return self.data[self.lo[k]:self.hi[k] + self.length].tobytes()

    def windows(self, chosen: np.ndarray):
        """Starts of all windows of the chosen anchors, their hash and a second 32-bit hash."""
        sizes = self.hi[chosen] - self.lo[chosen] + 1
        starts = np.repeat(self.lo[chosen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        code, check = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint32)
        order = np.argsort(starts, kind="stable")
        ranked = starts[order]
        for s in range(0, len(self.data), self.BLOCK):
            a, b = np.searchsorted(ranked, (s, s + self.BLOCK))
            if a < b:
                segment = self.data[s:s + self.BLOCK + self.length - 1]
                at, into = ranked[a:b] - s, order[a:b]
                code[into] = window_hashes(segment, self.length)[at]
                check[into] = window_hashes(mix(segment.astype(np.uint64), 9), self.length)[at] >> np.uint64(32)
        return starts, code, check


GRAMS = "bucket int, part int, codes binary, counts binary"
HITS = "part int, rare binary, frequent binary"
CONTEXTS = ("bucket int, part int, code long, digest binary, several boolean, context binary, codes binary, checks binary,"
            " grams binary")
ANSWER = "part int, digest binary, spans binary, codes binary, checks binary, grams binary"


ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl):
    """Arrow schema of a flat DDL string."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in ddl.split(","))])


def _grams(length, gram, buckets, shape):
    """Message rows: the distinct anchor grams of a part with their number of occurrences, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        anchors = Anchors(table, length, gram)
        codes, counts = np.unique(anchors.code, return_counts=True)
        cuts = bucket_cuts(codes, buckets)
        part = table["part"][0].as_py()
        return pa.Table.from_pylist(
            [{"bucket": b, "part": part, "codes": planes(codes[cuts[b]:cuts[b + 1]]),
              "counts": planes(counts[cuts[b]:cuts[b + 1]].astype(np.uint32))}
             for b in range(buckets) if cuts[b] < cuts[b + 1]], shape)

    return run


def _repeated_grams(frequent, shape):
    """Grams that occur twice or more, told to every part that has them."""

    def run(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        codes = [from_planes(c, np.uint64) for c in table["codes"].to_pylist()]
        counts = np.concatenate([from_planes(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(c) for c in codes])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        codes, counts, owner = codes[order], counts[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        total = np.repeat(np.add.reduceat(counts, starts), np.diff(np.append(starts, len(codes))))
        many, few = total >= frequent, (total > 1) & (total < frequent)
        rows = {}
        for name, mask in (("rare", few), ("frequent", many)):
            for k, (own,) in owned(owner[mask], codes[mask]):
                rows.setdefault(k, {"part": parts[k], "rare": b"", "frequent": b""})[name] = own.tobytes()
        return pa.Table.from_pylist(list(rows.values()), shape)

    return run


def _hits(table, name):
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in table[name].to_pylist())]))


def _contexts(length, gram, buckets, shape):
    """Rows of distinct contexts of the rarer grams, and messages with the windows of frequent ones."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(docs) or not len(hits):
            return shape.empty_table()
        anchors, part = Anchors(docs, length, gram), docs["part"][0].as_py()
        rows, seen = [], {}
        chosen = np.flatnonzero(found(anchors.code, _hits(hits, "rare"))[0])
        for k in chosen.tolist():
            context = anchors.context(k)
            digest = hashlib.blake2b(context, digest_size=16).digest()
            code = int(anchors.code[k])
            if (code, digest) in seen:
                seen[code, digest]["several"] = True
                continue
            seen[code, digest] = row = {"bucket": (code * buckets) >> 64, "part": part, "digest": digest, "several": False,
                                        "code": code - (1 << 64) if code >> 63 else code, "context": context}
            rows.append(row)
        frequent = _hits(hits, "frequent")
        chosen = np.flatnonzero(found(anchors.code, frequent)[0])
        if len(chosen):
            rows.append({"bucket": part % buckets, "part": part, "grams": frequent.tobytes()})
            _, code, check = anchors.windows(chosen)
            order = np.lexsort((check, code))
            code, check = code[order], check[order]
            starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (check[1:] != check[:-1])]))
            several = np.diff(np.append(starts, len(code))) > 1
            code, check = code[starts], check[starts]
            cuts = bucket_cuts(code, buckets)
            for b in range(buckets):
                low, high = cuts[b], cuts[b + 1]
                if low < high:
                    rows.append({"bucket": b, "part": part, "codes": planes(code[low:high]),
                                 "checks": check[low:high].tobytes() + np.packbits(several[low:high]).tobytes()})
        return pa.Table.from_pylist(rows, shape)

    return run


def cuts_of(data: np.ndarray, offsets: np.ndarray, calm: int) -> np.ndarray:
    """Cuts inside each context that its own bytes decide: `calm` + 1 bytes before a cut tell."""
    if calm < 0:
        inside = np.ones(len(data), bool)
        inside[offsets[1:] - 1] = False
        return np.flatnonzero(inside)
    space = np.concatenate([[0], np.cumsum(SPACE[data])])
    at = np.flatnonzero(SPACE[data]) + 1
    owner = np.searchsorted(offsets, at - 1, "right") - 1
    good = (at - 1 - calm >= offsets[owner]) & (at < offsets[owner + 1] - 1)
    at = at[good]
    return at[space[at - 1] == space[at - 1 - calm]]


def well_cut(data: np.ndarray, offsets: np.ndarray, length: int, calm: int) -> np.ndarray:
    """For each context, whether every window of it has a cut that the window's own bytes decide."""
    if calm < 0:
        return np.ones(len(offsets) - 1, bool)
    cut = cuts_of(data, offsets, calm)
    marks = np.sort(np.concatenate([cut, offsets[:-1] + calm, offsets[1:] + 1 + calm]))
    gap = np.diff(marks)
    owner = np.searchsorted(offsets, marks[:-1] - calm, "right") - 1
    widest = np.zeros(len(offsets) - 1, np.int64)
    inside = marks[1:] <= offsets[np.minimum(owner + 1, len(offsets) - 1)] + 1 + calm
    np.maximum.at(widest, owner[inside], gap[inside])
    return widest <= length - calm - 2


def repeated_windows(contexts: list[bytes], length: int, calm: int) -> list[np.ndarray]:
    """For each context a mask of its windows that occur in another one, from one suffix array."""
    data, offsets = joined(contexts)
    ends = offsets[1:] - 1
    cut, calm = cuts_of(data, offsets, calm), calm + 1
    owner = np.searchsorted(offsets, cut, "right") - 1
    stop = np.minimum(np.append(cut[1:], len(data)), ends[owner])
    raw = data.tobytes()
    tokens = [raw[a:b] for a, b in zip(cut.tolist(), stop.tolist())]
    ranks = {t: r for r, t in enumerate(sorted(set(tokens)), 2)}
    symbols, places, now = [], [], 0
    for k, (token, own) in enumerate(zip(tokens, owner.tolist())):
        if own != now:
            symbols.append(1)
            places.append(-1)
            now = own
        symbols.append(ranks[token])
        places.append(k)
    symbols.append(0)
    places.append(-1)
    order = np.array(places)[suffix_array(symbols)]
    order = order[order >= 0]
    start, room = cut[order], ends[owner[order]] - cut[order]
    sums, (_, unscale) = prefix_sums(data.astype(np.uint64) + np.uint64(1)), powers(len(data) + 1)
    piece = lambda at, size: (sums[at + size] - sums[at]) * unscale[at]
    low = np.zeros(max(0, len(order) - 1), np.int64)
    high = np.minimum(np.minimum(room[1:], room[:-1]), length)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = piece(start[1:], middle) == piece(start[:-1], middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    common = np.concatenate([[0], low])
    rank = np.empty(len(cut), np.int64)
    rank[order] = np.arange(len(order))
    sizes = ends - offsets[:-1] - length + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    window = np.repeat(offsets[:-1] - first[:-1], sizes) + np.arange(first[-1])
    head = np.searchsorted(cut, window + calm)
    lead = cut[np.minimum(head, len(cut) - 1)] - window
    keys = np.empty(len(window), np.uint64)
    by_lead = np.argsort(lead, kind="stable")
    levels, begins = np.unique(lead[by_lead], return_index=True)
    for size, a, b in zip(levels.tolist(), begins, np.append(begins[1:], len(window))):
        mine = by_lead[a:b]
        interval = np.cumsum(common < length - size)[rank[head[mine]]]
        left = piece(window[mine], size)
        keys[mine] = mix(mix(left, 1) ^ mix((interval + (size << 40)).astype(np.uint64), 2), 3)
    ranked = np.argsort(keys, kind="stable")
    twin = keys[ranked][1:] == keys[ranked][:-1]
    repeated = np.zeros(len(window), bool)
    repeated[ranked[1:][twin]] = True
    repeated[ranked[:-1][twin]] = True
    return [repeated[a:b] for a, b in zip(first[:-1], first[1:])]


def _batches(groups, size):
    """Entries of whole groups, about `size` bytes of contexts at a time."""
    batch, weight = [], 0
    for group in groups:
        batch += group
        weight += sum(len(entry[1]) for entry in group)
        if weight >= size:
            yield batch
            batch, weight = [], 0
    if batch:
        yield batch


def _mark(length, shape):
    """Answers of a bucket: spans of repeated windows by context, and repeated frequent windows, by part."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        columns = [table[c].to_pylist() for c in ("part", "code", "digest", "several", "context")]
        groups = {}
        for part, code, digest, several, context in zip(*columns):
            if code is not None:
                entry = groups.setdefault(code, {}).setdefault(digest, [context, [], False])
                entry[1].append(part)
                entry[2] |= several
        left = []
        for entries in groups.values():
            for digest, (context, parts, several) in entries.items():
                if several or len(parts) > 1:
                    spans = np.array([0, len(context) - length + 1], np.int32).tobytes()
                    rows += [{"part": p, "digest": digest, "spans": spans} for p in parts]
            if len(entries) > 1 and any(len(e[1]) == 1 and not e[2] for e in entries.values()):
                left.append([(digest, *entry) for digest, entry in entries.items()])
        for calm in CALM:
            if not left:
                break
            sizes = np.array([len(group) for group in left])
            data, offsets = joined([entry[1] for group in left for entry in group])
            fits = np.logical_and.reduceat(well_cut(data, offsets, length, calm), np.cumsum(sizes) - sizes)
            for batch in _batches([group for group, fit in zip(left, fits) if fit], ARRAY_BYTES if calm >= 0 else ARRAY_BYTES // 8):
                masks = repeated_windows([entry[1] for entry in batch], length, calm)
                for (digest, context, parts, several), mask in zip(batch, masks):
                    if len(parts) == 1 and not several and mask.any():
                        spans = np.column_stack(runs(mask)).astype(np.int32).tobytes()
                        rows.append({"part": parts[0], "digest": digest, "spans": spans})
            left = [group for group, fit in zip(left, fits) if not fit]
        rows += [{"part": p, "grams": g} for p, g in zip(columns[0], table["grams"].to_pylist()) if g]
        packed = [(p, from_planes(c, np.uint64), k) for p, c, k in zip(
            columns[0], table["codes"].to_pylist(), table["checks"].to_pylist()) if c]
        if packed:
            owner = np.repeat(np.arange(len(packed)), [len(c) for _, c, _ in packed])
            code = np.concatenate([c for _, c, _ in packed])
            check = np.concatenate([np.frombuffer(k[:4 * len(c)], np.uint32) for _, c, k in packed])
            several = np.concatenate([np.unpackbits(np.frombuffer(k[4 * len(c):], np.uint8), count=len(c))
                                      for _, c, k in packed]).astype(bool)
            order = np.lexsort((check, code))
            code, check, several, owner = code[order], check[order], several[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (check[1:] != check[:-1])]))
            sizes = np.diff(np.append(starts, len(code)))
            twice = np.repeat((sizes > 1) | np.logical_or.reduceat(several, starts), sizes)
            for k, (own, other) in owned(owner[twice], code[twice], check[twice]):
                rows.append({"part": packed[k][0], "codes": planes(own), "checks": other.tobytes()})
        return pa.Table.from_pylist(rows, shape)

    return run


def _cut_out(length, gram):
    """Removed spans and remaining bytes of every text of a part."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [t or b"" for t in binary_values(docs["text"])]
        removed = [[] for _ in texts]
        if len(answers) and len(docs):
            anchors = Anchors(docs, length, gram)
            starts = []
            spans = {d: np.frombuffer(s, np.int32).reshape(-1, 2) for d, s in zip(
                answers["digest"].to_pylist(), answers["spans"].to_pylist()) if d}
            packed = [(from_planes(c, np.uint64), np.frombuffer(k, np.uint32)) for c, k in zip(
                answers["codes"].to_pylist(), answers["checks"].to_pylist()) if c]
            if spans:
                for k in range(len(anchors.x)):
                    size = anchors.hi[k] - anchors.lo[k] + 1
                    own = spans.get(hashlib.blake2b(anchors.context(k), digest_size=16).digest())
                    if own is not None:
                        starts.append(np.column_stack([own[:, 0], np.minimum(own[:, 1], size)]) + anchors.lo[k])
            if packed:
                known = np.concatenate([c for c, _ in packed])
                checks = np.concatenate([k for _, k in packed])
                pairs = np.sort(mix(known, 11) ^ checks.astype(np.uint64))
                grams = np.sort(np.concatenate([np.frombuffer(g, np.uint64) for g in answers["grams"].to_pylist() if g]))
                at, code, check = anchors.windows(np.flatnonzero(found(anchors.code, grams)[0]))
                hit = found(mix(code, 11) ^ check.astype(np.uint64), pairs)[0]
                starts.append(np.column_stack([at[hit], at[hit] + 1]))
            if starts:
                spans = np.concatenate(starts)
                grown = np.zeros(len(anchors.data) + 1, np.int32)
                np.add.at(grown, spans[:, 0], 1)
                np.add.at(grown, spans[:, 1] + length - 1, -1)
                low, high = runs(np.cumsum(grown[:-1]) > 0)
                doc = np.searchsorted(anchors.offsets, low, "right") - 1
                for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist()):
                    removed[d].append((a - int(anchors.offsets[d]), b - int(anchors.offsets[d])))
        kept = []
        for text, spans in zip(texts, removed):
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
        listed = [[{"start": a, "end": b} for a, b in spans] for spans in removed]
        return pa.table({"doc_id": docs["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                         "removed": pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary())})

    return run


def drop_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_bytes, removed, kept) of every row of `docs` (doc_id, text).

    Removed are the bytes covered by a string of `length` bytes that also starts at another place of
    any row, the same one included; strings do not cross rows and are judged on the input. Spans
    count bytes; kept is binary, as a cut may fall inside a character. NULL is an empty text; ids
    may be NULL or repeat. Other columns are left out. Runs one job for the size of the texts.
    """
    buckets = parts_for(text_bytes(docs))
    parts = in_parts(docs, buckets).groupBy("part")
    hits = (parts.applyInArrow(_grams(length, gram, buckets, _schema(GRAMS)), GRAMS)
            .groupBy("bucket").applyInArrow(_repeated_grams(frequent, _schema(HITS)), HITS))
    contexts = parts.cogroup(hits.groupBy("part")).applyInArrow(
        _contexts(length, gram, buckets, _schema(CONTEXTS)), CONTEXTS)
    answers = contexts.groupBy("bucket").applyInArrow(_mark(length, _schema(ANSWER)), ANSWER)
    return parts.cogroup(answers.groupBy("part")).applyInArrow(
        _cut_out(length, gram), f"doc_id long, n_bytes long, removed {SPAN}, kept binary")
