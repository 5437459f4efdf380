"""Benchmark passages in documents, small edits included.

An item with an error budget of k edits is cut into k + 1 pieces: a passage within the budget holds
one piece unchanged. The pieces are searched with one automaton, and each region that a piece hit
points to is verified with the bit-parallel edit distance of Myers.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetrail.llm.shared import extended, free_name, other_columns, quoted

#: Edits allowed for each character of an item, and the least length of a piece.
RATE, PIECE = 0.1, 16
#: Characters of items that one pass over the documents searches for.
BLOCK_CHARS = 4 << 20
HIT = "array<struct<item_id: long, distance: int, start: int, end: int>>"


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE, piece: int = PIECE) -> int:
    """Edits allowed: `rate` of the length, fewer where pieces would get shorter than `piece`."""
    return max(0, min(int(rate * length), length // piece - 1))


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces that cover the item."""
    at = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def best_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of the text, and the first end that has it."""
    size = len(item)
    full, high, masks = (1 << size) - 1, 1 << size - 1, {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    plus, minus, score = full, 0, size
    best, end = size, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        up, down = (minus | ~(d0 | plus)) & full, plus & d0
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(d0 | up)) & full, up & d0
        if score < best:
            best, end = score, k
    return best, end


class Items:
    """Automaton over the pieces of the items, with their budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float, piece: int):
        self.items, pieces = [], {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            edits = budget(len(text), rate, piece)
            for offset, part in cut(text, edits):
                pieces.setdefault(part, []).append((len(self.items), offset))
            self.items.append((item_id, text, edits))
        self.automaton = ahocorasick.Automaton()
        for part, places in pieces.items():
            self.automaton.add_word(part, (len(part), places))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict]:
        """The best match within the budget of each item that has one; the first of equally good ones."""
        if not self.items:
            return []
        text, tried, best = normal(text), {}, {}
        for last, (size, places) in self.automaton.iter(text):
            for number, offset in places:
                item_id, item, edits = self.items[number]
                first = last + 1 - size - offset
                done = tried.get(number)
                if done and done[0] <= first - edits and first + len(item) + edits <= done[1]:
                    continue
                low, high = max(0, first - 2 * edits), first + len(item) + 2 * edits
                tried[number] = (first - 2 * edits, high)
                distance, end = best_end(item, text[low:high])
                if distance <= edits and (number not in best or distance < best[number][0]):
                    best[number] = (distance, low, low + end)
        out = []
        for number, (distance, low, end) in sorted(best.items()):
            item_id, item, _ = self.items[number]
            _, back = best_end(item[::-1], text[low:end][::-1])
            out.append({"item_id": item_id, "distance": distance, "start": end - back, "end": end})
        return out


def _match(batches, position, items, rate, piece, kind, name):
    matcher = Items(items, rate, piece)
    for batch in batches:
        hits = [matcher.hits(text) if text else [] for text in batch.column(position).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=[*batch.schema.names, name])


def match_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, piece: int = PIECE,
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of `docs` and `hits`: item_id, distance, start, end of each item within its budget.

    Positions are in the text with lower case and single spaces. NULL and empty texts and items
    match nothing; repeated items give a hit each; an item with a NULL id gives hits with a NULL
    id. Items are taken in blocks of about `block_chars` characters, each block in a pass of its
    own, so what tasks hold does not grow with the benchmark. An input column `hits` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = other_columns(docs, "hits")
    more = free_name(docs, "_hits")
    shape = T.StructType.fromDDL(f"h {HIT}")["h"].dataType
    kind = to_arrow_type(shape)
    out = docs.select(*quoted(names), F.array().cast(shape).alias("hits"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    position = names.index(text)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        schema = extended(out, f"{more} {HIT}")
        out = out.mapInArrow(lambda batches, items=items: _match(batches, position, items, rate, piece, kind, more), schema)
        out = out.select(*quoted(names), F.concat("hits", more).alias("hits"))
    return out
