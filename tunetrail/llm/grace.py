"""Exact dedup by grace hashing: spill in rounds, compare complete content in open-addressing tables.

Round 0 folds the copies inside each input task. Later rounds deal the remaining contents out by a
fresh hash each; a task fills one table up to its memory budget and settles every record whose
content is in it, and the others are spilled to the shared folder for the next round. A content
is settled or spilled with all its copies, so nothing is lost, and a hot content reaches a round
with one record for each task at most.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import extended, free_name, other_columns, quoted, stored

#: Bytes of distinct content that one table may hold.
TABLE_BYTES = 48 << 20
#: What an entry takes beside its content.
ENTRY_BYTES = 120


class ContentTable:
    """Open addressing with linear probing; equal means equal hash and equal complete content."""

    def __init__(self):
        self.size, self.bytes = 0, 0
        self.slots = [None] * 1024

    def place(self, code: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = (code ^ code >> 29) & mask
        while (entry := self.slots[at]) is not None and not (entry[0] == code and entry[1] == content):
            at = at + 1 & mask
        return at

    def get(self, code: int, content: bytes):
        entry = self.slots[self.place(code, content)]
        return entry and entry[2]

    def put(self, code: int, content: bytes, value) -> None:
        if 2 * (self.size + 1) > len(self.slots):
            old, self.slots = self.slots, [None] * (2 * len(self.slots))
            for entry in filter(None, old):
                self.slots[self.place(entry[0], entry[1])] = entry
        self.slots[self.place(code, content)] = (code, content, value)
        self.size += 1
        self.bytes += len(content) + ENTRY_BYTES


def _fold(batches, budget, position, names):
    """Add row, slot (first row with the content in this table), whether it is that first row, and digest."""
    table, row = ContentTable(), TaskContext.get().partitionId() << 40
    for batch in batches:
        contents = batch.column(position).cast(pa.binary()).to_pylist()
        codes = batch.column(batch.num_columns - 1).to_pylist()
        rows, slots, digests = [], [], []
        for code, content in zip(codes, contents):
            content = content or b""
            value = table.get(code, content)
            if value is None:
                if table.bytes > budget:
                    table = ContentTable()
                value = (row, hashlib.sha256(content).hexdigest())
                table.put(code, content, value)
            rows.append(row)
            slots.append(value[0])
            digests.append(value[1])
            row += 1
        extra = [pa.array(rows, pa.int64()), pa.array(slots, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])


def _settle(batches, budget):
    """Rows (slot, class) for contents in the table; rows with their content for those beyond it."""
    table = ContentTable()
    for batch in batches:
        slots, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        contents = batch.column(2).cast(pa.binary()).to_pylist()
        classes, spilled = [], np.zeros(len(slots), bool)
        for k, (slot, code, content) in enumerate(zip(slots, codes, contents)):
            kind = table.get(code, content)
            if kind is None and (table.bytes <= budget or not table.size):
                table.put(code, content, slot)
                kind = slot
            classes.append(kind)
            spilled[k] = kind is None
        content = pa.array([c.decode() if s else None for c, s in zip(contents, spilled)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), content, pa.array(classes, pa.int64())],
                                         names=["slot", "code", "content", "class"])


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All columns of `docs` and the group of rows with equal text of each row.

    Adds keep_id (largest id of the group), group_size, kept (true for one row of each group) and
    text_sha256. NULL text counts as empty; a NULL id is smaller than any other; of several rows
    with the largest id and equal text one is kept. Input columns with the name of an added one
    are replaced. Stores intermediate tables in the shared folder: runs jobs.
    """
    names = other_columns(docs, "keep_id", "group_size", "kept", "text_sha256")
    plain = docs.select(*quoted(names))
    code, row, slot, sha, found = (free_name(plain, n) for n in ("_code", "_row", "_slot", "_sha", "_found"))
    ready = plain.withColumn(code, F.xxhash64(F.coalesce(text, F.lit(""))))
    position = names.index(text)
    folded = stored(ready.mapInArrow(lambda batches: _fold(batches, table_bytes, position, (row, slot, sha)),
                                     extended(ready, f"{row} long, {slot} long, {sha} string")), "folded")
    pending = folded.where(F.col(row) == F.col(slot)).select(
        F.col(slot).alias("slot"), F.col(code).alias("code"), F.coalesce(text, F.lit("")).alias("content"))
    settled, turn = None, 0
    while True:
        size = pending.agg(F.sum(F.octet_length("content") + ENTRY_BYTES)).first()[0]
        if not size and settled is not None:
            break
        dealt = pending.repartition(max(1, -(-2 * (size or 0) // table_bytes)), F.xxhash64("code", F.lit(turn)))
        result = stored(dealt.mapInArrow(lambda batches: _settle(batches, table_bytes),
                                         "slot long, code long, content string, class long"), f"round{turn}")
        done = result.where("class is not null").select("slot", "class")
        settled = done if settled is None else settled.unionByName(done)
        pending, turn = result.where("class is null").select("slot", "code", "content"), turn + 1
    best = F.max(F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row"))).alias("best")
    slots = folded.groupBy(F.col(slot).alias("slot")).agg(best, F.count(F.lit(1)).alias("n")).join(settled, "slot")
    groups = slots.groupBy("class").agg(F.max("best").alias("best"), F.sum("n").alias("size"))
    decided = slots.select("slot", "class").join(groups, "class").select(
        F.col("slot").alias(slot), F.struct("best", "size").alias(found))
    joined, group = folded.join(decided, slot), F.col(found)
    return joined.select(*quoted(names), group["best"]["id"].alias("keep_id"), group["size"].alias("group_size"),
                         (group["best"]["row"] == F.col(row)).alias("kept"), F.col(sha).alias("text_sha256"))
