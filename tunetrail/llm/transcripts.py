"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are role and place (first line of a turn, or a later one). A line emits its speaker marker,
length, last character and whether a blank line precedes it, independently given the state. Viterbi
decoding is exact and spread over blocks of a conversation: a block is first reduced to the best
score between any two states at its ends, blocks are combined in a tree, the best states at the
ends are handed down, and every block is then traced by itself. So no task holds more than a
block, however long a conversation is.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunetrail.llm.shared import stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)
#: Consecutive sequence numbers of one block, and blocks of one tree node.
BLOCK = 256
#: Words that speakers' names are written with.
NAMES = {1: "system context instructions preamble", 2: "user human customer question q you prompter instruction",
         3: "assistant ai bot answer a model response agent gpt"}
MARKER = re.compile(r"^\s*(?:\*\*|##+ |<\|?|\[)?\s*([A-Za-z]{1,12})\s*(?:\|?>|\]|:\*\*|\*\*:|:)\s*")
DASH = re.compile(r"^\s*[-–—•]\s+")
KIND = {name: kind for kind, names in NAMES.items() for name in names.split()}
SIZES = (6, 8, 3, 2)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def observe(line: str, blank_before: bool) -> tuple[int, int, int, int]:
    """Marker (0 none, 1-3 a role's name, 4 dash, 5 another name), length, last character, blank line before."""
    match = MARKER.match(line)
    kind = KIND.get(match[1].lower(), 5) if match else 4 if DASH.match(line) else 0
    last = line.rstrip()[-1]
    end = 2 if last == "?" else 1 if last in ".!" else 0
    return kind, min(7, max(0, len(line).bit_length() - 2)), end, int(blank_before)


def strip_marker(line: str) -> str:
    match = MARKER.match(line) or DASH.match(line)
    return line[match.end():] if match else line


def lines_of(texts: list[str | None]) -> tuple[list[str], list[bool], list[int]]:
    """Lines with text, whether a blank line precedes in their row, and the row of each."""
    lines, blank, rows = [], [], []
    for row, text in enumerate(texts):
        gap = False
        for line in (text or "").split("\n"):
            if line.strip():
                lines.append(line)
                blank.append(gap)
                rows.append(row)
            gap = not line.strip()
    return lines, blank, rows


@dataclass
class RoleModel:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def scores(self, lines: list[str], blank: list[bool]) -> np.ndarray:
        seen = np.array([observe(x, b) for x, b in zip(lines, blank)], np.int64).reshape(-1, len(SIZES))
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emit))

    def trace(self, scores: np.ndarray, entry: int, last: int) -> list[int]:
        """Best states of a block between its two ends; entry -1 is the start of the conversation."""
        if not len(scores):
            return []
        best, back = (self.start if entry < 0 else self.move[entry]) + scores[0], []
        for row in scores[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(0))
            best = step.max(0) + row
        states = [last]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


IDENTITY = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)


def _sorted_rows(table: pa.Table) -> pa.Table:
    return table.sort_by([("seq", "ascending"), ("text", "ascending")])


def in_blocks(lines: DataFrame) -> tuple[DataFrame, int]:
    """Rows (conv_id, seq, text, extra columns) with their block, and the number of tree levels above.

    A repeated row with a number is one line sent twice and counts once; rows without a number all stay.
    """
    low, high = lines.agg(F.min("seq"), F.max("seq")).first()
    low, high = (0, 0) if low is None else (low, high)
    seq = F.coalesce(F.col("seq"), F.lit(high + 1)) - F.lit(low)
    copies = F.when(F.col("seq") > high - low, F.col("_copies")).otherwise(1)
    rows = lines.withColumn("seq", seq).groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = (rows.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_copies")
            .withColumn("block", F.floor(F.col("seq") / BLOCK).cast("long")))
    levels, span = 0, (high + 1 - low) // BLOCK
    while span:
        levels, span = levels + 1, span // BLOCK
    return rows, levels


def _count(table: pa.Table) -> pa.Table:
    """Counts of (kind, state, value) in a labelled block, and its ends.

    Kinds: emissions 0-3, moves 5; 6 and 7 are the states of the block's first and last line, -1
    where that line has no label, with the block as value. A block without lines has no ends.
    """
    table = _sorted_rows(table)
    roles, counts, before, states = table["role"].to_pylist(), {}, None, []
    lines, blank, rows = lines_of(table["text"].to_pylist())
    for k, (line, gap, row) in enumerate(zip(lines, blank, rows)):
        if roles[row] not in ROLES:
            before = None
            states.append(-1)
            continue
        state = 2 * ROLES.index(roles[row]) + (k > 0 and rows[k - 1] == row)
        seen = [(kind, state, value) for kind, value in enumerate(observe(line, gap))]
        if before is not None:
            seen.append((5, before, state))
        for key in seen:
            counts[key] = counts.get(key, 0) + 1
        before = state
        states.append(state)
    block = table["block"][0].as_py()
    if states:
        counts |= {(6, states[0], block): 1, (7, states[-1], block): 1}
    conv = table["conv_id"][:1].combine_chunks()
    return pa.table({"conv_id": pa.concat_arrays([conv] * len(counts)) if counts else conv[:0],
                     "kind": pa.array([k for k, _, _ in counts], pa.int32()),
                     "state": pa.array([s for _, s, _ in counts], pa.int32()),
                     "value": pa.array([v for _, _, v in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def fit_roles(lines: DataFrame) -> RoleModel:
    """Smoothed shares of all labelled lines (conv_id, seq, text, role). Runs a job; collects counts only."""
    rows, _ = in_blocks(lines.select("conv_id", "seq", "text", "role"))
    shape = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("kind int, state int, value long, n long")])
    found = stored(rows.groupBy("conv_id", "block").applyInArrow(_count, shape), "counts")
    end = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("state")))
    blocks = found.where("kind >= 6").groupBy("conv_id", F.col("value").alias("block")).agg(
        end(6).alias("first"), end(7).alias("last"))
    before = F.lag("last").over(Window.partitionBy("conv_id").orderBy("block"))
    edges = blocks.withColumn("before", before).where("first >= 0 AND coalesce(before, 0) >= 0").select(
        F.when(F.col("before").isNull(), 4).otherwise(5).alias("kind"),
        F.coalesce("before", "first").alias("state"),
        F.when(F.col("before").isNull(), 0).otherwise(F.col("first")).cast("long").alias("value"), F.lit(1).cast("long").alias("n"))
    counts = (found.where("kind < 6").select("kind", "state", "value", "n").unionByName(edges)
              .groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect())
    tables = [np.full((STATES, size), 0.5) for size in SIZES] + [np.full((STATES, 1), 0.5), np.full((STATES, STATES), 0.5)]
    for r in counts:
        tables[r.kind][r.state, r.value] += r.n
    start, move = tables[4][:, 0], tables[5]
    start[1::2] = 1e-6
    move[:, 1::2] *= np.repeat(np.eye(len(ROLES)), 2, 0) + 1e-9  # a later line follows its own turn
    share = lambda t: np.log(t / t.sum(-1, keepdims=True))
    return RoleModel(share(start), share(move), [share(t) for t in tables[:4]])


def _matrix(model, lines, blank):
    """Rows: start of the conversation, then each state before the block; columns: state at its end."""
    out = np.concatenate([np.full((1, STATES), -np.inf), IDENTITY])
    for k, row in enumerate(model.scores(lines, blank)):
        step = (out[:, :, None] + model.move[None]).max(1)
        if k == 0:
            step[0] = model.start
        out = step + row[None]
    return out


def _after(first, second):
    """Matrix of two stretches one after the other; a row of -inf before any line stays the start."""
    through = (first[:, :, None] + second[None, 1:, :]).max(1)
    if np.isneginf(first[0]).all():
        through[0] = second[0]
    return through


NODE = "conv_id long, block long, matrix array<double>"
ENDS = "conv_id long, block long, entry int, last int"


def _leaf(model):
    def run(key, table):
        lines, blank, _ = lines_of(_sorted_rows(table)["text"].to_pylist())
        return _row(key, matrix=pa.array([_matrix(model, lines, blank).ravel().tolist()], pa.list_(pa.float64())))

    return run


def _row(key, **columns):
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()),
                     **columns})


def _children(table):
    table = table.sort_by("child")
    return table["child"].to_pylist(), [np.array(m).reshape(STATES + 1, STATES) for m in table["matrix"].to_pylist()]


def _combine(key, table):
    _, matrices = _children(table)
    total = matrices[0]
    for matrix in matrices[1:]:
        total = _after(total, matrix)
    return _row(key, matrix=pa.array([total.ravel().tolist()], pa.list_(pa.float64())))


def _hand_down(nodes, ends):
    """Entry and last state of every child of a node, from those of the node."""
    if not len(nodes) or not len(ends):
        return pa.table({"conv_id": pa.array([], pa.int64()), "block": pa.array([], pa.int64()),
                         "entry": pa.array([], pa.int32()), "last": pa.array([], pa.int32())})
    children, matrices = _children(nodes)
    entry, last = ends["entry"][0].as_py(), ends["last"][0].as_py()
    reach = [np.where(np.arange(STATES + 1) == entry + 1, 0.0, -np.inf)]
    back = []
    for matrix in matrices:
        step = reach[-1][:, None] + matrix
        if np.isneginf(matrix[0]).all():  # no line: the start stays the start
            now = np.concatenate([[reach[-1][0]], step[1:].max(0)])
            came = np.concatenate([[0], step[1:].argmax(0) + 1])
        else:
            now, came = np.concatenate([[-np.inf], step.max(0)]), np.concatenate([[0], step.argmax(0)])
        reach.append(now)
        back.append(came)
    at, states = last + 1, [last + 1]
    for came in reversed(back):
        at = int(came[at])
        states.append(at)
    states = [s - 1 for s in states[::-1]]
    conv = nodes["conv_id"][0].as_py()
    return pa.table({"conv_id": pa.array([conv] * len(children), pa.int64()), "block": pa.array(children, pa.int64()),
                     "entry": pa.array(states[:-1], pa.int32()), "last": pa.array(states[1:], pa.int32())})


RENDERED = "conv_id long, block long, n_lines int, line_roles array<string>, roles array<string>, rendered string"


def safe(text: str) -> str:
    """Text in which the control strings of the rendering cannot occur."""
    return text.replace(OPEN, "<| im_start|>").replace(CLOSE, "<| im_end|>")


def _render(model):
    def run(table, ends):
        shape = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n_lines", pa.int32()),
                           ("line_roles", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("rendered", pa.string())])
        if not len(table):
            return shape.empty_table()
        table = _sorted_rows(table)
        lines, blank, _ = lines_of(table["text"].to_pylist())
        entry, last = ends["entry"][0].as_py(), ends["last"][0].as_py()
        states = model.trace(model.scores(lines, blank), entry, last)
        out, roles, before, glue = [], [], entry, "\n"
        for k, (line, state) in enumerate(zip(lines, states)):
            opens = state % 2 == 0 or before < 0 or before // 2 != state // 2
            if opens:
                roles.append(ROLES[state // 2])
                out.append((f"{CLOSE}\n" if before >= 0 else "") + f"{OPEN}{roles[-1]}\n" + safe(strip_marker(line)))
                glue = "\n" if strip_marker(line) else ""
            else:
                out.append(glue + safe(line))
                glue = "\n"
            before = state
        return pa.table({"conv_id": [table["conv_id"][0].as_py()], "block": [table["block"][0].as_py()],
                         "n_lines": [len(lines)], "line_roles": [[ROLES[s // 2] for s in states]], "roles": [roles],
                         "rendered": ["".join(out)]}, schema=shape)

    return run


def format_chats(lines: DataFrame, model: RoleModel) -> DataFrame:
    """One row per conversation and block: n_lines, line_roles, roles of the turns that open, rendered.

    `lines` has conv_id, seq and text; a text may hold many lines, a whole transcript too. Rows go
    by seq, then text; NULL seq comes last; rows equal in number and text count once, rows without
    a number all stay; blank lines and NULL texts have no state. A NULL conv_id is a conversation of its own. Rendered blocks of a conversation
    joined in order are its canonical text, whose last turn is left open. Runs one small job.
    """
    rows, levels = in_blocks(lines.select(F.col("conv_id").cast("long").alias("conv_id"),
                                          F.col("seq").cast("long").alias("seq"), "text"))
    leaves = rows.groupBy("conv_id", "block")
    nodes = [leaves.applyInArrow(_leaf(model), NODE)]
    for _ in range(levels):
        nodes.append(_parents(nodes[-1]).groupBy("conv_id", "block").applyInArrow(_combine, NODE))
    ends = nodes[-1].select("conv_id", "block", F.lit(-1).alias("entry"), _best_last().alias("last"))
    for level in range(levels - 1, -1, -1):
        ends = (_parents(nodes[level]).groupBy("conv_id", "block").cogroup(ends.groupBy("conv_id", "block"))
                .applyInArrow(_hand_down, ENDS))
    return leaves.cogroup(ends.groupBy("conv_id", "block")).applyInArrow(_render(model), RENDERED)


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.floor(F.col("block") / BLOCK).cast("long").alias("block"),
                        F.col("block").alias("child"), "matrix")


def _best_last():
    """State with the best score from the start of the conversation."""
    first = F.slice("matrix", 1, STATES)
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def fold_of(conv_id: str, folds: int = 5):
    """Fold of a conversation by a hash of its id."""
    return F.pmod(F.xxhash64(conv_id, F.lit(29)), F.lit(folds))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Transcript lines (conv_id, seq, text, role) of turns (conv_id, turn, role, text).

    A conversation is written in one of five styles, by a hash of its id: names, other names,
    headings, tags, or dashes without any name. Roles other than the known ones are written as
    their own name.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit(3)), F.lit(5))
    role = F.coalesce("role", F.lit("unknown"))
    other = (F.when(role == "user", "Human").when(role == "assistant", "AI").when(role == "system", "Context").otherwise(role))
    head = (F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(other, F.lit(": ")))
            .when(style == 2, F.concat(F.lit("\n### "), F.initcap(role), F.lit(":\n")))
            .when(style == 3, F.concat(F.lit("<|"), role, F.lit("|> "))).otherwise(F.lit("- ")))
    return turns.select("conv_id", F.col("turn").alias("seq"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"), "role")
