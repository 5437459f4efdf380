"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. The score of a line is linear in binned features of its own
and in features of the lines beside it; a 2 x 2 table scores neighbouring labels. Forward-backward
gives each line's marginal, and the length-weighted mean of the marginals is the document's score.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import (extended, fold, joined, labelled, mix, other_columns, quoted, slices, sums_of,
                                  word_hashes, word_spans)

#: Contracted values.
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bounds of the training sample: documents, and consecutive lines of each.
DOCUMENTS, LINES = 8000, 40
#: Fixed classes of bytes.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?",
           "pipe": b"|", "mark": b"<>{}[]()=*#&%$@~^_+\\/`\"'-"}
KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(CLASSES.values(), 1):
    KIND[list(_bytes)] = _k
RAW = 16
BINS = 5


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines with words, and where each document's lines begin (one more).

    A document without words has one line of zero features and length 1.
    """
    data, offsets = joined(texts)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    a, b = word_spans(data)
    codes = word_hashes(data, a, b)
    line = np.searchsorted(starts, a, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    size = ends - starts
    kinds = KIND[data]
    counts = {name: sums_of(kinds == k, starts) for k, name in enumerate(CLASSES, 1)}
    doc = np.searchsorted(offsets, starts, "right") - 1

    def repeats(keys, owners, n):
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        return np.bincount(owners[order[1:][same]], minlength=n)

    repeated = repeats(codes ^ mix(line.astype(np.uint64)), line, len(starts))
    after = np.concatenate([[False], (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])]) if len(codes) else codes
    stutter = np.bincount(line, after, len(starts))
    place = np.arange(len(a)) - np.searchsorted(line, np.arange(len(starts)))[line]
    content = np.zeros(len(starts), np.uint64)
    np.add.at(content, line, mix(codes + place.astype(np.uint64)))
    has = n_words > 0
    copied = np.zeros(len(starts))
    whole = np.flatnonzero(has)
    copied[whole] = repeats(content[whole] ^ mix(doc[whole].astype(np.uint64), 3), np.arange(len(whole)), len(whole)) > 0
    word_bytes = np.bincount(line, b - a, len(starts))
    with np.errstate(divide="ignore", invalid="ignore"):
        per_byte = {k: v / np.maximum(size, 1) for k, v in counts.items()}
        n = np.maximum(n_words, 1)
        last = data[np.maximum(ends - 1, 0)]
        first = data[np.minimum(starts, len(data) - 1)] if len(data) else starts
        x = np.column_stack([
            np.log1p(size), np.log1p(n_words), word_bytes / n, repeated / n, stutter / n,
            per_byte["upper"], per_byte["digit"], per_byte["stop"], per_byte["loud"], per_byte["pipe"],
            per_byte["mark"], copied, np.isin(last, list(b".!?")), KIND[first] == 1,
            (counts["stop"] + counts["loud"]) / n, (counts["mark"] + counts["pipe"]) / n]) if len(starts) else np.zeros((0, RAW))
    x, size, doc = x[has], size[has], doc[has]
    empty = np.setdiff1d(np.arange(len(texts)), doc)
    x = np.concatenate([x, np.zeros((len(empty), RAW))])
    size = np.concatenate([size, np.ones(len(empty), np.int64)])
    doc = np.concatenate([doc, empty])
    order = np.argsort(doc, kind="stable")
    return x[order], size[order], np.searchsorted(doc[order], np.arange(len(texts) + 1))


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of the line before and after, zero beyond the document, and marks of its ends."""
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    heads, tails = np.zeros(len(x)), np.zeros(len(x))
    heads[first[:-1]] = 1
    tails[first[1:] - 1] = 1
    before[heads > 0] = 0
    after[tails > 0] = 0
    return np.column_stack([before, after, heads, tails])


@dataclass
class LineCrf:
    edges: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    table: np.ndarray

    def design(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        binned = [x[:, [k]] > self.edges[k][None, :] for k in range(x.shape[1])]
        dense = (np.column_stack([x, with_neighbours(x, first)]) - self.centre) / self.spread
        return np.column_stack([np.ones(len(x)), np.clip(dense, -4, 4), *binned])

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return chain(self.design(x, first) @ self.weights, self.table, first)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0)]
        for a, b in slices(texts):
            x, size, first = line_features(texts[a:b])
            good = self.marginals(x, first) * size
            out.append(np.add.reduceat(good, first[:-1]) / np.add.reduceat(size, first[:-1]))
        return np.clip(np.concatenate(out), 0, 1)


def chain(score: np.ndarray, table: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all documents at once, line by line.

    Returns each line's probability of good, the expected counts of neighbouring labels, and the
    log of the partition function less the sum of each line's own normaliser.
    """
    psi = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    psi = np.column_stack([1 - psi, psi])
    move = np.exp(table)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = first[:-1][order], lengths[order]
    alpha, beta = psi.copy(), np.ones_like(psi)
    norm = alpha[begins].sum(1)
    alpha[begins] /= norm[:, None]
    log_z = float(np.log(norm).sum())
    depth = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(depth + 1)]
    for t in range(1, depth):
        at = begins[:active[t]] + t
        step = (alpha[at - 1] @ move) * psi[at]
        norm = step.sum(1)
        log_z += float(np.log(norm).sum())
        alpha[at] = step / norm[:, None]
    pairs = np.zeros((2, 2))
    for t in range(depth - 2, -1, -1):
        at = begins[:active[t + 1]] + t
        ahead = psi[at + 1] * beta[at + 1]
        step = ahead @ move.T
        both = alpha[at][:, :, None] * move[None] * ahead[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        beta[at] = step / step.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, log_z



def fit_crf(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.08,
            ridge: float = 1e-3) -> LineCrf:
    """Maximum likelihood by Adam; every line has the label of its document."""
    quantiles = np.quantile(x, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    dense = np.column_stack([x, with_neighbours(x, first)])
    model = LineCrf(quantiles, dense.mean(0), dense.std(0) + 1e-3, np.zeros(0), np.zeros((2, 2)))
    design = model.design(x, first)
    lengths = np.diff(first)
    y = np.repeat(label, lengths).astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (lengths[label == k] - 1).sum()
    n, theta = len(label), np.zeros(design.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        good, pairs, _ = chain(design @ theta[:-4], theta[-4:].reshape(2, 2), first)
        slope = np.concatenate([design.T @ (y - good), (seen - pairs).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights, model.table = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def _train_lines(batches, lines):
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        ids = batch.column(0).to_pylist()
        xs, counts = [], []
        for a, b in slices(texts):
            x, _, first = line_features(texts[a:b])
            for k in range(b - a):
                low, high = first[k], first[k + 1]
                low += (ids[a + k] or 0) * 2654435761 % max(1, high - low - lines + 1)
                part = x[low:min(high, low + lines)].astype(np.float32)
                xs.append(part.tobytes())
                counts.append(len(part))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()),
                                          pa.array(xs, pa.binary())], names=["doc_id", "label", "n", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, lines: int = LINES) -> LineCrf:
    """Fit on at most `documents` labelled documents outside the held-out fold, `lines` lines of each.

    The sample goes by a hash of the id and is the same on every run. Without labels the model
    scores every line 0.5. Runs a job and collects the sample's features.
    """
    sample = labelled(labels, "quality", MODULUS, HELD_OUT, documents)
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(lambda batches: _train_lines(batches, lines), "doc_id long, label int, n int, x binary").collect())
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    if not rows:
        rows = [type("Row", (), {"doc_id": 0, "label": k, "n": 1, "x": np.zeros(RAW, np.float32).tobytes()}) for k in (0, 1)]
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(r.n, RAW) for r in rows]).astype(float)
    first = np.concatenate([[0], np.cumsum([r.n for r in rows])])
    return fit_crf(x, first, np.array([r.label for r in rows]))


def _score(batches, position, model):
    for batch in batches:
        texts = [t or b"" for t in batch.column(position).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())],
                                         names=[*batch.schema.names, "score"])


def score_quality(docs: DataFrame, model: LineCrf, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of `docs`, held_out, score (0 to 1, higher is better) and predicted (score >= 0.3).

    The score is a function of the text alone. NULL and empty texts count as one line of zero
    features. Input columns with the name of an added one are replaced.
    """
    names = other_columns(docs, "held_out", "score", "predicted")
    plain = docs.select(*quoted(names))
    position = names.index(text)
    scored = plain.mapInArrow(lambda batches: _score(batches, position, model), extended(plain, "score double"))
    return scored.select(*quoted(names), (fold(F.col(doc_id), MODULUS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
