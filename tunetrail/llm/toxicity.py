"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings whose document share among toxic training rows
is far above that among the others. Disguised spellings (digits and marks for letters, capitals,
marks around a word) are undone before the lookup and counted as obfuscation. Rows that trees or
calibration learn from get their features from a lexicon of the other half of the sample, and the
calibration learns from rows the trees have not seen; the final lexicon is of the whole sample.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunetrail.llm.shared import (extended, fold, found, free_name, joined, labelled, mix, other_columns, powers,
                                  prefix_sums, quoted, slices, stored, sums_of, word_spans)

#: Contracted values.
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bounds: labelled rows of the training sample, entries of the lexicon.
DOCUMENTS, ENTRIES = 12000, 600
#: Bytes of the word beginnings that the lexicon holds beside whole words.
BEGINNINGS = (4, 5, 6)
#: Spellings that stand for letters, second-person words of the languages served.
SPELT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes"
                 " vous votre vos tú ti tu tus usted ustedes vosotros os").split()
FEATURES = 18

LETTER = np.zeros(256, bool)
LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
for _a, _b in SPELT.items():
    FOLDED[ord(_a)] = ord(_b)
DISGUISE = np.zeros(256, bool)
DISGUISE[[ord(c) for c in SPELT] + [ord("*"), ord("#"), ord(".")]] = True
STOPS = np.isin(np.arange(256), list(b".,;:"))
LOUD = np.isin(np.arange(256), list(b"!?"))


def word_codes(texts: list[bytes]):
    """Buffer, text offsets, word spans without outer marks, and hashes of words and their beginnings."""
    data, offsets = joined(texts)
    a, b = word_spans(data)
    core = LETTER[data] | (data >= 48) & (data <= 57) | (data == 36) | (data == 64)
    for _ in range(4):
        a = np.where((a < b) & ~core[np.minimum(a, len(data) - 1)], a + 1, a) if len(a) else a
        b = np.where((a < b) & ~core[np.maximum(b - 1, 0)], b - 1, b) if len(b) else b
    folded = FOLDED[data]
    if len(data) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][accent] += 0x20
    sums = prefix_sums(folded.astype(np.uint64) + np.uint64(1))
    unscale = powers(len(sums))[1][a]
    code = lambda stop, kind: mix((sums[stop] - sums[a]) * unscale, kind)
    codes = [code(b, 0)]
    for k in BEGINNINGS:
        codes.append(np.where(b - a > k, code(np.minimum(a + k, b), k), np.uint64(0)))
    return data, folded, offsets, a, b, codes


SECOND = None


def second_person() -> np.ndarray:
    global SECOND
    if SECOND is None:
        SECOND = np.sort(word_codes([" ".join(SECOND_PERSON).encode()])[-1][0])
    return SECOND


@dataclass
class Lexicon:
    codes: list[np.ndarray]
    weights: list[np.ndarray]

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros((0, FEATURES))]
        for first, last in slices(texts, 2 << 20):
            out.append(self._features(texts[first:last]))
        return np.concatenate(out)

    def _features(self, texts):
        data, folded, offsets, a, b, codes = word_codes(texts)
        n_docs = len(texts)
        doc = np.searchsorted(offsets, a, "right") - 1
        total = np.bincount(doc, minlength=n_docs)
        n = np.maximum(total, 1)
        per = lambda mask: np.bincount(doc, mask, n_docs)
        weight, whole = np.zeros(len(a)), np.zeros(len(a), bool)
        for k, (code, known, value) in enumerate(zip(codes, self.codes, self.weights)):
            hit, at = found(code, known)
            if hit.any():
                weight = np.maximum(weight, np.where(hit, value[at], 0) if len(known) else 0)
            if k == 0:
                whole = hit
        lexical = weight > 0
        you = found(codes[0], second_person())[0]
        near = np.zeros(len(a), bool)
        for shift in range(1, 6):
            if shift < len(a):
                same = doc[shift:] == doc[:-shift]
                near[shift:] |= you[:-shift] & same
                near[:-shift] |= you[shift:] & same
        in_word = np.zeros(len(data) + 1, np.int64)
        np.cumsum(DISGUISE[data], out=in_word[1:])
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTER[data], out=letters[1:])
        capitals = np.zeros(len(data) + 1, np.int64)
        np.cumsum(UPPER[data], out=capitals[1:])
        masked = (in_word[b] > in_word[a]) & (letters[b] > letters[a])
        shouted = (capitals[b] - capitals[a] == b - a) & (b - a > 1)
        triple = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & LETTER[data[2:]], out=triple[3:])
        stretched = triple[b] > triple[np.minimum(a + 2, b)]
        starts = offsets[:-1]
        size = np.maximum(np.diff(offsets) - 1, 1)
        hits, strongest = per(lexical), np.zeros(n_docs)
        np.maximum.at(strongest, doc, weight)
        return np.column_stack([
            np.log1p(total), hits, hits / n, per(whole), per(whole) / n, per(weight) / n, strongest, per(weight),
            per(you) / n, per(lexical & near), per(lexical & near) / np.maximum(hits, 1),
            per(shouted) / n, sums_of(UPPER[data], starts) / size, sums_of(LOUD[data], starts) / size,
            sums_of(STOPS[data], starts) / size, per(masked) / n, per(masked & lexical), per(stretched) / n])


def _tokens(batches):
    """Each word and word beginning of a document once: (label, kind, code)."""
    for batch in batches:
        labels = batch.column(0).to_numpy()
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for first, last in slices(texts, 2 << 20):
            _, _, offsets, a, _, codes = word_codes(texts[first:last])
            doc = np.searchsorted(offsets, a, "right") - 1
            for kind, code in enumerate(codes):
                known = code != 0
                pairs = np.unique(np.rec.fromarrays([doc[known], code[known]]))
                owner, code = pairs.f0, pairs.f1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[first:last][owner].astype(np.int32)), pa.array(np.full(len(code), kind, np.int32)),
                     pa.array(code.view(np.int64))], names=["label", "kind", "code"])


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES, least: int = 4, least_odds: float = 2.5) -> Lexicon:
    """At most `entries` words and beginnings with the highest smoothed log odds of a document being toxic.

    `sample` has columns label and text; a token counts once in a document. Runs jobs.
    """
    sizes = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counted = (sample.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(_tokens, "label int, kind int, code long").groupBy("kind", "code")
               .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    rows = (counted.where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= least_odds)
            .orderBy(F.desc("odds"), "kind", "code").limit(entries).collect())
    codes, weights = [], []
    for kind in range(1 + len(BEGINNINGS)):
        own = sorted((np.int64(r.code).view(np.uint64).item(), r.odds) for r in rows if r.kind == kind)
        codes.append(np.array([c for c, _ in own], np.uint64))
        weights.append(np.array([w for _, w in own]))
    return Lexicon(codes, weights)


def _dense(batches, position, lexicon, out):
    for batch in batches:
        texts = [t or b"" for t in batch.column(position).cast(pa.binary()).to_pylist()]
        rows = lexicon.features(texts)
        values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out])


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "features") -> DataFrame:
    position = docs.columns.index(text)
    dense = docs.mapInArrow(lambda batches: _dense(batches, position, lexicon, out), extended(docs, f"{out} array<double>"))
    return dense.withColumn(out, array_to_vector(out))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object
    calibration: object
    prior: float


def train_toxicity(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, trees: int = 20,
                   depth: int = 4) -> ToxicityModel:
    """Fit on at most `documents` labelled documents outside the held-out fold, chosen by a hash of the id.

    Without both labels in the parts for trees and calibration the score is the share of toxic
    rows (0 without any). Runs jobs; the sample is stored in the shared folder.
    """
    sample = labelled(labels, "toxic", MODULUS, HELD_OUT, documents)
    half, part = F.pmod(F.xxhash64("doc_id", F.lit(91)), F.lit(2)), F.pmod(F.xxhash64("doc_id", F.lit(92)), F.lit(3))
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "doc_id", F.col("label").cast("double").alias("label"), F.coalesce("text", F.lit("")).alias("text"),
        half.alias("half"), part.alias("part")), "sample")
    lexicon = learn_lexicon(rows)
    halves = [with_features(rows.where(F.col("half") == 1 - k), learn_lexicon(rows.where(F.col("half") == k))) for k in (0, 1)]
    dense = stored(halves[0].unionByName(halves[1]).select("doc_id", "label", "part", "features").coalesce(4), "dense")
    fit, check = dense.where("part > 0").orderBy("doc_id"), dense.where("part = 0").orderBy("doc_id")
    prior = rows.agg(F.avg("label")).first()[0] or 0.0
    kinds = lambda df: df.select("label").distinct().count()
    if kinds(fit) < 2 or kinds(check) < 2:
        return ToxicityModel(lexicon, None, None, prior)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
                          minInstancesPerNode=5, seed=5).fit(fit)
    raw = model.transform(check).select("label", vector_to_array("probability")[1].alias("raw"))
    return ToxicityModel(lexicon, model, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of `docs`, held_out, score (0 to 1, higher is more toxic) and predicted (score >= 0.3).

    The score is a function of the text alone; NULL and empty texts have zero features. Input
    columns with the name of an added one are replaced.
    """
    names = other_columns(docs, "held_out", "score", "predicted")
    plain = docs.select(*quoted(names))
    if model.trees is None:
        scored = plain.withColumn("score", F.lit(float(model.prior)))
    else:
        dense, tree, share, margin, raw = (free_name(plain, n) for n in ("_dense", "_tree", "_share", "_margin", "_raw"))
        trees = model.trees.copy().setFeaturesCol(dense).setPredictionCol(tree).setProbabilityCol(share)
        rated = trees.setRawPredictionCol(margin).transform(with_features(plain, model.lexicon, text, dense))
        scored = model.calibration.copy().setFeaturesCol(raw).setPredictionCol("score").transform(
            rated.withColumn(raw, vector_to_array(share)[1]))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(*quoted(names), (fold(F.col(doc_id), MODULUS) == HELD_OUT).alias("held_out"), score.alias("score"),
                         (score >= THRESHOLD).cast("int").alias("predicted"))
