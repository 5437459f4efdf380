import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array

from tunetrail.operators import lyrics as L

TEXTS = {
    1: "Amor, amor y más AMOR! La noche_larga cae 22",
    2: "noche noche día; the night is LONG, the night",
    3: "Ã¡rbol night amor",
    4: "",
    5: None,
    6: "a b c",
    7: "the the the the night día dia dia",
}


def python_tokens(text):
    try:
        text = (text or "").encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"\b\w\w+\b", plain)


@pytest.fixture()
def docs(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "track_id int, lyrics string")
    return L.term_counts(L.drop_stop_words(L.tokenize(df), ["the"]))


def python_vocab(tokens, weights, min_df, max_df, cap):
    df, total = Counter(), Counter()
    for i, words in tokens.items():
        for w, n in Counter(words).items():
            df[w] += weights[i]
            total[w] += n * weights[i]
    n = sum(weights.values())
    kept = sorted((w for w in df if min_df <= df[w] <= max_df * n), key=lambda w: (-total[w], w))[:cap]
    return {w: (k, df[w], total[w]) for k, w in enumerate(sorted(kept))}, n


def without_stops():
    return {i: [w for w in python_tokens(t) if w != "the"] for i, t in TEXTS.items()}


def test_tokens(docs):
    assert {r.track_id: r.tokens for r in docs.collect()} == without_stops()


def test_term_counts(docs):
    got = {r.track_id: {t.token: t.tf for t in r.terms} for r in L.term_counts(docs).collect()}
    assert got == {i: dict(Counter(w)) for i, w in without_stops().items()}


@pytest.mark.parametrize("min_df, max_df, cap", [(1, 1.0, 100), (2, 0.5, 100), (1, 1.0, 3)])
def test_vocabulary(docs, min_df, max_df, cap):
    got = {r.token: (r.position, r.df, r.total) for r in L.vocabulary(docs, min_df, max_df, cap).collect()}
    assert got == python_vocab(without_stops(), dict.fromkeys(TEXTS, 1), min_df, max_df, cap)[0]


def test_weighted_vocabulary_equals_repeated_documents(spark, docs):
    plays = {i: i for i in TEXTS}
    counted = docs.join(spark.createDataFrame(list(plays.items()), "track_id int, plays long"), "track_id")
    got = {r.token: (r.position, r.df, r.total) for r in L.vocabulary(counted, weight="plays").collect()}
    assert got == python_vocab(without_stops(), plays, 2, 0.7, 100)[0]


def test_tfidf_and_vectors(docs):
    vocab = L.vocabulary(docs, 1, 1.0, 4)
    words, n = python_vocab(without_stops(), dict.fromkeys(TEXTS, 1), 1, 1.0, 4)
    want = {}
    for i, tokens in without_stops().items():
        raw = {w: c * (math.log((1 + n) / (1 + words[w][1])) + 1) for w, c in Counter(tokens).items() if w in words}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, w): v / norm for w, v in raw.items()})
    got = {(r.track_id, r.token): r.weight for r in L.tfidf(docs, vocab, "track_id").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)

    stages, names = L.tfidf_model(vocab)
    rows = stages.transform(docs).select("track_id", vector_to_array("lyric_features").alias("v")).collect()
    dense = {(r.track_id, w): v for r in rows for w, v in zip(names, r.v) if v}
    assert dense.keys() == want.keys()
    assert all(math.isclose(dense[k], want[k], rel_tol=1e-12) for k in want)


def test_token_totals_and_pivot(docs):
    vocab = L.vocabulary(docs, 1, 1.0, 4)
    weights = L.tfidf(docs, vocab, "track_id")
    top = L.token_totals(weights, 2).collect()
    assert len(top) == 2 and top[0].weight >= top[1].weight
    wide = L.pivot_tokens(weights, vocab, "track_id")
    assert len(wide.columns) == 5 and all(c.startswith("lyric_") for c in wide.columns[1:])


def test_stop_words_pass_the_tokenizer(spark):
    assert L.analysed_words(spark, ["También", "y", "don't", "TÚ"]) == ["don", "tambien", "tu"]
    assert "the" in L.language_stop_words("english")
