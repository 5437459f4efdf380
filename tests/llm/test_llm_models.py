"""Quality, toxicity, roles and mixing: held-out accuracy, properties, brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunetrail.llm import line_crf, raking, toxicity, transcripts

SF = "/root/testdata/sf0.01"


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 4, 9])
    score, table = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs, _ = line_crf.chain(score, table, first)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights = {}
        for labels in itertools.product((0, 1), repeat=b - a):
            weights[labels] = np.exp(sum(score[a + k] * y for k, y in enumerate(labels))
                                     + sum(table[x, y] for x, y in zip(labels, labels[1:])))
        total = sum(weights.values())
        for labels, w in weights.items():
            want[a:b] += np.array(labels) * w / total
            for x, y in zip(labels, labels[1:]):
                want_pairs[x, y] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_quality_is_learned_and_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = line_crf.score_quality(docs, line_crf.train_quality(docs, labels))
    rows = scored.join(labels.withColumnRenamed("quality", "y"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows) and {r.predicted for r in rows} == {0, 1}
    assert np.mean([r.predicted == r.y for r in rows]) > 0.95


def test_quality_on_rough_rows_and_without_labels(spark, rough, documents):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for table in (labels, labels.limit(0)):
        model = line_crf.train_quality(rough, table)
        scored = line_crf.score_quality(rough, model)
        rows = scored.collect()
        assert len(rows) == rough.count() and all(0 <= r.score <= 1 for r in rows)
        assert "Score" not in scored.columns and "features" in scored.columns
    assert all(abs(r.score - 0.5) < 1e-6 for r in rows)
    assert line_crf.score_quality(documents([]), model).count() == 0


def test_lines_see_their_neighbours_only_inside_a_document():
    x, size, first = line_crf.line_features([b"", b"one two\n\nthree!\n", b"x"])
    assert first.tolist() == [0, 1, 3, 4] and size.tolist() == [1, 7, 6, 1]
    near = line_crf.with_neighbours(x, first)
    assert not near[0, :2 * line_crf.RAW].any() and (near[1, line_crf.RAW:2 * line_crf.RAW] == x[2]).all()
    assert (near[2, :line_crf.RAW] == x[1]).all() and not near[2, line_crf.RAW:2 * line_crf.RAW].any()


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        words = [rng.choice(["bleon", "thred", "ania", "vost", "Und", "per"]) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grolk", "GROLK!", "gr0lk", "snivvle", "you snivvle"]))
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_toxicity_is_learned_and_held_out(spark, documents):
    texts, marks = toxic_corpus(800)
    docs = documents(texts)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, trees=6, depth=3)
    rows = toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95
    other = [t.replace("grolk", "GR0lK") for t in texts]
    again = toxicity.score_toxicity(documents(other), model).agg({"predicted": "sum"}).first()[0]
    assert again >= 0.9 * sum(marks)


def test_toxicity_on_rough_rows_and_without_labels(spark, rough, documents):
    model = toxicity.train_toxicity(rough, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    scored = toxicity.score_toxicity(rough, model)
    assert {r.score for r in scored.collect()} == {0.0} and scored.count() == rough.count()
    texts, marks = toxic_corpus(300)
    full = toxicity.train_toxicity(documents(texts), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"),
                                   trees=3, depth=2)
    rows = toxicity.score_toxicity(rough, full).collect()
    assert len(rows) == rough.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(documents([]), full).count() == 0


def test_raking_meets_every_margin():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 900, 24).astype(float)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    targets = [np.array([.1, .2, .3, .4]), np.array([.5, .3, .2]), np.array([.25, .75])]
    factors = raking.rake(tokens, codes, targets)
    weight = tokens * np.prod([f[c] for f, c in zip(factors, codes)], axis=0)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, weight) / weight.sum(), target, atol=1e-7)
    scale = raking.rate_scale(tokens, weight / tokens, 0.4)
    assert np.isclose((tokens * np.minimum(1, scale * weight / tokens)).sum(), 0.4 * tokens.sum())


def test_mixing_moves_shares_to_targets(spark, documents):
    rng = random.Random(6)
    n = 4000
    source = [rng.choice(["hot", "hot", "hot", "b", "c", None]) for _ in range(n)]
    lang = [rng.choice(["en", "en", "de"]) for _ in range(n)]
    docs = documents([f"{i} " + "w " * rng.randint(5, 300) for i in range(n)], lang=lang, source=source)
    targets = {"source": {"hot": 1, "b": 1, "c": 1, raking.NONE: 1}, "lang": {"en": 0.5, "de": 0.5}}
    mixed = raking.mix_to_targets(docs, targets, rate=0.3)
    assert mixed.count() == n
    rows = mixed.collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    kept = [r for r in rows if r.sampled]
    share = Counter()
    for r in kept:
        share[r.source] += r.n_tokens
        share[r.lang] += r.n_tokens
    total = sum(r.n_tokens for r in kept)
    assert abs(total / sum(r.n_tokens for r in rows) - 0.3) < 0.05
    assert all(abs(share[s] / total - 0.25) < 0.05 for s in ("hot", "b", "c", None)) and abs(share["de"] / total - 0.5) < 0.05
    again = {r.doc_id for r in raking.mix_to_targets(docs.repartition(7), targets, rate=0.3).where("sampled").collect()}
    assert again == {r.doc_id for r in kept}


def test_bounded_raking_meets_margins_with_cells_at_the_bound():
    """Rates of a cell stay at 1 and the free cells make up for it; against a slow exact solution per category."""
    tokens = np.array([5., 60., 40., 20., 300., 75.])
    codes = [np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])]
    targets = [np.array([60., 45., 145.]) / 500, np.array([120., 130.]) / 500]
    factors = raking.rake(tokens, codes, targets, rounds=2000, tolerance=1e-12, start=np.full(6, 0.5), bound=1.0)
    rates = np.minimum(1, 0.5 * factors[0][codes[0]] * factors[1][codes[1]])
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, tokens * rates) / 500, target, atol=1e-8)
    assert (rates > 1 - 1e-9).any()
    slow = [np.ones(3), np.ones(2)]
    for _ in range(3000):
        for d, target in enumerate(targets):
            for c in range(len(target)):
                here, other = codes[d] == c, slow[1 - d][codes[1 - d]] * 0.5
                low, high = 0.0, 1e9
                for _ in range(80):
                    middle = (low + high) / 2
                    below = (tokens * np.minimum(1, middle * other))[here].sum() < target[c] * 500
                    low, high = (middle, high) if below else (low, middle)
                slow[d][c] = high
        got = np.minimum(1, 0.5 * slow[0][codes[0]] * slow[1][codes[1]])
        if np.allclose(np.bincount(codes[0], tokens * got) / 500, targets[0], atol=1e-10):
            break
    assert np.allclose(rates, got, atol=1e-5)


@pytest.mark.parametrize("table", [False, True])
def test_sampling_tells_what_a_rare_source_cannot_give(documents, monkeypatch, table):
    """One hundredth of all tokens is asked for half of the sample: all of it is taken, the report says so."""
    if table:
        monkeypatch.setitem(raking.MOST, "source", 1)
    docs = documents([f"{i} " + "w " * 19 for i in range(1000)], source=["rare" if i % 100 == 0 else "hot" for i in range(1000)])
    targets = {"source": {"hot": 0.5, "rare": 0.5}}
    mixed = raking.mix_to_targets(docs, targets).cache()
    rows = mixed.collect()
    assert {r.probability for r in rows if r.source == "rare"} == {1.0}
    assert abs(sum(r.probability * r.n_tokens for r in rows) / sum(r.n_tokens for r in rows) - 0.5) < 1e-6
    weight = {s: sum(r.weight * r.n_tokens for r in rows if r.source == s) for s in ("rare", "hot")}
    assert abs(weight["rare"] - weight["hot"]) < 1e-3
    shares = {r.category: r for r in raking.mix_shares(mixed, targets).where("dimension = 'source'").collect()}
    assert abs(shares["rare"].target - 0.5) < 1e-9 and abs(shares["rare"].reached - 0.02) < 1e-6
    met = raking.mix_to_targets(docs, targets, rate=0.01).collect()
    kept = {s: sum(r.probability * r.n_tokens for r in met if r.source == s) for s in ("rare", "hot")}
    assert abs(kept["rare"] - kept["hot"]) < 1e-3


def test_mixing_rough_and_empty_tables(rough, documents, monkeypatch):
    rows = raking.mix_to_targets(rough).collect()
    assert len(rows) == rough.count() and {r.n_tokens for r in rows if not (r.text or "").strip()} == {0}
    assert raking.mix_to_targets(documents([])).count() == 0
    assert raking.mix_to_targets(documents([None, ""])).where("sampled").count() == 0
    monkeypatch.setitem(raking.MOST, "source", 1)
    many = documents(["a b"] * 30, source=[f"s{i % 5}" for i in range(30)])
    assert raking.mix_to_targets(many, rate=1.0).where("weight > 0").count() == 30


def test_mixing_gives_every_source_its_own_weight(documents):
    equal = documents(["a b c"] * 300, source=[f"s{i:03}" for i in range(300)])
    assert all(abs(r.weight - 1) < 1e-6 for r in raking.mix_to_targets(equal).collect())
    uneven = documents([f"{i} " + "w " * (1 + i % 7) for i in range(600)], source=[f"s{i % 300:03}" for i in range(600)],
                       lang=["en", "de", "en", None, "de"] * 120)
    rows = raking.mix_to_targets(uneven, {"source": {"s007": 1, "s299": 3}, "lang": {"en": 1, "de": 3}}).collect()
    share = Counter()
    for r in rows:
        share[r.source] += r.weight * r.n_tokens
    total = sum(share.values())
    assert abs(share["s299"] / total - 0.75) < 1e-6 and abs(share["s007"] / total - 0.25) < 1e-6


def test_mixing_by_table_equals_mixing_on_the_driver(documents, monkeypatch):
    rng = random.Random(8)
    n = 400
    docs = documents([f"{i} " + "w " * rng.randint(1, 300) for i in range(n)], lang=[rng.choice(["en", "en", "de", None]) for _ in range(n)],
                     source=[rng.choice(["hot"] * 9 + ["b", "c", "d"]) for _ in range(n)])
    for targets in (None, {"source": {"b": 2, "hot": 1, "absent": 4}}):
        want = {r.doc_id: r for r in raking.mix_to_targets(docs, targets).collect()}
        with monkeypatch.context() as few:
            few.setitem(raking.MOST, "source", 1)
            got = {r.doc_id: r for r in raking.mix_to_targets(docs, targets).collect()}
        assert got.keys() == want.keys()
        for i, r in want.items():
            assert abs(got[i].weight - r.weight) < 1e-6 * (1 + r.weight) and abs(got[i].probability - r.probability) < 1e-6


def test_role_counts_cross_blocks(spark, monkeypatch):
    rows = [(c, 300 * c + k, f"{k} line.", ("user", "assistant")[k % 2]) for c in range(3) for k in range(40)]
    lines = spark.createDataFrame(rows, "conv_id long, seq long, text string, role string")
    whole = []
    for size in (1 << 20, 7):
        monkeypatch.setattr(transcripts, "BLOCK", size)
        whole.append(transcripts.fit_roles(lines))
    assert np.allclose(whole[0].start, whole[1].start) and np.allclose(whole[0].move, whole[1].move)


def test_roles_are_recovered(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    lines = transcripts.as_transcripts(turns)
    model = transcripts.fit_roles(lines.where(transcripts.fold_of("conv_id") != 0))
    found = transcripts.format_chats(lines, model).where(transcripts.fold_of("conv_id") == 0).collect()
    given = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        given.setdefault(r.conv_id, []).append(r)
    assert found and np.mean([r.roles == [t.role for t in given[r.conv_id]] for r in found]) > 0.9
    marked = {r.conv_id: r.rendered for r in found}
    for conv, text in marked.items():
        assert text.count(transcripts.OPEN) == text.count(transcripts.CLOSE) + 1


def viterbi_by_hand(model, lines, blank):
    scores = model.scores(lines, blank)
    best = [(-np.inf, None)]
    for states in itertools.product(range(transcripts.STATES), repeat=len(lines)):
        value = model.start[states[0]] + sum(s[k] for s, k in zip(scores, states)) + sum(model.move[a, b] for a, b in zip(states, states[1:]))
        if value > best[0][0] + 1e-9:
            best = [(value, states)]
    return best[0]


def test_rows_without_a_number_all_stay(spark):
    model = transcripts.RoleModel(np.zeros(6), np.zeros((6, 6)), [np.zeros((6, s)) for s in transcripts.SIZES])
    rows = [(1, None, t) for t in ("User: hi", "yes", "yes", "AI: ok")] + [(2, 4, "yes"), (2, 4, "yes"), (2, 9, "yes"), (2, None, "yes"), (2, None, "yes")]
    for extra in ([], [(3, 1 << 40, "far")]):
        df = spark.createDataFrame(rows + extra, "conv_id long, seq long, text string")
        found = transcripts.format_chats(df, model).groupBy("conv_id").agg(F.sum("n_lines").alias("n")).collect()
        assert {r.conv_id: r.n for r in found if r.conv_id < 3} == {1: 4, 2: 4}


@pytest.mark.parametrize("block", [2, 3, 256])
def test_blocks_of_a_long_conversation_decode_like_one(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    share = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = transcripts.RoleModel(share(1, 6)[0], share(6, 6), [share(6, s) for s in transcripts.SIZES])
    texts = ["User: hi", None, "- so?", "", "plain words here.", "AI: well\n\nmore", "Bob: no"]
    rows = [(1, i * 3, t) for i, t in enumerate(texts)] + [(1, 0, "User: hi"), (None, None, "x"), (2, 5, "")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, text string")
    monkeypatch.setattr(transcripts, "BLOCK", block)
    found = [r for r in transcripts.format_chats(df, model).collect()]
    roles = [x for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.block) for x in r.line_roles]
    lines, blank, _ = transcripts.lines_of(texts)
    _, states = viterbi_by_hand(model, lines, blank)
    assert roles == [transcripts.ROLES[s // 2] for s in states]
    assert [r.n_lines for r in found if r.conv_id is None] == [1]
    assert transcripts.format_chats(df.limit(0), model).count() == 0
