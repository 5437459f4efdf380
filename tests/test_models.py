"""Properties of features, models and scores."""

import random
import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tunetrail.operators import evaluate, features, models
from tunetrail.plans import training
from tunetrail.plans.features import add_features
from tunetrail.plans.training import (compare, fit_sequence_model, fit_skip_tree, fit_snapshot_models,
                                      prepare_snapshot, sequence_table, wordcloud)
from tunetrail.plans.queries import QUERIES
from tunetrail.schema import (GRID_BOOSTED_AUDIO, GRID_BOOSTED_LYRICS, GRID_ELASTIC_AUDIO, GRID_ELASTIC_LYRICS,
                              GRID_ELASTIC_WORDS, POINT_BOOSTED_AUDIO, POINT_BOOSTED_LYRICS, POINT_ELASTIC_LYRICS,
                              SCALED_AUDIO)


@pytest.fixture(scope="module")
def planted(spark):
    """y follows x0; x1 … x3 are noise."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.4).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "play_id int, skipped int, x array<double>")
    return features.with_class_weight(df.withColumn("features", array_to_vector("x"))).cache()


def test_zscore_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (6.0, 5.0, 3.0)], "a double, b double, c double")
    rows = features.zscore_apply(df, features.zscore_fit(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()
    want = (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])
    assert np.allclose([r.a for r in rows], want)
    assert [r.b for r in rows] == [0.0] * 3
    assert [r.c for r in rows] == [-1.0, None, 1.0]


def test_weights(spark):
    df = spark.createDataFrame([(y,) for y in [0] * 30 + [1] * 10], "skipped int")
    total = features.with_class_weight(df).agg(F.sum("weight")).head()[0]
    assert abs(total - 40) < 1e-9
    positive = features.with_class_weight(df, mode="positive").groupBy("skipped").agg(F.max("weight").alias("w")).collect()
    assert {r.skipped: r.w for r in positive} == {0: 1.0, 1: 3.0}
    assert features.class_ratio(df).head().ratio == 3.0


def test_dummies_and_codes(spark):
    df = spark.createDataFrame([("Night",), ("Afternoon",), (None,)], "time_of_day string")
    assert [tuple(r)[1:] for r in features.tod_dummies(df).collect()] == [(0, 0, 1), (0, 0, 0), (0, 0, 0)]
    codes = {r.time_of_day: r.time_of_day_encoded for r in features.label_encode(df, "time_of_day").collect()}
    assert codes == {"Afternoon": 0, "Night": 1, None: None}


def test_grid_points():
    every = models.grid_points({"a": [1, 2], "b": [3, 4, 5]})
    assert len(every) == 6 and every[0] == {"a": 1, "b": 3}
    sample = models.grid_points(GRID_BOOSTED_LYRICS, 50)
    assert len(sample) == 50 == len({tuple(p.items()) for p in sample})
    assert sample == models.grid_points(GRID_BOOSTED_LYRICS, 50)


def test_l1_zeroes_noise_and_keeps_signal(planted):
    model, point = models.fit_elastic_net(planted, {"l1_ratio": [1.0], "C": [0.02]})
    coefficients = model.coefficients.toArray()
    assert coefficients[0] > 0 and np.all(coefficients[1:] == 0)
    assert point == {"l1_ratio": 1.0, "C": 0.02}


def test_elastic_net_is_optimal_for_the_summed_objective(planted):
    """Gradient of C · Σ w · loss + ridge vanishes at the fit."""
    c = 0.5
    model, _ = models.fit_elastic_net(planted, {"l1_ratio": [0.0], "C": [c]})
    rows = planted.select("x", "skipped", "weight").collect()
    x, y, w = (np.array([r[k] for r in rows], dtype=float) for k in ("x", "skipped", "weight"))
    beta = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.allclose(c * x.T @ (w * (p - y)) + beta, 0, atol=1e-3)


def test_tuning_prefers_the_planted_signal(planted):
    model, point = models.fit_elastic_net(planted, {"l1_ratio": [0.5], "C": [0.0001, 1.0]}, folds=3)
    assert point["C"] == 1.0
    boosted, _ = models.fit_boosted(planted, {"n_estimators": [5], "max_depth": [2], "learning_rate": [0.1], "subsample": [0.8],
                                              "colsample_bytree": [0.6], "min_child_weight": [3]})
    report = {r["class"]: r for r in evaluate.classification_metrics(boosted.transform(planted)).collect()}
    assert report["accuracy"].f1 > 0.85
    assert evaluate.importance_table(planted.sparkSession, boosted, ["x0", "x1", "x2", "x3"], 1).head().feature == "x0"


def test_tree_rules(planted):
    tree = models.fit_tree(planted, 2)
    text = evaluate.tree_rules(tree, ["first", "second", "third", "fourth"])
    assert "If (first <=" in text and "feature 0" not in text


def test_report_equals_hand_count(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 4 + [(None, 1)]
    df = spark.createDataFrame(pairs, "skipped int, prediction int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in evaluate.classification_metrics(df).collect()}
    assert got["1"] == (round(4 / 6, 6), 0.8, round(8 / 11, 6), 5)
    assert got["0"][3] == 7 and got["accuracy"][2] == 0.75 and got["weighted avg"][1] == 0.75


def test_report_without_positive_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "skipped int, prediction int")
    got = {r["class"]: r.precision for r in evaluate.classification_metrics(df).collect()}
    assert got["1"] == 0.0


def test_roc_auc_is_lazy_and_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.3), float(x)) for x in np.round(rng.normal(size=700) * 40, 1)]
    rows += [(1, 1e300), (0, -1e300), (1, 1e-300), (0, 0.0), (None, 0.5), (1, None)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("auc", "auc")
    df = spark.createDataFrame(rows, "skipped int, score double")
    area = evaluate.roc_auc(df)
    assert not tracker.getJobIdsForGroup("auc")
    known = [r for r in rows if None not in r]
    pos, neg = np.array([s for y, s in known if y]), np.array([s for y, s in known if not y])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(area.head().auc - want) < 1e-12
    assert evaluate.roc_auc(df.where("skipped = 1")).head().auc is None
    assert evaluate.roc_auc(df.limit(0)).head().auc is None


def test_roc_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 6))) for _ in range(150)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(evaluate.roc_auc(spark.createDataFrame(rows, "skipped int, score double")).head().auc - want) < 1e-9


def test_explain_windows(spark):
    df = spark.createDataFrame([(1, [(0.2, 7.0, "Pop"), (0.6, 7.0, "Rap")])],
                               "play_id int, seq array<struct<energy:double,tempo:double,primary_genre:string>>")
    got = {(r.step, r.feature): (r.genre, r.intensity) for r in evaluate.explain_windows(df, ["energy", "tempo"]).collect()}
    assert got == {("t-2", "energy"): ("Pop", 0.0), ("t-2", "tempo"): ("Pop", 0.5),
                   ("t-1", "energy"): ("Rap", 1.0), ("t-1", "tempo"): ("Rap", 0.5)}


@pytest.fixture(scope="module")
def listening(spark):
    """60 tracks; loud ones whose lyrics say `noise` are skipped."""
    rng = random.Random(9)
    tracks = [(t, f"n{t}", f"a{t % 5}", f"['g{t % 4}', 'pop']", *[rng.random() for _ in SCALED_AUDIO]) for t in range(60)]
    library = spark.createDataFrame(tracks, "track_id int, track_name string, artist string, genres string, "
                                    + ", ".join(f"{c} double" for c in SCALED_AUDIO))
    loud = {t[0]: t[4 + SCALED_AUDIO.index("loudness")] > 0.5 for t in tracks}
    rows = [(i, i % 3, rng.randrange(60)) for i in range(900)]
    plays = spark.createDataFrame([(i, u, t, int(loud[t] if rng.random() < 0.9 else not loud[t])) for i, u, t in rows],
                                  "play_id int, user_id int, track_id int, skipped int")
    plays = plays.withColumn("ts", F.expr("timestampadd(MINUTE, play_id * 2, timestamp_ntz'2024-01-01 00:00:00')"))
    texts = [(t, ("noise loud night " if loud[t] else "calm soft night ") + rng.choice(["sea", "sun", "moon"])) for t in range(60)]
    lyrics = spark.createDataFrame(texts, "track_id int, lyrics string")
    return add_features(plays.join(library, "track_id")).cache(), lyrics


def test_snapshot_models_and_scoreboard(spark, listening):
    plays, lyrics = listening
    train, test, names = prepare_snapshot(plays, lyrics, max_df=1.0)
    assert train.count() + test.count() == 900
    assert "lyric_noise" in names["with_lyrics"] and "lyric_noise" not in names["audio_only"]
    assert len(train.head().with_lyrics) == len(names["with_lyrics"])
    small = {
        "words": ("with_lyrics", "elastic", {"l1_ratio": [0.5], "C": [1.0]}, 3, "roc_auc", None),
        "trees": ("audio_only", "boosted", {"n_estimators": [3], "max_depth": [2]}, 3, "accuracy", None)}
    fitted = fit_snapshot_models(train, small)
    board = {(r.model, r.metric): r.value for r in compare(fitted, test).collect()}
    assert len(board) == 8 and all(0 <= v <= 1 for v in board.values())
    assert board[("words", "Accuracy")] > 0.8
    top = evaluate.coefficient_table(spark, fitted["words"][0], names["with_lyrics"], 4).collect()
    assert "lyric_noise" in {r.feature for r in top}


def test_wordcloud_signs(spark, listening):
    plays, lyrics = listening
    texts = lyrics.withColumn("skipped", F.col("lyrics").startswith("noise").cast("int"))
    rows = {r.word: r for r in wordcloud(texts, key="track_id", grid={"l1_ratio": [0.1], "C": [10.0]}, max_df=1.0).collect()}
    assert rows["noise"].category == "skip" and rows["calm"].category == "listen"
    assert rows["noise"].importance == abs(rows["noise"].coefficient)


def test_skip_tree(listening):
    model, names = fit_skip_tree(listening[0], ["g0", "g1"])
    assert model.depth <= 3 and names[0] == "dominant_genre"
    assert model.featureImportances[names.index("loudness")] > 0.5


def test_sequence_model(listening):
    windows, names = sequence_table(listening[0], 20)
    model, scored = fit_sequence_model(windows, names, hidden=(4,), max_iter=5)
    total = windows.count()
    assert scored.count() == total - int(total * 0.8)
    first_test = scored.agg(F.min("ts")).head()[0]
    assert windows.where(F.col("ts") < first_test).count() <= int(total * 0.8)
    best = evaluate.confident_skips(scored, 0.0, 3).collect()
    assert [r.confidence for r in best] == sorted((r.confidence for r in best), reverse=True)
    assert {r.target for r in best} <= {1}


@pytest.fixture()
def asked(monkeypatch):
    """What the queries ask to be fitted, in order; small models are fitted in their place."""
    calls = []

    def elastic(train, grid, folds, *rest, **options):
        calls.append(("elastic", grid, folds, None))
        return models.fit_elastic_net(train, {"l1_ratio": [0.5], "C": [1.0]}, folds, *rest, **options)

    def boosted(train, grid, n_iter, folds, *rest, **options):
        calls.append(("boosted", grid, folds, n_iter))
        return models.fit_boosted(train, {"n_estimators": [2], "max_depth": [2]}, None, folds, *rest, **options)

    def network(train, n_inputs, hidden, seed, max_iter):
        calls.append(("network", n_inputs, hidden, max_iter))
        return models.fit_sequence(train, n_inputs, (2,), seed, max_iter=2)

    monkeypatch.setattr(training, "fit_elastic_net", elastic)
    monkeypatch.setattr(training, "fit_boosted", boosted)
    monkeypatch.setattr(training, "fit_sequence", network)
    return calls


SF = "/root/testdata/sf0.001"


def test_queries_fit_all_models_and_search_the_nine_points(spark, asked):
    """The queries fit one point of the three large grids, as a search there takes hours; see the README."""
    board = QUERIES["model_scoreboard"](spark, SF).collect()
    assert len(board) == 24 and len({r.model for r in board}) == 6
    assert asked[:4] == [("elastic", POINT_ELASTIC_LYRICS, 5, None), ("boosted", POINT_BOOSTED_LYRICS, 3, None),
                         ("elastic", GRID_ELASTIC_AUDIO, 5, None), ("boosted", POINT_BOOSTED_AUDIO, 3, None)]
    assert [a[0] for a in asked[4:]] == ["network", "network"] and asked[4][1] < asked[5][1]
    del asked[:]
    for name in ("model_coefficients", "model_importances", "wordcloud"):
        QUERIES[name](spark, SF)
    assert asked == [("elastic", POINT_ELASTIC_LYRICS, 5, None), ("boosted", POINT_BOOSTED_AUDIO, 3, None),
                     ("elastic", GRID_ELASTIC_WORDS, 5, None)]


def test_the_library_searches_the_declared_grids_and_the_points_are_theirs():
    wanted = {"elastic net + lyrics": (GRID_ELASTIC_LYRICS, 5, None), "boosted trees + lyrics": (GRID_BOOSTED_LYRICS, 3, 50),
              "elastic net": (GRID_ELASTIC_AUDIO, 5, None), "boosted trees": (GRID_BOOSTED_AUDIO, 3, None)}
    assert {n: (m[2], m[3], m[5]) for n, m in training.SNAPSHOT_MODELS.items()} == wanted
    for name, model in training.QUICK_MODELS.items():
        assert all(v in wanted[name][0][k] for k, values in model[2].items() for v in values)


def test_sequence_queries_use_the_defaults_and_real_lyrics(spark, asked, monkeypatch):
    limits = []
    confident = evaluate.confident_skips
    monkeypatch.setattr(evaluate, "confident_skips", lambda scored, threshold=0.85, n=3: (
        limits.append(threshold), confident(scored, threshold, n))[1])
    for name in ("sequence_confident_skips", "sequence_confident_skips_with_lyrics"):
        QUERIES[name](spark, SF).collect()
    assert [a[2:] for a in asked] == [((64,), 50)] * 2 and limits == [0.85] * 2
    assert asked[1][1] - asked[0][1] > 5 * 3


def test_first_trees_equal_a_fit_with_fewer_trees_and_nested_scores_equal_separate_fits(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from tunetrail.operators import models

    rows = [(i, float(i % 7), float(i * 13 % 11), float((i % 7 + i * 13 % 11 + i % 3) > 9)) for i in range(200)]
    train = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "play_id long, a double, b double, skipped double")).coalesce(1).cache()
    base = GBTClassifier(labelCol="skipped", seed=3, maxDepth=2)
    long = base.fit(train, {base.maxIter: 6})
    short = base.fit(train, {base.maxIter: 3})
    shown = lambda m: [tuple(r.probability) for r in m.transform(train).orderBy("play_id").collect()]
    assert shown(models.first_trees(long, 3)) == shown(short) != shown(long)
    to_param = {"n_estimators": lambda v: (base.maxIter, v), "max_depth": lambda v: (base.maxDepth, v)}
    points = models.grid_points({"n_estimators": [2, 5], "max_depth": [1, 2]})
    nested = models.nested_scores(base, points, to_param, train, "skipped", 2, "accuracy", "play_id", 42)
    dealt, evaluator = models._with_fold(train, "play_id", 2, 42), models._evaluator("accuracy", "skipped")
    apart = [sum(evaluator.evaluate(base.fit(dealt.where(f"_fold <> {k}"), dict(to_param[n](v) for n, v in p.items()))
                                    .transform(dealt.where(f"_fold = {k}"))) for k in range(2)) / 2 for p in points]
    assert nested == pytest.approx(apart)


def test_lyrics_are_not_sent_to_every_task(spark, listening, monkeypatch):
    from tunetrail.plans import features as plans

    plays, lyrics = listening
    plays = plays.localCheckpoint()
    joined = []
    words = plans.vocabulary
    monkeypatch.setattr(plans, "vocabulary", lambda docs, *rest, **options: (joined.append(docs), words(docs, *rest, **options))[1])
    vectors, _ = plans.lyric_vectors(plays, lyrics, max_df=1.0)
    monkeypatch.setattr(training, "PLAYS_PER_TASK", 100)
    windows, _ = sequence_table(plays, 20, lyric_vectors=vectors)
    joined.append(windows)
    terms, steps = [df._jdf.queryExecution() for df in joined]
    assert "ShuffledHashJoin" in terms.sparkPlan().toString() and "BroadcastHashJoin" not in terms.sparkPlan().toString()
    assert "ShuffledHashJoin" in steps.sparkPlan().toString()
    assert re.search(r"RepartitionByExpression \[user_id#\d+\], 9", steps.optimizedPlan().toString())
    assert windows.count() > 0 and windows.select("play_id").rdd.getNumPartitions() == 9


def test_a_search_that_fails_in_threads_runs_again_alone(planted, monkeypatch):
    from py4j.protocol import Py4JJavaError

    class Lost(Py4JJavaError):
        def __init__(self):
            Exception.__init__(self, "Task not serializable")
            self.java_exception = "Task not serializable"

        def __str__(self):
            return self.java_exception

    used, plain = [], models.CrossValidator

    class Tuner(plain):
        def fit(self, rows):
            used.append(self.getParallelism())
            if used[-1] > 1:
                raise Lost()
            return plain.fit(self, rows)

    monkeypatch.setattr(models, "CrossValidator", Tuner)
    _, point = models.fit_elastic_net(planted, {"l1_ratio": [0.5], "C": [0.0001, 1.0]}, folds=2)
    assert used == [4, 1] and point["C"] == 1.0


def test_counted_plays_fit_as_plays_do(spark, listening):
    """A track's equal plays are one weighted row: same features, weights and fits from far fewer rows."""
    plays, lyrics = listening
    train, test, names = prepare_snapshot(plays, lyrics, max_df=1.0)
    few, few_test, same = prepare_snapshot(plays, lyrics, max_df=1.0, count_from=900)
    assert same == names and prepare_snapshot(plays, None, count_from=901)[0].count() == train.count()
    for rows, counted in ((train, few), (test, few_test)):
        assert counted.count() < rows.count() == counted.agg(F.sum("plays")).head()[0]
    for weight in ("balanced", "positive"):
        assert few.agg(F.sum(weight)).head()[0] == pytest.approx(train.agg(F.sum(weight)).head()[0])
    shown = lambda df: sorted((r.skipped, *np.round(r.with_lyrics.toArray(), 9)) for r in df.select("skipped", "with_lyrics").distinct().collect())
    assert shown(few) == shown(train)
    point = {"l1_ratio": [0.5], "C": [1.0]}
    a, b = (models.fit_elastic_net(df, point, features="with_lyrics", weight="balanced")[0].coefficients.toArray() for df in (train, few))
    assert np.allclose(a, b, atol=0.01) and np.abs(a).max() > 0.5
    trees = {"n_estimators": [5], "max_depth": [2], "learning_rate": [0.1]}
    a, b = (models.fit_boosted(df, trees, features="audio_only", weight="positive")[0].featureImportances.toArray() for df in (train, few))
    assert np.allclose(a, b, atol=1e-6)


def test_counted_zscores_equal_those_of_the_plays(spark):
    rows = [(1.0, 1e9 + 1, 0.1, 3), (2.5, 1e9 + 2, 0.1, 4), (None, 1e9 + 4, 0.1, 2), (7.0, 1e9 + 9, 0.1, 1)]
    got = features.zscore_fit(spark.createDataFrame(rows, "a double, b double, c double, n long"), ["a", "b", "c"], times="n").head().asDict()
    a, b = np.repeat([1.0, 2.5, 7.0], [3, 4, 1]), np.repeat([1, 2, 4, 9], [3, 4, 2, 1])
    want = {"a_mean": a.mean(), "b_mean": 1e9 + b.mean(), "c_mean": 0.1, "a_std": a.std(), "b_std": b.std(), "c_std": 0.0}
    assert list(got) == list(want) and got["c_std"] == 0.0
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_assembled_vectors_are_the_assemblers_without_one_large_method(spark):
    from pyspark.ml.feature import VectorAssembler

    names = [f"x{i}" for i in range(40)]
    df = spark.range(50).select("id", *[F.when(F.col("id") % (i + 2) == 0, F.col("id") * i).otherwise(0.0).alias(n) for i, n in enumerate(names)])
    df = df.withColumn("v", array_to_vector(F.array("x1", "x2")))
    cols = [*names[:5], "v", *names[5:]]
    got = features.assemble(df, cols)
    assert got.columns == df.columns + ["features"]
    want = VectorAssembler(inputCols=cols, outputCol="features").transform(df.localCheckpoint())
    pairs = zip(got.orderBy("id").collect(), want.orderBy("id").collect(), strict=True)
    assert all(a.features == b.features and type(a.features) is type(b.features) for a, b in pairs)
    plan = features.assemble(df, names).select("features")._jdf.queryExecution().executedPlan().toString()
    packing = [line for line in plan.splitlines() if "array_to_vector" in line or "transform(" in line]
    assert packing and not any(re.match(r"\W*\*\(\d+\)", line) for line in packing)
    with pytest.raises(Exception, match="NULL or NaN"):
        features.assemble(df.withColumn("x3", F.lit(float("nan"))), names).select("features").collect()


def test_queries_of_single_points_count_equal_plays(spark, asked, monkeypatch):
    seen, fit = [], training.fit_snapshot_models
    monkeypatch.setattr(training, "COUNT_FROM", 1)
    monkeypatch.setattr(training, "fit_snapshot_models", lambda train, *rest: (seen.append(train.columns), fit(train, *rest))[1])
    for name in ("model_coefficients", "model_importances"):
        assert QUERIES[name](spark, SF).count() == 15
    assert all("plays" in columns and "play_id" not in columns for columns in seen) and len(seen) == 2


def test_plays_without_lyrics_are_left_out_before_the_library(spark, monkeypatch):
    from tunetrail.plans import queries, testviews

    given = []
    monkeypatch.setattr(training, "prepare_snapshot", lambda plays, *rest, **options: given.append(plays))
    queries.prepared(spark, SF)
    wide = testviews.clean_order_plays(spark, SF).join(testviews.lyrics(spark, SF).select("track_id"), "track_id", "left_semi")
    assert given[0].columns == wide.columns and given[0].exceptAll(wide).isEmpty() and wide.exceptAll(given[0]).isEmpty()
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda text: next(len(re.match(r"[\W]*", line)[0]) for line in plan.splitlines() if text in line)
    assert depth("LeftSemi") > depth("Join Inner")


@pytest.mark.parametrize("kind", ["of PySpark", "of py4j"])
def test_no_fit_of_the_failed_search_runs_beside_the_second(planted, monkeypatch, kind):
    from threading import Lock
    from time import sleep

    from py4j.protocol import Py4JJavaError
    from pyspark.errors.exceptions.captured import NumberFormatException

    class Lost(Py4JJavaError):
        def __init__(self):
            Exception.__init__(self, "Task not serializable")

        def __str__(self):
            return "Task not serializable"

    error = Lost() if kind == "of py4j" else NumberFormatException("Cannot parse null string", stackTrace="")
    lock, running, searches, beside, plain = Lock(), [], [], [], models.CrossValidator
    fit = models.LogisticRegression._fit

    class Tuner(plain):
        def fit(self, rows):
            searches.append(self.getParallelism())
            return plain.fit(self, rows)

    def watched(self, rows):
        with lock:
            first = not running and len(searches) == 1 and not beside
            if len(searches) == 2:
                beside.append(len(running) - running.count("done"))
            running.append("fit")
        try:
            if first:
                raise error
            if len(searches) == 1:
                sleep(2)
            return fit(self, rows)
        finally:
            with lock:
                running[running.index("fit")] = "done"

    monkeypatch.setattr(models, "CrossValidator", Tuner)
    monkeypatch.setattr(models.LogisticRegression, "_fit", watched)
    _, point = models.fit_elastic_net(planted, {"l1_ratio": [0.5, 1.0], "C": [0.0001, 1.0, 2.0]}, folds=2)
    assert searches == [4, 1] and len(beside) >= 13 and set(beside) == {0} and point["C"] > 0.1


def test_a_search_scores_as_that_of_spark(planted):
    from pyspark.ml.tuning import CrossValidator

    base = models.LogisticRegression(labelCol="skipped", weightCol="weight", maxIter=20)
    maps = [{base.regParam: r, base.elasticNetParam: a} for r in (0.001, 0.3) for a in (0.0, 0.5)]
    options = {"estimator": base, "estimatorParamMaps": maps, "evaluator": models._evaluator("roc_auc", "skipped"),
               "numFolds": 3, "foldCol": "_fold", "parallelism": 4}
    dealt = models._with_fold(planted, "play_id", 3, 42)
    ours, theirs = (kind(**options).fit(dealt) for kind in (models.CrossValidator, CrossValidator))
    assert ours.avgMetrics == list(theirs.avgMetrics)
    assert ours.bestModel.coefficients == theirs.bestModel.coefficients


def test_a_session_with_job_tags_can_search_and_score(spark, planted):
    """Tags are what a time limit on jobs sets; with them a session cannot be sent to tasks."""
    tagged = spark.newSession()
    tagged.addTag("limit")
    try:
        rows = planted.select("play_id", "skipped", "weight", "features")
        rows = tagged.createDataFrame(rows.collect(), rows.schema)
        model, point = models.fit_elastic_net(rows, {"l1_ratio": [0.5], "C": [0.0001, 1.0]}, folds=2, metric="accuracy")
        assert point["C"] == 1.0
        assert models._evaluator("accuracy", "skipped").evaluate(model.transform(rows)) > 0.85
        network = models.fit_sequence(rows, 4, (2,), label="skipped", max_iter=5)
        assert network.transform(rows).groupBy("prediction").count().agg(F.sum("count")).head()[0] == 400
    finally:
        tagged.removeTag("limit")


def test_a_search_sees_every_row_and_takes_all_steps(spark, monkeypatch):
    """Every fit of a search gets the weight of all rows outside its fold, equal rows as one, and its score all rows in it."""
    rows, seen, held = 120_000, [], []
    i = F.col("id")
    df = spark.range(rows).select(
        i.alias("play_id"), ((i % 10 < 4) != (i % 7 == 0)).cast("int").alias("skipped"), F.lit(1.5).alias("weight"),
        array_to_vector(F.array((i % 10).cast("double"), (i % 4).cast("double"))).alias("features"))
    fit, score = models.LogisticRegression._fit, models.MulticlassClassificationEvaluator._evaluate

    def watched(self, df):
        seen.append((self.getMaxIter(), df.count(), df.agg(F.sum("weight")).head()[0]))
        return fit(self, df)

    def counted(self, df):
        held.append(df.agg(F.sum("_times")).head()[0])
        return score(self, df)

    monkeypatch.setattr(models.LogisticRegression, "_fit", watched)
    monkeypatch.setattr(models.MulticlassClassificationEvaluator, "_evaluate", counted)
    grid = {"l1_ratio": [0.5], "C": [0.00001, 1.0]}
    model, point = models.fit_elastic_net(df, grid, folds=2, metric="accuracy", parallelism=1)
    search, last = seen[:4], seen[-1]
    assert {steps for steps, _, _ in seen} == {200} and all(n <= 40 for _, n, _ in search) and last[1] == rows
    assert search[0][2] + search[2][2] == pytest.approx(1.5 * rows) and held[0] + held[2] == rows

    monkeypatch.setattr(models.LogisticRegression, "_fit", fit)
    monkeypatch.setattr(models.MulticlassClassificationEvaluator, "_evaluate", score)
    base = models.LogisticRegression(weightCol="weight", labelCol="skipped", maxIter=200, standardization=False, tol=1e-6)
    maps = [{base.elasticNetParam: 0.5, base.regParam: 1 / (c * 1.5 * rows / 2)} for c in grid["C"]]
    plays = models._with_fold(df, "play_id", 2, 42).cache()
    common = {"estimator": base, "estimatorParamMaps": maps, "numFolds": 2, "foldCol": "_fold"}
    whole = models.CrossValidator(evaluator=models._evaluator("accuracy", "skipped"), **common).fit(plays)
    merged = models.CrossValidator(evaluator=models._evaluator("accuracy", "skipped").setWeightCol("_times"), **common).fit(
        models.counted_folds(df, "skipped", "features", "weight", "play_id", 2, 42).cache())
    assert merged.avgMetrics == pytest.approx(whole.avgMetrics, abs=1e-9)
    assert np.allclose(merged.bestModel.coefficients, whole.bestModel.coefficients, atol=1e-4)


def test_snapshot_models_are_fitted_side_by_side_and_a_failed_one_again_alone(planted, monkeypatch):
    from threading import Barrier

    from pyspark.errors.exceptions.captured import NumberFormatException

    met, begun, ended = Barrier(3), [], []

    def fit(name):
        def fitted(train, *rest, **options):
            begun.append(name)
            if len(begun) <= 3:
                met.wait(60)
                ended.append(name)
                if name == "boosted":
                    raise NumberFormatException("Cannot parse null string", stackTrace="")
            return name, sorted(ended)
        return fitted

    monkeypatch.setattr(training, "fit_elastic_net", fit("elastic"))
    monkeypatch.setattr(training, "fit_boosted", fit("boosted"))
    table = {name: ("features", kind, {}, 2, "accuracy", None) for name, kind in (("a", "elastic"), ("b", "boosted"), ("c", "elastic"))}
    fitted = fit_snapshot_models(planted, table)
    assert begun == ["elastic", "boosted", "elastic", "boosted"] and list(fitted) == ["a", "b", "c"]
    assert fitted["b"] == ("boosted", ["boosted", "elastic", "elastic"], "features")


def test_class_weights_are_worked_out_once_for_all_fits(listening):
    plays, lyrics = listening
    train, test, _ = prepare_snapshot(plays, lyrics, max_df=1.0)
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join LeftOuter" in plan
    for mode in ("balanced", "positive"):
        want = {r.skipped: r.weight for r in features.class_weights(train, mode=mode).collect()}
        got = {r.skipped: r[mode] for r in train.select("skipped", mode).distinct().collect()}
        assert len(want) == 2 and got == pytest.approx(want)
