import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tunetrail.operators import stats
from tunetrail.operators.dedupe import duplicate_count, first_per_key
from tunetrail.operators.heavy import heavy_rows
from tunetrail.schema import CORRELATED


@pytest.mark.parametrize("deletion", ["pairwise", "listwise"])
def test_correlations_equal_pandas(spark, deletion):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(100, 3, 200), "b": rng.normal(size=200), "c": 5.0})
    pdf["d"] = pdf.a * 2 + rng.normal(size=200)
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "b"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double")
    want = (pdf.dropna() if deletion == "listwise" else pdf).corr()
    got = {(r.Variable1, r.Variable2): r.Correlation for r in stats.corr_long(df, list(pdf.columns), deletion, 6).collect()}
    assert len(got) == 16
    for (x, y), r in got.items():
        if "c" in (x, y):
            assert r is None
        else:
            assert abs(r - want.loc[x, y]) < 1e-6


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(float(i), float(i * i), None if i == 3 else -float(i)) for i in range(10)], "a double, b double, c double")
    matrix = stats.corr_matrix(df, ["a", "b", "c"])
    assert matrix.shape == (3, 3) and abs(matrix[0, 2] + 1) < 1e-9


def test_correlation_of_nothing(spark):
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in CORRELATED))
    rows = stats.corr_long(df).collect()
    assert len(rows) == 196 and {r.Correlation for r in rows} == {None}


def test_count_quantile_interpolates(spark):
    rng = random.Random(1)
    values = [rng.randint(1, 9) for _ in range(77)]
    counts = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, play_count long")
    assert stats.count_quantile(counts, 0.25).head()[0] == np.quantile(values, 0.25)
    kept = {r.k for r in stats.frequent_only(counts).collect()}
    assert kept == {i for i, v in enumerate(values) if v > np.quantile(values, 0.25)}


def test_wide_stats_with_ties_and_null_keys(spark):
    rows = [("a", 1)] * 3 + [("b", 1)] * 3 + [("c", 0)] * 5 + [("d", 0)] + [("a", 0)] + [(None, 1)] * 9
    df = spark.createDataFrame(rows, "artist string, skipped int")
    got = [tuple(r) for r in stats.wide_stats(df, "artist", 1).collect()]
    assert got == [("c", 0, 5), ("a", 3, 1)]


@pytest.mark.parametrize("shape", ["skewed", "flat", "tied", "few", "none"])
@pytest.mark.parametrize("buckets", [4, 512])
def test_top_lists_of_many_keys_equal_full_ones(spark, shape, buckets):
    rng = random.Random(f"{shape}{buckets}")
    key = {"skewed": lambda: rng.choice([f"h{rng.randrange(4)}", f"k{rng.randrange(3000)}", None]),
           "flat": lambda: f"k{rng.randrange(500)}", "tied": lambda: f"k{rng.randrange(3)}", "few": lambda: "only", "none": lambda: None}[shape]
    rows = [(key(), rng.choice(["x", "y"]), rng.choice([0, 1, None]), rng.choice([0, 1, 5, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "artist string, name string, skipped int, times int")
    for keys in ("artist", ["artist", "name"]):
        for times in (None, "times"):
            assert stats.wide_stats_of_many(df, keys, 5, times, buckets).collect() == stats.wide_stats(df, keys, 5, times).collect()
    assert stats.frequent_values(df, "artist", 7, buckets=buckets).collect() == stats.value_counts(df, "artist", 7).collect()
    known = df.where("times > 0")
    assert stats.frequent_values(known, "artist", 7, "times", buckets).collect() == stats.value_counts(known, "artist", 7, "times").collect()


def test_only_keys_that_can_be_in_a_list_are_grouped(spark):
    keys = F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.col("id") + 100)
    df = spark.range(60000).select(keys.alias("key"))
    kept = heavy_rows(df, "key", [F.lit(1)], 5, buckets=1024)
    assert df.distinct().count() > 40000 and kept.distinct().count() < 600
    # The same keys, none of them heavy: all are kept, the plain aggregate is the way then.
    assert heavy_rows(df.distinct(), "key", [F.lit(1)], 5, buckets=1024).count() == df.distinct().count()


def test_top_lists_hold_no_zero_counts(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "artist string, skipped int")
    assert [tuple(r) for r in stats.wide_stats(df, "artist", 10).collect()] == [("a", 0, 1), ("b", 0, 1)]


def test_hour_extremes_take_the_earliest_hour_on_ties(spark):
    hourly = spark.createDataFrame([(h, 10, s, s * 10.0) for h, s in [(0, 3), (1, 5), (2, 5), (3, 3)]],
                                   "hour int, total_plays long, total_skips long, skip_rate double")
    assert {r.kind: r.hour for r in stats.hour_extremes(hourly).collect()} == {"most impatient": 1, "most chill": 0}


def test_time_of_day_rates_keep_empty_parts(spark):
    plays = spark.createDataFrame([("Morning", 1), ("Morning", 0), ("Night", 0)], "time_of_day string, skipped int")
    rows = stats.tod_skip_rate(plays).collect()
    assert [(r.time_of_day, r.skip_rate, r.plays, r.direction) for r in rows] == [
        ("Morning", 50.0, 2, "up"), ("Afternoon", None, 0, None), ("Evening", None, 0, None), ("Night", 0.0, 1, "down")]


def test_kpis_and_distribution(spark):
    plays = spark.createDataFrame([(1,), (0,), (0,)], "skipped int")
    assert {r.Metric: r.Value for r in stats.kpi_summary(plays).collect()} == {"Total Songs": 3.0, "Total Skips": 1.0, "Skip Rate": 0.3333}
    assert {r.skipped: (r.plays, r.percent, r.listen_skip_ratio) for r in stats.class_distribution(plays).collect()} == {
        0: (2, 66.6667, 2.0), 1: (1, 33.3333, 2.0)}


def test_genres_and_categories(spark):
    plays = spark.createDataFrame([(1, ["a", "b"]), (0, ["a"]), (0, []), (0, None)], "skipped int, genres_list array<string>")
    assert [tuple(r) for r in stats.top_genres(plays, 1).collect()] == [("a", 2)]
    share = {(r.skipped, r.genre): r.percent for r in stats.genre_share(plays).collect()}
    assert share == {(1, "a"): 50.0, (1, "b"): 50.0, (0, "a"): 100.0}
    kinds = spark.createDataFrame([("Other",), ("Pop",), ("Pop",)], "g string")
    assert {r.g: (r.plays, r.categories, r.default_plays) for r in stats.category_report(kinds, "g").collect()} == {
        "Other": (1, 2, 1), "Pop": (2, 2, 1)}


def test_heatmap_and_hourly(spark):
    plays = spark.createDataFrame([(0, 9, 1), (0, 9, 0), (6, 23, 1), (None, None, 1)], "day_of_week int, hour int, skipped int")
    assert {(r.day_label, r.hour): (r.total_skips, r.total_plays, r.skip_rate) for r in stats.skip_heatmap(plays).collect()} == {
        ("Mon", 9): (1, 2, 0.5), ("Sun", 23): (1, 1, 1.0)}
    assert {r.time_label: r.skip_rate for r in stats.hourly_skip(plays).collect()} == {"9:00 AM": 50.0, "11:00 PM": 100.0}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert sorted(r.v for r in first_per_key(df, "k", ["o"]).collect()) == ["w", "y"]
    assert tuple(duplicate_count(df, "k").head()) == (4, 3, 1)


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS k")
    plan = first_per_key(df, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
