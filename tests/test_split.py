import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tunetrail.operators import split
from tunetrail.operators.split import stratified_split, time_split


@pytest.mark.parametrize("n, rank_rows", [(0, 9), (1, 0), (4, 9), (237, 1_000_000), (237, 0)])
def test_stratified_split_is_exact_and_repeatable(spark, n, rank_rows):
    rng = random.Random(n)
    rows = [(i, rng.choice([0, 0, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "play_id long, skipped int")
    got = {r.play_id: r.split for r in stratified_split(df, rank_rows=rank_rows).collect()}
    want = {}
    for label in (0, 1):
        ids = sorted((i for i, y in rows if y == label), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        for position, i in enumerate(ids):
            want[i] = "train" if position < int(len(ids) * 0.8) else "test"
    assert got == want
    assert got == {r.play_id: r.split for r in stratified_split(df.repartition(3)).collect()}


def test_rows_without_a_class_have_no_split(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 0) for i in range(10)], "play_id long, skipped int")
    assert {r.play_id for r in stratified_split(df).where("split IS NULL").collect()} == {3}


@pytest.mark.parametrize("rank_rows", [0, 50, 1_000_000])
@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("spread", [0, 10_000_000])
def test_time_split_is_exact_with_ties(spark, spread, kind, rank_rows):
    rng = random.Random(spread)
    name = (lambda i: i * 2 ** 18) if kind == "long" else (lambda i: f"play-{i * 37:09d}")
    rows = [(name(i), datetime(2024, 1, 1) + timedelta(microseconds=rng.randint(0, spread) * 977)) for i in range(203)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"play_id {kind}, ts timestamp_ntz")
    got = {r.play_id for r in time_split(df, rank_rows=rank_rows).where("split = 'train'").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:int(203 * 0.8)]}


def test_splits_are_exact_on_repeated_keys(spark):
    df = spark.createDataFrame([("same", y, i) for i, y in enumerate([0] * 6 + [1] * 4)], "play_id string, skipped int, i int")
    for rank_rows in (0, 1_000_000):
        got = stratified_split(df, rank_rows=rank_rows).groupBy("skipped", "split").count().collect()
        assert {(r.skipped, r.split): r["count"] for r in got} == {(0, "train"): 4, (0, "test"): 2, (1, "train"): 3, (1, "test"): 1}
    timed = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert time_split(timed).where("split = 'train'").count() == 8


def test_prefixed_text_keys_are_narrowed_before_ranking(spark):
    df = spark.range(3000).select(F.concat(F.lit("urn:listening:play:"), F.col("id").cast("string")).alias("k"))
    seen = []
    original = split._narrow
    split._narrow = lambda *a: seen.append(original(*a)) or seen[-1]
    try:
        keys = df.withColumn("at", F.lit(1))
        found = split.rank_cut(keys, ["at", "k"], ["at"], 0.5, rank_rows=100)
    finally:
        split._narrow = original
    assert seen[-1][2] <= 100 < seen[0][2]
    assert found[0][0][1] == sorted(r.k for r in df.collect())[1499]


@pytest.mark.parametrize("rank_rows", [0, 1_000_000])
def test_tied_rows_are_cut_by_hash_and_equal_rows_by_count(spark, rank_rows, monkeypatch):
    """One key for all rows, some of them equal throughout: exact counts, no row lost, no window over them."""
    monkeypatch.setattr(split, "PORTION", 7)
    rows = [("same", 0, 5)] * 90 + [("same", 0, i) for i in range(6, 16)] + [("same", 1, i) for i in range(40)]
    df = spark.createDataFrame(rows, "play_id string, skipped int, i int")
    out = stratified_split(df, rank_rows=rank_rows)
    got = out.collect()
    assert sorted((r.play_id, r.skipped, r.i) for r in got) == sorted(rows)
    assert {(y, s): sum(r.skipped == y and r.split == s for r in got) for y in (0, 1) for s in ("train", "test")} == {
        (0, "train"): 80, (0, "test"): 20, (1, "train"): 32, (1, "test"): 8}
    again = stratified_split(df.repartition(5), rank_rows=rank_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_narrow_table_with_the_tie_hash_is_split_as_the_wide_one(spark):
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([(1, i % 2, f"t{i}", i) for i in range(40)], "play_id int, skipped int, title string, n int")
    want = {r.n: r.split for r in stratified_split(wide).collect()}
    narrow = wide.select("play_id", "skipped", "n", F.xxhash64(*wide.columns).alias("_tie"))
    got = {r.n: r.split for r in stratified_split(narrow, tie="_tie").collect()}
    assert got == want and list(got.values()).count("train") == 32
