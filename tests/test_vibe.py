import random
from itertools import product
from math import sqrt

import pytest
from pyspark.sql import functions as F

from tunetrail.operators.vibe import BINS, vibe_top_k, vibe_tracks
from tunetrail.schema import MOOD_FEATURES


def tracks_of(spark, points):
    rows = [(f"t{i:04d}", "x", 1, *p, ["pop"]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "track_name string, artist string, play_count long, "
                                 + ", ".join(f"{f} double" for f in MOOD_FEATURES) + ", genres_list array<string>")


def brute(points, k=5):
    out = {}
    for combo in product(BINS, repeat=4):
        scored = sorted((sqrt(sum((a - c) * (a - c) for a, (_, c) in zip(p, combo))), f"t{i:04d}") for i, p in enumerate(points))
        out[tuple(n for n, _ in combo)] = [name for _, name in scored[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "one corner", "copies", "few", "outside"])
def test_top_k_equals_brute_force(spark, kind):
    rng = random.Random(5)
    point = lambda lo=0.0, hi=1.0: tuple(rng.uniform(lo, hi) for _ in range(4))
    points = {
        "spread": [point() for _ in range(400)],
        "one corner": [point(0.0, 0.2) for _ in range(60)],
        "copies": [(0.5, 0.5, 0.5, 0.5)] * 50 + [point() for _ in range(25)],
        "few": [point() for _ in range(3)],
        "outside": [point(-1.0, 2.0) for _ in range(100)],
    }[kind]
    got = {}
    for r in vibe_top_k(tracks_of(spark, points)).orderBy("rank").collect():
        got.setdefault(tuple(r[f"{f}_bin"] for f in MOOD_FEATURES), []).append(r.track_name)
    assert got == brute(points)


def test_labels_and_rounding(spark):
    rows = vibe_top_k(tracks_of(spark, [(0.83333, 0.83333, 0.83333, 0.16667)])).collect()
    assert len(rows) == 81
    labels = {tuple(r[f"{f}_bin"] for f in MOOD_FEATURES): r.vibe_label for r in rows}
    assert labels[("High", "High", "High", "Low")] == "🔥 Hype Mode!"
    assert labels[("Low", "Low", "Low", "Low")] == "🎵 Everyday Bop"
    assert {r.genre for r in rows} == {"Pop"} and {r.energy for r in rows} == {0.833}


def test_first_play_decides_the_features_and_rare_tracks_go(spark):
    plays = spark.createDataFrame(
        [(i, "a", "x", 0.1 if i else None) for i in range(4)] + [(i, "b", "x", 0.2) for i in range(10, 14)]
        + [(20, "c", "x", 0.3)], "play_id int, track_name string, artist string, v double")
    plays = plays.select("*", F.lit("2024-01-01").alias("ts"), F.array(F.lit("pop")).alias("genres_list"), *[F.col("v").alias(f) for f in MOOD_FEATURES])
    assert [r.track_name for r in vibe_tracks(plays).collect()] == ["b"]
