"""Sessions and windows against a plain Python walk through each listener's plays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tunetrail.operators import sessions
from tunetrail.operators.sessions import sequence_windows, sessionize, with_segments

START = datetime(2024, 1, 1)


def plays_of(spark, rows):
    return spark.createDataFrame(rows, "play_id long, user_id long, ts timestamp_ntz, skipped int, energy double")


def random_rows(seed, n=600):
    """One listener holds most plays; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rng.random() < 0.7 else rng.randint(2, 9)
        at = START + timedelta(minutes=rng.choice([0, 5, 20, 21]) * rng.randint(0, 400))
        if i % 7 == 0:
            user = None
        if i % 13 == 0:
            at = None
        if i % 3 == 0:  # one busy hour
            user, at = 1, START + timedelta(days=3, seconds=i * 5)
        rows.append((i, user, at, rng.randint(0, 1), rng.random()))
    return rows


def walk(rows, gap, min_plays):
    """{play_id: (session_no, session_plays)} and the ordered sessions."""
    out, sessions = {}, []
    for user in {r[1] for r in rows}:
        number, previous, current = 0, None, []
        for row in sorted((r for r in rows if r[1] == user and r[2] is not None), key=lambda r: (r[2], r[0])):
            if previous is None or (row[2] - previous).total_seconds() / 60 > gap:
                number += 1
                current = []
                sessions.append((number, current))
            current.append(row)
            previous = row[2]
    for number, session in sessions:
        if len(session) >= min_plays:
            out.update({r[0]: (number, len(session)) for r in session})
    return out, [s for _, s in sessions if len(s) >= min_plays]


def test_gap_of_exactly_the_limit_stays_in_the_session(spark):
    rows = [(0, 1, START, 0, 0.0), (1, 1, START + timedelta(minutes=20), 0, 0.0),
            (2, 1, START + timedelta(minutes=40, seconds=1), 0, 0.0)]
    got = {r.play_id: r.session_no for r in sessionize(plays_of(spark, rows), 20, 1).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


@pytest.mark.parametrize("hot_rows", [None, 5_000_000, 50, 5, 0])
@pytest.mark.parametrize("min_plays", [1, 3])
def test_sessions_equal_a_walk(spark, hot_rows, min_plays):
    rows = random_rows(7)
    got = sessionize(plays_of(spark, rows), 20, min_plays, hot_rows=hot_rows).collect()
    want, _ = walk(rows, 20, min_plays)
    assert {r.play_id: (r.session_no, r.session_plays) for r in got} == want


@pytest.mark.parametrize("hot_rows", [None, 50, 5, 0])
def test_windows_equal_a_walk(spark, hot_rows):
    rows = random_rows(11)
    sessions = sessionize(plays_of(spark, rows), 20, 3, hot_rows=hot_rows)
    got = {r.play_id: ([s.energy for s in r.seq], r.target) for r in sequence_windows(sessions, ["energy"], n_steps=5).collect()}
    want = {}
    for session in walk(rows, 20, 3)[1]:
        for i in range(5, len(session)):
            want[session[i][0]] = ([p[4] for p in session[i - 5:i]], session[i][3])
    assert got == want


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_one_shuffle_of_plays_for_sessions_and_windows(spark):
    """By default one exchange carries plays; with heavy listeners the stored plays are dealt already."""
    plays = plays_of(spark, random_rows(3))
    plan = final_plan(sequence_windows(sessionize(plays, 20, 3), ["energy"]))
    raw = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "_segment" in x]
    assert len([x for x in raw if "Reused" not in x]) <= 2  # the plays, and the empty tails
    stored = sessionize(plays, 20, 3, hot_rows=20)
    assert not [x for x in final_plan(stored).split("\n") if "Exchange hashpartitioning" in x and "energy" in x]


def test_segments_split_a_busy_hour(spark):
    plays = plays_of(spark, random_rows(5))
    segmented, heavy = with_segments(plays, hot_rows=20)
    assert heavy
    sizes = [r["count"] for r in segmented.where("user_id = 1").groupBy("_segment").count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 8


@pytest.mark.parametrize("name", ["long", "string"])
def test_plays_of_one_instant_are_cut(spark, name):
    """A listener whose plays all have one time, and a gap of a day before and after it."""
    rows = [(i, 1, START, i % 2, float(i)) for i in range(1000)]
    rows += [(1000 + i, 1, START + timedelta(days=d, minutes=i), 0, 0.5) for d in (-1, 1) for i in range(8)]
    plays = plays_of(spark, rows)
    if name == "string":
        plays = plays.withColumn("play_id", F.format_string("play-%06d", "play_id"))
    segmented, heavy = with_segments(plays, hot_rows=50)
    sizes = [r["count"] for r in segmented.groupBy("_segment").count().collect()]
    assert heavy and len(sizes) >= 10 and max(sizes) <= 250
    edges = segmented.groupBy("_segment").agg(F.min(F.struct("ts", "play_id")).alias("low"),
                                              F.max(F.struct("ts", "play_id")).alias("high")).orderBy("_segment").collect()
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(edges, edges[1:]))
    got = sessionize(plays, 20, 3, hot_rows=50)
    plain = sessionize(plays, 20, 3, hot_rows=None)
    columns = ["play_id", "session_no", "session_plays", "diff_minutes"]
    assert sorted(got.select(*columns).collect()) == sorted(plain.select(*columns).collect())
    seq = ["play_id", "seq", "target"]
    assert sorted(sequence_windows(got, ["energy"]).select(*seq).collect()) == \
        sorted(sequence_windows(plain, ["energy"]).select(*seq).collect())


def test_busy_minutes_are_ranked_in_tasks_by_plays_not_by_segments(spark, monkeypatch):
    rows = [(i, 1, START, 0, 0.5) for i in range(1500)] + [(i // 2, 2, START + timedelta(seconds=i % 30), 0, 0.5) for i in range(1500)]
    plays = plays_of(spark, rows)
    spark.sparkContext.setJobGroup("busy", "busy")
    segmented, _ = with_segments(plays, hot_rows=2)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("busy") for s in tracker.getJobInfo(j).stageIds
             if tracker.getStageInfo(s) is not None]
    spark.sparkContext.setJobGroup("", "")
    assert max(tasks) < 100
    assert {r["count"] for r in segmented.where("user_id = 1").groupBy("_segment").count().collect()} == {2}
    monkeypatch.setattr(sessions, "RANK_ROWS", 40)
    again, _ = with_segments(plays, hot_rows=2)
    columns = ["user_id", "ts", "play_id", "_segment"]
    assert sorted(again.select(*columns).collect()) == sorted(segmented.select(*columns).collect())
    apart = again.groupBy("user_id", "ts", "play_id").agg(F.count_distinct("_segment").alias("n"))
    assert apart.where("n > 1").isEmpty()


def test_empty_input(spark):
    sessions = sessionize(plays_of(spark, []), 20, 3)
    assert sessions.count() == 0
    assert sequence_windows(sessions, ["energy"]).count() == 0
