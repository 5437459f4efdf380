"""Named queries against DuckDB on the smallest tables.

All of them with TUNETRAIL_ALL_QUERIES=1; otherwise one per area.
"""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["skip_heatmap", "clean_plays", "genre_share_top10", "wide_songs", "heavy_listener_windows", "chronological_split",
          "played_vocab_top100", "lyrics_tfidf", "correlations", "vibe_top5", "strat_split", "page_lyrics"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("TUNETRAIL_ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall())
    assert got == want


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
