"""Ball-tree search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from tunetrail.llm import ball_tree

ITEM = "item_id long, text string"


def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranks_by_hand(texts, ids, items, most=50):
    words = [terms_by_hand(t) for t in texts]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    df = {}
    for w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item_id, text in items:
        terms = set(terms_by_hand(text))
        scores = []
        for w, i in zip(words, ids):
            score = 0
            for term in terms & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                m, tf = 50 + 50 * len(w) * n_docs // total, w.count(term)
                score += weight * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, 2**63 - 1 if i is None else i))
        out += [(item_id, k + 1, None if i == 2**63 - 1 else i, -s) for k, (s, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def sample(rng, size):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" + rng.choice(["", ",", "É", "-x"]) for _ in range(rng.randint(0, size)))


@pytest.mark.parametrize("most, item_bytes", [(5, 1 << 18), (50, 200)])
def test_ranks_equal_brute_force_in_one_block_and_many(spark, documents, most, item_bytes):
    rng = random.Random(most)
    texts = [rng.choice([None, "", "W1 w2", sample(rng, 200)]) if rng.random() < 0.2 else sample(rng, 60) for _ in range(400)]
    ids = [rng.choice([None, k, k, k // 2]) for k in range(400)]
    items = [(k, sample(rng, 30)) for k in range(12)] + [(20, None), (21, " .,"), (3, "w1 W2 w2"), (22, "unknown word")]
    found = ball_tree.best_documents(documents(texts, ids).repartition(3), spark.createDataFrame(items, ITEM), most,
                                     item_bytes=item_bytes)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)
    assert got == ranks_by_hand(texts, ids, items, most)


def random_rows(rng, count, width):
    sizes = rng.integers(1, 12, count)
    terms = np.concatenate([np.sort(rng.choice(width, s, replace=False)) for s in sizes])
    return ball_tree.Rows(np.concatenate([[0], np.cumsum(sizes)]), terms, rng.integers(0, 10**10, len(terms)))


def test_bounds_hold_for_every_row_below_a_node_and_prune():
    rng = np.random.default_rng(4)
    rows, width = random_rows(rng, 600, 300), 300
    rows.values[: rows.starts[60]] *= 1000  # a few rows stand out, as documents with an item's rare terms do
    tree = ball_tree.Tree(rows, np.arange(600), width, leaf=8)
    terms = [np.sort(rng.choice(width, 5, replace=False)) for _ in range(20)]
    items = ball_tree.Items(np.arange(0, 101, 5), np.concatenate(terms))
    bounds = tree.bounds(items)
    below = [None] * len(tree.leaves)
    for node in reversed(range(len(tree.leaves))):
        below[node] = list(tree.leaves[node][1]) if tree.leaves[node] else sum((below[c] for c in tree.children[node]), [])
    assert sorted(below[0]) == list(range(600))
    for k, chosen in enumerate(terms):
        scores = np.array([rows.values[a:b][np.isin(rows.terms[a:b], chosen)].sum() for a, b in zip(rows.starts, rows.starts[1:])])
        for node, members in enumerate(below):
            assert bounds[node, k] >= scores[members].max()
        best = [ball_tree.Best(3) for _ in range(20)]
        scored = ball_tree.search(tree, items, best, width)
        order = np.lexsort((np.arange(600), -scores))[:3]
        assert best[k].ids.tolist() == [i for i in order if scores[i] > 0]
    assert scored < 20 * sum(1 for leaf in tree.leaves if leaf)


def test_rough_and_empty_tables(spark, rough):
    items = spark.createDataFrame([(1, "a word1"), (2, None)], ITEM)
    found = ball_tree.best_documents(rough, items)
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()][-1][0] == 4
    assert {r.item_id for r in found.collect()} == {1}
    for docs, some in ((rough.limit(0), items), (rough, items.limit(0)), (rough.where("text IS NULL"), items)):
        assert ball_tree.best_documents(docs, some).count() == 0


def test_query_equals_its_sql_on_rows_of_its_own(spark, documents, tmp_path):
    import duckdb

    from tunetrail.llm import queries

    rng = random.Random(9)
    texts = [rng.choice([None, "", " .,", sample(rng, 40), sample(rng, 40)]) for _ in range(150)]
    tables = {"documents": documents(texts), "benchmark": spark.createDataFrame(
        [(k, sample(rng, 20)) for k in range(6)] + [(8, None), (9, "W1 w1 É"), (10, "unknown word")], ITEM)}
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    answer = con.execute(queries.ORACLES["op12_ball_tree"])
    columns = [d[0] for d in answer.description]
    got = queries.QUERIES["op12_ball_tree"](spark, str(tmp_path)).collect()
    assert len(got) > 100 and sorted(tuple(r[c] for c in columns) for r in got) == sorted(answer.fetchall())
