"""Exact, SimHash and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tunetrail.llm import components as cc, grace, simhash


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def exact_by_hand(texts, ids):
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, members in groups.items():
        known = [i for i in members if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(members), hashlib.sha256(t.encode()).hexdigest()) for i in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes", [3000, 1 << 20])
def test_exact_groups_equal_brute_force_at_any_table_size(spark, documents, table_bytes):
    rng = random.Random(3)
    texts = [rng.choice(["", None, "é", "hot", "hot", "hot"]) if rng.random() < 0.6 else f"text {rng.randint(0, 30)}" * 5
             for _ in range(300)]
    ids = [rng.choice([None, i, i]) for i in range(300)]
    found = grace.exact_groups(documents(texts, ids).repartition(5), table_bytes=table_bytes)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact_by_hand(texts, ids)
    kept = found.where("kept").collect()
    assert len(kept) == len({t or "" for t in texts}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_keep_the_columns_and_one_of_repeated_rows(rough):
    found = grace.exact_groups(rough)
    assert set(found.columns) == set(rough.columns) | {"keep_id", "group_size", "kept", "text_sha256"}
    assert found.count() == rough.count()
    assert found.where("kept AND text = 'a b c'").count() == 1
    assert found.where("kept AND coalesce(text, '') = ''").first().doc_id == 2
    assert grace.exact_groups(rough.limit(0)).count() == 0


def test_content_table_compares_content_not_hashes():
    table = grace.ContentTable()
    for k in range(5000):
        assert table.get(7, str(k).encode()) is None
        table.put(7, str(k).encode(), k) if k < 300 else table.put(k, str(k).encode(), k)
    assert [table.get(7, str(k).encode()) for k in range(300)] == list(range(300))
    assert table.get(8, b"7") is None


def fingerprint_by_hand(text, size=4):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for text in ["", "one", "a b c d", "A b\tC  d e\x0bf", "É x " * 40, "to to to to to to", "  x y z w v"]:
        assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


def groups_by_hand(codes, distance):
    parent = {c: c for c in codes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in codes:
        for b in codes:
            if a < b and bin(a ^ b).count("1") <= distance:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {c: top(c) for c in codes}


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 6])
def test_links_span_all_near_pairs(spark, distance):
    rng = random.Random(distance)
    codes = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        codes |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 8))) for _ in range(4)}
    dense = rng.getrandbits(64)
    codes |= {dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)}
    signed = [np.uint64(c).view(np.int64).item() for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    found = cc.components(simhash.fingerprint_links(df, distance))
    root = {np.int64(r.u).view(np.uint64).item(): np.int64(r.root).view(np.uint64).item() for r in found.collect()}
    want = groups_by_hand(codes, distance)
    together = lambda of: {frozenset(c for c in codes if of(c) == g) for g in {of(c) for c in codes}}
    assert together(lambda c: root.get(c, c)) == together(want.get)


def test_every_near_pair_shares_a_key():
    for distance in range(1, 8):
        parts = simhash.segments(distance)
        assert sum(bits for _, bits, _ in parts) == 64
        assert sum(radius + 1 for _, _, radius in parts) == distance + 1


def test_simhash_groups_on_rough_rows(spark, rough, documents):
    found = simhash.simhash_groups(rough)
    assert set(found.columns) == set(rough.columns) | {"component_id"}
    rows = {(r.doc_id, r.text): r for r in found.collect()}
    assert found.count() == rough.count()
    assert rows[1, None].fingerprint == "0" * 16 and rows[1, None].component_id == rows[5, " \n\t "].component_id == 1
    assert rows[None, "a b c"].component_id == 3 and rows[None, "x"].component_id is None
    assert rows[3, "a b c"].fingerprint == f"{fingerprint_by_hand('a b c'):016x}"
    assert simhash.simhash_groups(documents([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5), (2, 1)]
    random.Random(1).shuffle(edges)
    found = {r.u: r.root for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} or found == (
        {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)})
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_row_of_each_group_is_kept(spark, documents):
    base = " ".join(f"w{i}" for i in range(400))
    code = simhash.fingerprint(base.encode())
    near = next(t for t in (f"{base} e{k}" for k in range(999))
                if 0 < (simhash.fingerprint(t.encode()) ^ code).bit_count() <= simhash.DISTANCE)
    other = " ".join(f"v{i}" for i in range(400))
    docs = documents([base, near, base, near, other, other, near, None, ""], [5, 5, 7, None, None, None, 5, 1, 1])
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 5), (True, 0)]
    assert [r.text for r in kept if r.doc_id is None] == [other]
    for ids in ([3, 8], [8, 3]):
        found = simhash.simhash_groups(documents([base, near], ids)).collect()
        assert [r.component_id for r in found] == [3, 3]
