"""Circulant MinHash groups against brute force."""

import random

import numpy as np
import pytest

from tunetrail.llm import circulant


def shingles_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(texts, ids, percent=85):
    sets, root = [shingles_by_hand(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    rows = [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, i in enumerate(ids)]
    return sorted([(*r, r[0] == r[2]) for r in rows], key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words]


def families(rng, count):
    """Chains and stars of copies with edits around the limit, and texts that share a long passage."""
    shared = [f"s{k}" for k in range(60)]
    out = []
    for _ in range(count):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 120))]
        out.append(base)
        for _ in range(rng.randint(0, 6)):
            base = edited(rng, base if rng.random() < 0.5 else out[-1], rng.choice([0, 0.005, 0.01, 0.02, 0.03]))
            out.append(base)
        out.append(shared + [f"u{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 40))])
    return [" ".join(w).replace("w1", "W1") for w in out]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


@pytest.mark.parametrize("small, pivots, fan", [(16, 16, 1024), (2, 1, 3)])
def test_groups_equal_brute_force_with_small_and_large_buckets(spark, documents, monkeypatch, small, pivots, fan):
    monkeypatch.setattr(circulant, "FAN", fan)
    rng = random.Random(small)
    texts = families(rng, 25) + ["", None, " \t", "one", "ONE", "one two", "é one two"]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    found = circulant.minhash_groups(documents(texts, ids).repartition(3), small=small, pivots=pivots)
    assert rows_of(found) == groups_by_hand(texts, ids)


def test_a_loose_limit_with_few_bands_opens_large_buckets(spark, documents):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(edited(rng, base, 0.01 * (k % 7))) for k in range(40)]
    ids = list(range(40))
    found = circulant.minhash_groups(documents(texts, ids), percent=70, rows=1, small=2, pivots=1)
    assert rows_of(found) == groups_by_hand(texts, ids, 70)


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.sort(codes[:1000]), np.sort(codes[200:1200])
    signs = circulant.signatures([a, b], 1500)
    assert abs((signs[0::1, 0] == signs[:, 1]).mean() - 800 / 1200) < 0.05
    places = circulant.scattered(codes)
    one = circulant.ranked(places - np.uint64(7), np.empty_like(places), np.empty_like(places))
    assert signs[7, 0] == one[:1000].min() and len(set(one.tolist())) == 1500


def test_long_sets_are_signed_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 700, 1, 64, 65)]
    whole = circulant.signatures(sets, 10)
    monkeypatch.setattr(circulant, "BLOCK", 64)
    assert (circulant.signatures(sets, 10) == whole).all()


def test_rough_rows_have_a_result_each(rough):
    found = circulant.minhash_groups(rough)
    assert rows_of(found) == rows_of_rough()
    assert circulant.minhash_groups(rough.limit(0)).count() == 0


def rows_of_rough():
    long = 977  # the text repeats its 977 words: as many distinct shingles
    return sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, 3, False), (4, long, 4, True),
                   (None, 1, None, True), (None, 0, None, True), (5, 0, 5, True)], key=str)
