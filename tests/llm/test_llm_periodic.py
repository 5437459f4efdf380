"""Periodic runs against brute force."""

import random
import zlib

import pytest

from tunetrail.llm import periodic, queries


def runs_by_hand(w, least=12):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.append((start, i - start + q, q))
    shorter = lambda s, n, q: any(all(w[s + k] == w[s + k + p] for k in range(n - p)) for p in range(1, q))
    return sorted((r for r in found if not shorter(*r)), key=lambda r: (r[0], r[2]))


def periodic_texts(rng, count):
    for _ in range(count):
        words, size = [], rng.randint(0, 90)
        while len(words) < size:
            kind = rng.random()
            if kind < 0.5:
                words += [rng.choice("ab") for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
            elif kind < 0.8:
                words += [rng.choice("abc")] * rng.randint(1, 15)
            else:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 10))]
        yield words


@pytest.mark.parametrize("least", [12, 4])
def test_runs_equal_brute_force(least):
    texts = list(periodic_texts(random.Random(least), 200))
    found = periodic.runs_of([" ".join(t).encode() for t in texts], least)
    assert found == [runs_by_hand(t, least) for t in texts]
    assert sum(map(len, found)) > 100


def test_ranks_of_doubling_are_suffix_order():
    import numpy as np

    rng = random.Random(5)
    symbols = np.array([rng.randint(0, 2) for _ in range(200)] + [9])
    order = np.argsort(periodic.doubling(symbols)[-1]).tolist()
    suffix = lambda i: symbols[i:].tolist()
    assert order == sorted(range(201), key=suffix)


def test_words_outside_ascii_space_are_kept_and_texts_do_not_mix():
    line = "é x y z"
    found = periodic.runs_of([f"{line} {line}".encode(), f"{line} {line}".encode()], 4)
    assert found == [[(0, 6, 3)], [(0, 6, 3)]]


def test_rough_rows_have_a_result_each(rough):
    found = periodic.periodic_runs(rough)
    assert set(found.columns) == set(rough.columns) | {"n_words", "runs", "collapsed"}
    rows = found.collect()
    assert len(rows) == rough.count()
    for r in rows:
        words = (r.text or "").split()
        assert r.n_words == len(words)
        if not words or len(words) < 12:
            assert r.runs == [] and bytes(r.collapsed) == " ".join(words).encode()
    assert [tuple(x) for r in rows if r.doc_id == 4 for x in r.runs] == [(0, 60000, 977)]
    assert [len(bytes(r.collapsed).split()) for r in rows if r.doc_id == 4] == [977]
    assert periodic.periodic_runs(rough.limit(0)).count() == 0


def test_one_word_repeated_very_often_is_one_run():
    assert periodic.runs_of([b"x " * 50000]) == [[(0, 50000, 1)]]


def test_planted_tails_follow_their_rule(documents):
    texts = ["a b c d e f g h i j", None, "", " x\ty "]
    rows = {r.doc_id: r.text for r in queries.planted_periods(documents(texts * 20)).collect()}
    for k, text in enumerate(texts * 20):
        h, words = zlib.crc32(str(k).encode()), (text or "").split()
        if h % 10 or not words:
            assert rows[k] == text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert rows[k] == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
