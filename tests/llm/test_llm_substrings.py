"""Repeated word windows and byte strings against brute force; suffix arrays against sorting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tunetrail.llm import block_anchors, suffix_groups
from tunetrail.llm.shared import runs, window_hashes, word_hashes, word_spans

WORDS = ["a", "b", "the", "é", "Of", "of", "thronatively", "oficina", "x" * 5000]


def random_texts(rng, kind):
    texts = []
    for _ in range(rng.randint(1, 10)):
        if kind == "words":
            gap = rng.choice([" ", "  ", "\n", "\t"])
            texts.append(gap.join(rng.choice(WORDS[:rng.choice([2, 8, 9])]) for _ in range(rng.randint(0, 70))))
        elif kind == "letters":
            texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 150))))
        else:
            texts.append(rng.choice(["a", "ab ", "To be "]) * rng.randint(0, 60))
    for _ in range(rng.randint(0, 6)):
        a, k = rng.choice(texts), rng.randrange(len(texts))
        i, j = sorted((rng.randint(0, len(a)), rng.randint(0, len(a))))
        texts[k] = texts[k][:15] + a[i:j] + texts[k][15:]
    return texts


def words_by_hand(ids, texts, window):
    parts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    ids = [2**63 - 1 if i is None else i for i in ids]
    least = {}
    for i, w in zip(ids, parts):
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(ids, parts):
        mask = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if least[tuple(w[j:j + window])] < i:
                mask[j:j + window] = True
        out.append((len(w), [tuple(x) for x in np.column_stack(runs(mask)).tolist()],
                    b" ".join(x for x, m in zip(w, mask) if not m).decode()))
    return out


def bytes_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                mask[i:i + length] = True
        out.append((len(b), [tuple(x) for x in np.column_stack(runs(mask)).tolist()],
                    bytes(np.frombuffer(b, np.uint8)[~mask])))
    return out


def spans(row):
    return [(s.start, s.end) for s in row.removed]


@pytest.mark.parametrize("seed", range(4))
def test_word_windows_equal_brute_force(spark, documents, monkeypatch, seed):
    monkeypatch.setattr(block_anchors, "parts_for", lambda total: 3)
    rng = random.Random(seed)
    texts = [t for k in range(4) for t in random_texts(rng, "words")] + [None, ""]
    ids = [rng.choice([None, k, k, k % 5]) for k in range(len(texts))]
    df = documents(texts, ids)
    for window in (4, 10):
        got = Counter((r.doc_id, r.n_words, tuple(spans(r)), r.kept_text) for r in block_anchors.drop_repeats(df, window).collect())
        want = Counter((i, n, tuple(s), k) for i, (n, s, k) in zip(ids, words_by_hand(ids, texts, window)))
        assert got == want


@pytest.mark.parametrize("frequent", [3, 4096])
@pytest.mark.parametrize("kind", ["words", "letters", "periods"])
def test_byte_strings_equal_brute_force(spark, documents, monkeypatch, kind, frequent):
    monkeypatch.setattr(suffix_groups, "parts_for", lambda total: 3)
    rng = random.Random(kind)
    texts = [t for k in range(4) for t in random_texts(rng, kind)] + [None, ""]
    for length, gram in ((40, 6), (60, 12)):
        got = Counter((r.doc_id, r.n_bytes, tuple(spans(r)), bytes(r.kept)) for r in suffix_groups.drop_substrings(
            documents(texts), length, gram, frequent).collect())
        assert got == Counter((i, n, tuple(s), k) for i, (n, s, k) in enumerate(bytes_by_hand(texts, length)))


def test_rough_and_empty_tables(rough, documents):
    words = {(r.doc_id, r.n_words) for r in block_anchors.drop_repeats(rough).collect()}
    assert (4, 60000) in words and (1, 0) in words and (5, 0) in words
    assert suffix_groups.drop_substrings(rough).count() == rough.count()
    assert block_anchors.drop_repeats(documents([])).count() == suffix_groups.drop_substrings(documents([])).count() == 0


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        symbols = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_groups.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_hashes_depend_on_content_only(monkeypatch):
    from tunetrail.llm import shared

    monkeypatch.setattr(shared, "BLOCK", 64)
    rng = random.Random(5)
    data = np.frombuffer(" ".join(rng.choice(["ab", "ba", "abc", "y" * 5000]) for _ in range(300)).encode() + b"\n", np.uint8)
    starts, ends = word_spans(data)
    by_word = {}
    for a, b, code in zip(starts, ends, word_hashes(data, starts, ends)):
        assert by_word.setdefault(data[a:b].tobytes(), code) == code
    assert len(set(by_word.values())) == len(by_word) == 4
    codes = window_hashes(data, 7)
    seen = {}
    for i, code in enumerate(codes):
        assert seen.setdefault(data[i:i + 7].tobytes(), code) == code
    assert len(set(seen.values())) == len(seen)
