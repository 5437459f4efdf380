"""Edit matching, WARC round trips, the pipeline and the contract queries."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from tunetrail.llm import edit_match, grace, line_crf, queries, simhash, warc

SMALL = "/root/testdata/sf0.001"


def distance_by_hand(item, text):
    """Least edit distance of the item to any substring, and the first end that has it."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for k, c in enumerate(text, 1):
        now = [0]
        for j, x in enumerate(item, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != c)))
        row = now
        if row[-1] < best:
            best, end = row[-1], k
    return best, end


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert edit_match.best_end(item, text) == distance_by_hand(item, text)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = "q"
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, "z")
    return "".join(out)


@pytest.mark.parametrize("block_chars", [300, 1 << 20])
def test_hits_equal_brute_force(spark, documents, block_chars):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["bleon", "thred", "ania", "vost", "und", "per"]) for _ in range(n))
    items = [(k, prose(rng.randint(10, 30))) for k in range(12)] + [(5, None), (None, ""), (7, "tiny")]
    texts = []
    for _ in range(60):
        _, item = rng.choice(items[:12])
        texts.append(prose(rng.randint(0, 40)) + "  " + edited(rng, item, rng.randint(0, 12)).upper() + "\n" + prose(5))
    df = edit_match.match_items(documents(texts), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)
    got = {(r.doc_id, h.item_id): h.distance for r in df.collect() for h in r.hits}
    want = {}
    for d, text in enumerate(texts):
        for k, item in items:
            item = edit_match.normal(item)
            if item:
                best, _ = distance_by_hand(item, edit_match.normal(text))
                if best <= edit_match.budget(len(item)):
                    want[d, k] = best
    assert got == want and len(got) > 10
    for r in df.collect():
        for h in r.hits:
            piece = edit_match.normal(r.text)[h.start:h.end]
            assert distance_by_hand(edit_match.normal(dict(items[:12])[h.item_id]), piece)[0] <= h.distance


def test_matching_rough_and_empty_tables(spark, rough, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert edit_match.match_items(rough, none).where("size(hits) > 0").count() == 0
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6"), (1, "word1 word2 word3 word4 word5 word6")],
                                  "item_id long, text string")
    rows = edit_match.match_items(rough, items).collect()
    assert len(rows) == rough.count() and [len(r.hits) for r in rows if r.doc_id == 4] == [2]
    assert edit_match.match_items(documents([]), items).count() == 0


def pages_by_hand(pages):
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = i is not None and html in first and i > first[html]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 30
    pages = [(3, "http://a/ b\n", long), (1, "http://x", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
             (7, "", "x" * 100), (7, "", "x" * 100), (8, "v", "x" * 100), (None, "n", long), (None, "n", None), (9, "y", "é" * 50),
             (10, "z", "é" * 50), (11, "long", "ab" * 400000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"))
    records = warc.read_warc(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(pages) and records.select("record_id").distinct().count() == 3 * len(pages)
    found = warc.transactions(records)
    rows = found.collect()
    assert len(rows) == len(pages) and all(len(r.requests) == len(r.metadata) == 1 for r in rows)
    body = {r.metadata[0].fields.get("page-id"): r.capture.payload for r in rows}
    assert body["1"].decode() == long and body["11"].decode() == "ab" * 400000 and body["6"] == b""
    resolved = warc.resolve_revisits(found).collect()
    assert sorted((tuple(r) for r in resolved), key=str) == pages_by_hand(pages)


def test_warc_of_no_pages_and_strange_transactions(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, str(tmp_path / "w"))
    assert warc.transactions(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0
    rows = [("r1", "response", ["m2"]), ("q1", "request", ["r1"]), ("m1", "metadata", ["r1"]), ("m2", "metadata", []),
            ("q9", "request", ["lost"]), ("r2", "response", [])]
    full = [(i, k, c, None, None, None, None, {}, 0, 1, None) for i, k, c in rows]
    found = {r.capture.record_id: r for r in warc.transactions(spark.createDataFrame(full, warc.RECORDS)).collect()}
    assert [m.record_id for m in found["r1"].metadata] == ["m1", "m2"] and [q.record_id for q in found["r1"].requests] == ["q1"]
    assert found["r2"].metadata == found["r2"].requests == []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_contract_queries_equal_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, answer.fetchall()))


def test_pipeline_equals_its_stages_by_hand(spark):
    final = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = line_crf.train_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in line_crf.score_quality(docs, model).collect() if r.predicted]
    last = {r.text: max(x.doc_id for x in rows if x.text == r.text) for r in rows}
    rows = [r for r in rows if last[r.text] == r.doc_id]
    codes = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in rows}
    parent = {i: i for i in codes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in codes:
        for b in codes:
            if a < b and bin(codes[a] ^ codes[b]).count("1") <= 4:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if top(r.doc_id) == r.doc_id]
    items = edit_match.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()],
                             edit_match.RATE, edit_match.PIECE)
    clean = {r.doc_id: r.text for r in rows if not items.hits(r.text)}
    mixed = {r.doc_id: r.text for r in final}
    assert set(mixed) <= set(clean) and all(clean[i] == t for i, t in mixed.items())
    assert 0.2 * len(clean) < len(mixed) < len(clean)
    assert set(docs.columns) < set(corpus_pipeline.run(spark, SMALL).columns)


def test_pipeline_stages_on_rough_and_empty_documents(spark, rough, documents, tmp_path):
    spark.createDataFrame([(1, "nothing of the kind is here to find")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (rough, documents([])):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:len(docs.columns)] == docs.columns or k == 4
            assert out.count() <= docs.count()
    assert grace.exact_groups(rough).where("kept").count() == 5
