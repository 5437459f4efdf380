import gzip
import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tunetrail.operators import stats
from tunetrail.operators.impute import impute_candidates, impute_genres, list_text
from tunetrail.functions.genres import parse_list
from tunetrail.plans.clean import build_clean_plays, unique_library, unique_lyrics
from tunetrail.plans.dashboard import count_tables, export_dashboard, top_lists
from tunetrail.schema import AUDIO_CORE
from tunetrail.sources import readers
from tunetrail.sources.pages import content_lyrics, extract_page_lyrics, unescape
from tunetrail.sources.readers import canonical_name, conform_plays, enrichment_worklist, read_library, read_lyrics, read_plays
from tunetrail.sources.sinks import write_tables

AUDIO = ",".join(AUDIO_CORE)
VALUES = "120.5,0.8,3,50,1,4,0.1,0.7,0.6,0.2,0.1,0.0,-5.5"


@pytest.fixture()
def files(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return {
        "plays": write("plays.csv", (
            "ts,master_metadata_track_name,master_metadata_album_artist_name,vendor_track_uri,track_id,skipped,reason_start,ms_played,extra\n"
            "2024-01-01T10:00:00Z,One,A,uri:1,t1,True,clickrow,1000,x\n"
            "2024-01-01T10:05:00Z,Two,B,uri:2,t2,False,,2000,x\n"
            "2024-01-01T10:09:00Z,Three,C,uri:3,t3,0,,bad,x\n"
            "not a time,One,A,uri:1,t1,1,,1,x\n"
            "2024-01-01T10:20:00Z,,,,,True,,1,x\n")),
        "first": write("first.csv", f"track_id,genres,{AUDIO}\nt1,\"['pop', 'rap']\",{VALUES}\nt1,[],{VALUES}\nt3,,{VALUES}\n"),
        "second": write("second.csv", f"track_id,explicit,genres,{AUDIO},unused\nt1,True,['late'],{VALUES},9\nt2,False,[],{VALUES},9\n,1,[],{VALUES},9\n"),
        "lyrics": write("lyrics.csv", 'vendor_track_uri,lyrics\nuri:1,"line one\nline ""two"""\nuri:2,words\nuri:2,later\n,none\nuri:3,x\n'),
    }


def test_canonical_names():
    assert canonical_name("master_metadata_album_artist_name") == "artist"
    assert canonical_name("vendor_track_uri") == "track_uri"
    assert canonical_name("energy") == "energy"


def test_read_plays(spark, files):
    rows = read_plays(spark, files["plays"]).orderBy("ts").collect()
    assert [r.skipped for r in rows] == [1, 1, 0, 0, 1]
    assert rows[0].ts is None and str(rows[1].ts) == "2024-01-01 10:00:00"
    assert [r.ms_played for r in rows] == [1, 1000, 2000, None, 1]
    assert len({r.play_id for r in rows}) == 5
    assert rows[1].track_name == "One" and rows[4].track_name is None


def test_read_plays_fails_loudly_without_needed_columns(spark, files):
    with pytest.raises(ValueError, match="skipped"):
        read_plays(spark, files["lyrics"])


def test_library_stack_and_precedence(spark, files):
    library = read_library(spark, [files["first"], files["second"]])
    assert library.count() == 6 and "unused" not in library.columns
    unique = {r.track_id: r for r in unique_library(library).collect()}
    assert set(unique) == {"t1", "t2", "t3"}
    assert unique["t1"].source_no == 0 and unique["t1"].explicit is None
    assert unique["t2"].popularity == 50


def test_clean_plays_end_to_end(spark, files, tmp_path):
    plays = read_plays(spark, files["plays"])
    library = read_library(spark, [files["first"], files["second"]])
    lyrics = read_lyrics(spark, files["lyrics"])
    lookup = spark.createDataFrame([("B", ["salsa"])], "artist string, genres array<string>")
    nulls = spark.createDataFrame([("uri:3", ["o'pop"])], "track_uri string, genres array<string>")
    clean = build_clean_plays(plays, library, lyrics, [lookup], None, [nulls]).where("ts IS NOT NULL")
    rows = {r.track_name: r for r in clean.collect()}
    assert set(rows) == {"One", "Two", "Three"}
    assert rows["One"].lyrics == 'line one\nline "two"'
    assert rows["Two"].genres == "['salsa']" and rows["Two"].reason_start == "unknown"
    assert rows["Three"].genres == "[\"o'pop\"]" and rows["Three"].explicit == "unknown"
    marked = build_clean_plays(plays, library, lyrics, [lookup], None, [nulls], with_text=False)
    assert {r.lyrics for r in marked.collect()} == {1}

    done = export_dashboard(clean, str(tmp_path / "out"))
    counts = {r.name: r.rows for r in done.collect()}
    assert counts["kpis"] == 3 and counts["correlations"] == 196
    assert counts["top_lists/artists"] == top_lists(clean)["artists"].count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "kpis")).count() == 3


def test_counted_reports_equal_reports_of_plays(spark, tmp_path):
    """With NULLs in every column; the tables read the stored counts, not the plays."""
    rng = random.Random(9)
    pick = lambda *values: rng.choice([*values, None])
    rows = [(pick(0, 1), pick(0, 3, 6), pick(1, 13, 23), pick("One", "Two"), pick("A", "B"), pick("['x', 'y']", "[]", "bad", "['z']"))
            for _ in range(500)]
    spark.createDataFrame(rows, "skipped int, day_of_week int, hour int, track_name string, artist string, genres string") \
        .write.parquet(str(tmp_path / "plays"))
    plays = spark.read.parquet(str(tmp_path / "plays"))
    want = {"skip_heatmap": stats.skip_heatmap(plays), "hourly_skip": stats.hourly_skip(plays), "kpis": stats.kpi_summary(plays),
            **{f"top_lists/{k}": v for k, v in top_lists(plays).items()}}
    got = count_tables(plays)
    assert got.keys() == want.keys()
    for name, table in got.items():
        assert sorted(map(repr, table.collect())) == sorted(map(repr, want[name].collect())), name
        assert str(tmp_path) not in table._jdf.queryExecution().toString()
    empty = count_tables(plays.limit(0))
    assert {r.Metric: r.Value for r in empty["kpis"].collect()} == {"Total Songs": 0.0, "Total Skips": 0.0, "Skip Rate": None}
    assert empty["skip_heatmap"].count() == empty["top_lists/genres"].count() == 0


def test_plays_without_ids_keep_every_repeat(spark):
    """A third of all rows equal, some that differ only outside the hashed content; unique rows are not shuffled."""
    rows = [("2024-01-01 10:00:00", "1", "Same", "A", "clickrow")] * 300 + \
        [("2024-01-01 10:00:00", "1", "Same", "A", r) for r in ("fwdbtn", None, "fwdbtn")] + \
        [(f"2024-01-02 10:{i // 60:02d}:{i % 60:02d}", str(i % 2), f"T{i}", "B", None) for i in range(600)]
    raw = spark.createDataFrame(rows, "ts string, skipped string, track_name string, artist string, reason_start string")
    got = conform_plays(raw.repartition(7)).collect()
    assert len({r.play_id for r in got}) == len(got) == 903
    same = sorted(r.play_id.partition("-")[2] for r in got if r.track_name == "Same")
    assert same == sorted([""] + [str(k) for k in range(2, 304)])
    assert sum(r.reason_start == "fwdbtn" for r in got) == 2
    again = {r.play_id: r for r in conform_plays(raw.repartition(3)).collect()}
    assert all(again[r.play_id] == r for r in got)
    unique = conform_plays(raw.where("artist = 'B'"))
    unique.collect()
    plan = unique._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan or "AQEPropagateEmptyRelation" in plan or \
        not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "track_name" in x]


def test_lookups_of_one_key_are_one_join(spark):
    plays = spark.createDataFrame([(1, "A", "x", "u1", "[]"), (2, "B", "y", "u2", None), (3, None, "y", "u2", None)],
                                  "play_id int, artist string, track_name string, track_uri string, genres string")
    artist = lambda *rows: spark.createDataFrame(list(rows), "artist string, genres array<string>")
    uri = spark.createDataFrame([("u2", ["t"])], "track_uri string, genres array<string>")
    rules = spark.createDataFrame([(1, "A", "X", False, ["r"])], "priority int, artist string, title string, negate boolean, genres array<string>")
    out = impute_genres(plays, [artist(("Z", ["z"])), artist(("Y", ["z"]))], rules,
                        [artist(("B", ["late"]), ("B", ["b"])), uri, artist(("B", ["never"]), (None, ["no"]))])
    assert {r.play_id: r.genres for r in out.collect()} == {1: "['r']", 2: "['b']", 3: "['t']"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
    assert impute_genres(plays).collect() == plays.collect()


def test_worklist(spark, files):
    plays = read_plays(spark, files["plays"])
    done = spark.createDataFrame([("uri:2",)], "track_uri string")
    assert [r.track_uri for r in enrichment_worklist(plays, done).orderBy("track_uri").collect()] == ["uri:1", "uri:3"]
    assert [r.track_uri for r in enrichment_worklist(plays, limit=1, offset=1).collect()] == ["uri:2"]


def test_write_csv_single_file(spark, tmp_path):
    counts = write_tables({"a": spark.range(5), "b/c": spark.range(0)}, str(tmp_path), "csv", single_file=True)
    assert {r.name: r.rows for r in counts.collect()} == {"a": 5, "b/c": 0}
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".csv")]) == 1


def test_imputation_precedence(spark):
    plays = spark.createDataFrame([
        (1, "A", "x", "u1", " [] "), (2, "R", "Burn", "u2", "[]"), (3, "R", "Other", "u3", "[]"), (4, "Z", "x", "u4", "[]"),
        (5, "A", "x", "u5", None), (6, "Q", "x", "u6", None), (7, "Q", "x", "u7", None), (8, "A", "x", "u1", "['kept']"),
        (9, None, "x", None, None)], "play_id int, artist string, track_name string, track_uri string, genres string")
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} string, genres array<string>")
    rules = spark.createDataFrame([("R", 1, "burn", False, ["reggaeton"]), ("R", 2, "burn", True, ["r&b"])],
                                  "artist string, priority int, title string, negate boolean, genres array<string>")
    out = impute_genres(plays, [table([("A", ["empty a"])], "artist")], rules,
                        [table([("A", ["null a"])], "artist"), table([("u5", ["late"]), ("u6", ["by track"])], "track_uri"),
                         table([("Q", ["last"])], "artist")])
    got = {r.play_id: r.genres for r in out.collect()}
    assert got == {1: "['empty a']", 2: "['reggaeton']", 3: "['r&b']", 4: "[]", 5: "['null a']", 6: "['by track']",
                   7: "['last']", 8: "['kept']", 9: None}


def test_list_text_round_trip(spark):
    lists = [["a", "b c"], ["it's"], ['say "x"', "o'y \"z\""], ["back\\slash"], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, g array<string>")
    back = df.select("i", parse_list(list_text(F.col("g"))).alias("g")).orderBy("i").collect()
    assert [r.g for r in back] == lists


def test_impute_candidates(spark):
    df = spark.createDataFrame([(1, "u1", None, 1.0), (2, "u1", None, 1.0), (3, "u2", None, None), (4, "u3", "[]", 1.0)],
                               "play_id int, track_uri string, genres string, energy double")
    got = impute_candidates(df, ["play_id"], ["energy"]).collect()
    assert [r.play_id for r in got] == [1]


def test_page_lyrics(spark):
    pages = [
        ("<body><div>menu<br></div><div class='x'>Fish &amp; chips&nbsp;<br>two&#233;<br/>three &#x1F600; &amp;lt; &bogus; &#0;</div><!-- <br><br><br><br> --></body>",
         "Fish & chips \ntwoé\nthree 😀 &lt; &bogus; &#0;"),
        ("<div>a<br>b</div><div>c<br>d</div>", "a\nb"),
        ("<p>no breaks</p>", None),
        ("<script>'<br><br><br>'</script><p> <br> </p>", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "page_id int, html string")
    got = [r.lyrics for r in extract_page_lyrics(df).orderBy("page_id").collect()]
    assert got == [text for _, text in pages]


def test_second_plain_block_is_preferred(spark):
    pages = [("<div class='a'>x<br>y<br>z</div><div>one</div><div id='t'>two &amp;<br><i>three</i></div>", "two &\nthree"),
             ("<div class='a'>x<br>y</div><div>one</div>", "x\ny"), ("<div></div><div> </div><p>a<br>b</p>", ""), (None, None)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "page_id int, html string")
    got = [r.lyrics for r in extract_page_lyrics(df, prefer_plain=True).orderBy("page_id").collect()]
    assert got == [text for _, text in pages]


def test_unescape_without_references(spark):
    assert spark.range(1).select(unescape(F.lit("a & b")).alias("x")).head().x == "a & b"


def test_files_with_other_headers_under_one_pattern(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("track_id,energy,tempo\nt1,0.7,99\n")
    (tmp_path / "c.csv").write_text("tempo,track_id,valence\n120,t2,0.3\n121,t1,0.4\n")
    for paths in (str(tmp_path / "*.csv"), [str(tmp_path / "a b.csv"), str(tmp_path / "c.csv")], str(tmp_path)):
        rows = {(r.track_id, r.source_no): r for r in read_library(spark, paths).collect()}
        assert set(rows) == {("t1", 0), ("t2", 1), ("t1", 1)}
        assert (rows["t1", 0].energy, rows["t1", 0].tempo, rows["t1", 0].valence) == (0.7, 99.0, None)
        assert (rows["t2", 1].energy, rows["t2", 1].tempo, rows["t2", 1].valence) == (None, 120.0, 0.3)
    with pytest.raises(FileNotFoundError):
        read_library(spark, str(tmp_path / "none*.csv"))


@pytest.mark.parametrize("small", [0, 1 << 10, 1 << 24])
def test_headers_are_read_by_tasks(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(readers, "SMALL_FILE", small)
    for i in range(40):
        (tmp_path / f"part-{i:02}.csv").write_text(f"track_id,{'energy' if i % 2 else 'tempo'}\nt{i},{i}\n")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as out:
        out.write("energy,track_id\r\n0.5,zipped\r\n")
    (tmp_path / "ümlaut %20.csv").write_text("track_id,energy\n" + "u,9\n" * 50000)
    (tmp_path / "bare.csv").write_text("track_id,energy")
    settings = dict(spark.conf.getAll)
    library = read_library(spark, str(tmp_path))
    assert dict(spark.conf.getAll) == settings
    rows = {r.track_id: (r.energy, r.tempo) for r in library.distinct().collect()}
    assert rows == {f"t{i}": (float(i), None) if i % 2 else (None, float(i)) for i in range(40)} | {
        "zipped": (0.5, None), "u": (9.0, None)}
    assert library.count() == 40 + 1 + 50000
    assert library.select("source_no").distinct().count() == 42
    (tmp_path / "none").mkdir()
    for folder in (tmp_path, tmp_path / "none"):
        (folder / "empty.csv").write_text("")
    assert read_library(spark, str(tmp_path)).count() == 40 + 1 + 50000
    with pytest.raises(FileNotFoundError):
        read_library(spark, str(tmp_path / "none"))


def test_large_play_files_are_split(spark, tmp_path):
    line = "2024-01-01T10:00:00Z,One,A,uri:1,t1,True\n"
    (tmp_path / "plays.csv").write_text("ts,track_name,artist,track_uri,track_id,skipped\n" + line * 20000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        plays = read_plays(spark, str(tmp_path / "plays.csv"))
        scan = [x for x in plays._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
        assert scan and "multiLine" not in scan[0]
        assert plays.select("play_id").distinct().count() == 20000  # repeats are numbered
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_text_wins_over_a_missing_one(spark):
    lyrics = spark.createDataFrame([("u1", None, 0), ("u1", "text", 0), ("u1", "later", 1), ("u2", None, 0)],
                                   "track_uri string, lyrics string, source_no int")
    assert {r.track_uri: r.lyrics for r in unique_lyrics(lyrics).collect()} == {"u1": "text", "u2": None}


def test_repeated_lookup_keys_and_table_before_rule(spark):
    plays = spark.createDataFrame([(1, "A", "Burn", "u1", "[]")], "play_id int, artist string, track_name string, track_uri string, genres string")
    table = spark.createDataFrame([("A", ["b"]), ("A", ["a"])], "artist string, genres array<string>")
    rules = spark.createDataFrame([("A", 1, "burn", False, ["rule"])],
                                  "artist string, priority int, title string, negate boolean, genres array<string>")
    assert [r.genres for r in impute_genres(plays, [table], rules).collect()] == ["['a']"]
    assert [r.genres for r in impute_genres(plays, [], rules).collect()] == ["['rule']"]


class Node:
    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def texts(self):
        return [t for c in self.children for t in ([c] if isinstance(c, str) else c.texts())]

    def count(self, tag):
        return sum((c.tag == tag) + c.count(tag) for c in self.children if not isinstance(c, str))


class Dom(HTMLParser):
    """A small document tree: an end tag closes the innermost element of its name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.stack, self.first = [Node("root")], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag == "div" and node.attrs.get("class") == "text" and self.first is None:
            self.first = node
        if tag not in ("br", "hr"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def lyrics(self):
        if self.first is None or not self.first.children:
            return None
        plain = [c for c in self.first.children if not isinstance(c, str) and c.tag == "div" and "class" not in c.attrs]
        if len(plain) >= 2:
            return "\n".join(plain[1].texts()).strip()
        best = max(self.first.children, key=lambda c: 0 if isinstance(c, str) else c.count("br"))
        return (best if isinstance(best, str) else "".join(best.texts())).strip() or None


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4)):
        kind = rng.choice(["text", "br", "div", "div", "p", "open", "b", "space"])
        if kind == "text":
            out += rng.choice(["one", "two words", "é"])
        elif kind == "br":
            out += rng.choice(["<br>", "<hr>"])
        elif kind == "space":
            out += " \n"
        elif depth < 4:
            tag = "p" if kind == "open" else kind
            attrs = rng.choice(["", "", ' class="note"', ' id="x"', ' class="text"' if depth < 2 else ""])
            out += f"<{tag}{attrs}>{random_page(rng, depth + 1)}" + ("" if kind == "open" else f"</{tag}>")
    return out


def test_content_lyrics_equal_a_document_tree(spark):
    rng = random.Random(8)
    pages = [f'<html><body>{random_page(rng)}<div class="text">{random_page(rng)}</div>{random_page(rng)}</body></html>' for _ in range(300)]
    pages += ["", "plain", '<div class="text">', '<div class="text">open <br> end']
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = [r.lyrics for r in content_lyrics(df, "text").orderBy("page_id").collect()]
    assert got == [Dom(p).lyrics() for p in pages]
    assert content_lyrics(spark.createDataFrame([(None,)], "html string"), "text").first().lyrics is None


def test_nested_blocks_stay_whole(spark):
    page = '<div class="content"><div>head</div><div>l1<br>l2<div class="note">n<br>n<br>n<br></div>l3</div></div>'
    got = content_lyrics(spark.createDataFrame([(page,)], "html string"), "content").first().lyrics
    assert got == "l1\nl2\nn\nn\nn\nl3"
