"""Column functions on literal rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tunetrail.functions.genres import consolidate, dominant_genre, genre_flags, parse_list
from tunetrail.functions.text import artist_key, fix_mojibake, page_url, strip_accents, strip_prefix, title_case, title_key
from tunetrail.functions.time import clock_label, context_label, day_label, time_of_day, with_time_features
from tunetrail.functions.values import bin3, bools_to_int, numeric_columns, prefixed, remap, skip_or_listen, to_flag, to_number
from tunetrail.schema import GENRE_PRIORITY


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_accents_equals_unicode_decomposition(spark):
    texts = ["Beyoncé", "ñandú", "日本", "ﬁn ½ Ǆ", "éa", "Wait…", "ΆλφαÅ", "𝐀bc", "ªº²", "かが", "İ", "ữị́", "", "plain", "№ ™"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert apply(spark, texts, strip_accents) == want


def test_strip_accents_of_every_character(spark):
    """All of Unicode but surrogates, a hundred characters a text."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[k:k + 100])) for k in range(0, len(codes), 100)]
    got = apply(spark, texts, strip_accents)
    for text, plain in zip(texts, got, strict=True):
        assert plain == "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_strip_accents_keeps_null(spark):
    assert apply(spark, [None], strip_accents) == [None]


def test_fix_mojibake(spark):
    texts = ["Ã¡rbol", "árbol", "日本", "Ã‘", "abc", None, "ñandú"]
    assert apply(spark, texts, fix_mojibake) == ["árbol", "árbol", "日本", "Ã‘", "abc", None, "ñandú"]


def test_fix_mojibake_with_escapes(spark):
    fix = lambda c: fix_mojibake(c, strip_escapes=True)
    assert apply(spark, ["a_X000D_b\\nc\\rd", None, "Ã¡"], fix) == ["a b c d", "", "á"]


@pytest.mark.parametrize("name, key", [
    ("The Weeknd", "weeknd"), ("Beyoncé", "beyonceknowles"), ("A$AP Rocky", "asaprocky"), ("The Beatles", "beatles"),
    ("Guns N' Roses", "gunsnroses"), (" The  Who ", "who"), ("P!nk", "pnk"), ("Theory", "theory"), ("Ke$ha", "kesha")])
def test_artist_key(spark, name, key):
    assert apply(spark, [name], artist_key) == [key]


def test_title_key(spark):
    titles = ["Song (feat. X) [Remix]", "Hello (World) ft. Me", "A-B - live", "What's #1?", "Softly", "Wait…", "feat", "a feat.b", "Café / Bar"]
    assert apply(spark, titles, title_key) == ["song", "helloworld", "a", "whats1?", "softly", "wait", "", "a", "cafebar"]


def test_title_case_and_prefix(spark):
    assert apply(spark, ["r&b pop", "hip hop", "o'neil x"], title_case) == ["R&B Pop", "Hip Hop", "O'Neil X"]
    assert apply(spark, ["lyric_cash", "cash"], lambda c: strip_prefix(c, "lyric_")) == ["cash", "cash"]
    assert apply(spark, ["The Game"], lambda c: page_url(c, F.lit("A (b) c"), "http://h/%s/%s.html")) == ["http://h/game/abc.html"]


def test_parse_list(spark):
    texts = ["['a', 'b c']", "[]", None, " [] ", "rock", "['a', \"b'c\"]", "[rock, pop]", "[' a ']", "['it\\'s']", " ['a',] "]
    assert apply(spark, texts, parse_list) == [
        ["a", "b c"], [], [], [], ["rock"], ["a", "b'c"], ["[rock, pop]"], ["a"], ["it's"], ["a"]]
    assert apply(spark, ["rock", "['a']"], lambda c: parse_list(c, "empty")) == [[], ["a"]]
    assert apply(spark, ["rock", "['a']"], lambda c: parse_list(c, "null")) == [None, ["a"]]


def test_long_list_text_parses(spark):
    text = "[" + ", ".join(f"'g{i}'" for i in range(5000)) + "]"
    assert len(apply(spark, [text], parse_list)[0]) == 5000


def test_dominant_genre_takes_the_first_of_the_priority_list(spark):
    tags = [["pop", "rap"], ["rap", "trap latino"], ["polka"], [], None]
    assert apply(spark, tags, dominant_genre, "array<string>") == ["Rap", "Trap Latino", "Other", "Other", "Other"]
    assert apply(spark, ["Rap", "Polka", None], consolidate) == ["Rap/Hip Hop", "Polka", None]
    assert len(GENRE_PRIORITY) == 19


def test_genre_flags(spark):
    df = spark.createDataFrame([(["hip hop", "rap"],), ([],)], "genres_list array<string>")
    rows = genre_flags(df, ["hip hop", "pop"]).select("genre_hip_hop", "genre_pop").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0)]


def test_time_labels(spark):
    hours = [0, 4, 5, 11, 12, 16, 17, 21, 22, 23]
    assert apply(spark, hours, time_of_day, "int") == [
        "Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night", "Night"]
    assert apply(spark, [0, 9, 12, 13, 23], clock_label, "int") == ["12:00 AM", "9:00 AM", "12:00 PM", "1:00 PM", "11:00 PM"]
    assert apply(spark, [5, 6, 9, 10, 12, 14, 18, 22], context_label, "int") == [
        "Late Night", "Morning Commute", "Morning Commute", "Late Morning", "Lunch", "Afternoon", "Evening", "Night"]
    assert apply(spark, [0, 1, 6], day_label, "int") == ["Mon", "Tues", "Sun"]


def test_time_features(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-06 23:30:00' AS ts")
    row = with_time_features(df).head()
    assert (row["hour"], row["day_of_week"], row["month"], row["is_weekend"], row["time_of_day"]) == (23, 5, 1, 1, "Night")
    shifted = with_time_features(df, tz="Europe/Berlin").head()
    assert (shifted["hour"], shifted["day_of_week"]) == (0, 6)


def test_bins(spark):
    values = [0.0, 1 / 3, 1 / 3 + 1e-9, 2 / 3, 0.9, 1.0, -0.0005, 1.1, None]
    assert apply(spark, values, bin3, "double") == ["Low", "Low", "Mid", "Mid", "High", "High", None, None, None]


def test_casts(spark):
    assert apply(spark, ["True", "1", "1.0", "false", "0.0", "unknown", None], to_flag) == [1, 1, 1, 0, 0, 0, 0]
    assert apply(spark, ["1.5", "x", None], to_number) == [1.5, None, None]
    assert apply(spark, [0.1, 0.0, -1.0], skip_or_listen, "double") == ["skip", "listen", "listen"]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0)], "n int, b boolean, s string, genre_x double")
    assert bools_to_int(df).head().b == 1
    assert numeric_columns(df, {"n"}) == ["genre_x"]
    assert prefixed(df, "genre_") == ["genre_x"]


def test_remap(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, x string")
    pairs = spark.createDataFrame([("a", "A")], "from string, to string")
    assert [r.x for r in remap(df, "x", pairs).orderBy("i").collect()] == ["A", "b", None]
    assert [r.x for r in remap(df, "x", pairs, keep_unmatched=False).orderBy("i").collect()] == ["A", None, None]
