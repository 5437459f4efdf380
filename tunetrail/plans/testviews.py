"""Listening tables derived from the star-schema test tables, for queries and tests."""

from pyspark.sql import functions as F

from tunetrail.functions.genres import parse_list
from tunetrail.functions.time import with_time_features
from tunetrail.operators.stats import track_counts

# Extra stop words of the test corpus.
EXTRA_STOP_WORDS = ["die", "der", "und", "les", "des", "une", "Été"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_plays(spark, sf_dir):
    """Timed plays: one per event."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("play_id"), "user_id", "ts",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("track_id"),
        F.when(kind.isin("view", "error"), 1).otherwise(0).alias("skipped"),
        F.when(kind != "click", kind).alias("reason_start"),
        kind.alias("reason_end"))


def order_plays(spark, sf_dir):
    """Many plays of many tracks: one per order line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("play_id"),
        F.col("o_custkey").alias("user_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("track_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("skipped"))


def line_plays(spark, sf_dir):
    """The same plays without their listener, and so without a join."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("track_id"), (F.col("l_returnflag") == "R").cast("int").alias("skipped"))


def rough_event_plays(spark, sf_dir):
    """Timed plays with gaps: some without a time, some without a listener, a fifth in one listener's busy hour."""
    plays = event_plays(spark, sf_dir)
    i = F.col("play_id")
    busy = F.timestamp_add("SECOND", (i * 7919) % 3600, F.lit("2024-01-10 10:00:00").cast("timestamp_ntz"))
    return plays.withColumns({
        "user_id": F.when(i % 5 == 0, F.lit(1)).when(i % 11 == 0, F.lit(None)).otherwise(F.col("user_id")),
        "ts": F.when(i % 37 == 0, F.lit(None)).when(i % 5 == 0, busy).otherwise(F.col("ts"))})


def genre_text():
    k, kind, words = F.col("p_partkey") % 10, F.lower("p_type"), F.split("p_name", " ")
    return (F.when(k == 0, "[]").when(k == 1, None).when(k == 2, kind)
            .otherwise(F.concat(F.lit("['"), kind, F.lit("', '"), words[0], F.lit("', '"), words[1], F.lit("']"))))


def explicit_text():
    k = F.col("p_partkey") % 5
    return F.when(k == 0, "True").when(k == 1, "False").when(k == 2, "1").when(k == 3, "0.0")


def audio_library(spark, sf_dir):
    """One row per track: names, genre text and audio features."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    unit = lambda i: F.least(F.greatest(F.lit(0.5) + F.lit(2.0) * F.col("embedding")[i].cast("double"), F.lit(0.0)), F.lit(1.0))
    parts = table(spark, sf_dir, "part").withColumn("vec_id", F.col("p_partkey") % n)
    key = F.col("p_partkey")
    return parts.join(vectors.select("vec_id", "embedding"), "vec_id").select(
        key.alias("track_id"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist"),
        genre_text().alias("genres"), explicit_text().alias("explicit"),
        unit(0).alias("danceability"), unit(1).alias("energy"), unit(2).alias("valence"), unit(3).alias("acousticness"),
        unit(4).alias("liveness"), unit(5).alias("instrumentalness"), unit(6).alias("speechiness"),
        F.col("p_size").cast("int").alias("popularity"), (60 + F.col("p_retailprice") % 120).alias("tempo"),
        (0 - 60 * unit(7)).alias("loudness"), (key % 12).cast("int").alias("key"), (key % 2).cast("int").alias("mode"),
        (3 + key % 3).cast("int").alias("time_signature"))


def library_files(spark, sf_dir):
    """The library as two files: the larger tracks without popularity, then all tracks, one beat faster."""
    library = audio_library(spark, sf_dir)
    first = library.where(F.col("popularity") >= 20).drop("popularity").withColumn("source_no", F.lit(0))
    second = library.withColumn("tempo", F.col("tempo") + 1).withColumn("source_no", F.lit(1))
    return [first, second]


def lyrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("track_id"), F.col("text").alias("lyrics"), "lang")


def lyric_files(spark, sf_dir):
    """Lyrics of two files: every third track has a row without a text first, every fourth a later text too."""
    texts = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("track:"), F.col("doc_id").cast("string")).alias("track_uri"), F.col("text").alias("lyrics"),
        F.lit(0).alias("source_no"))
    gaps = texts.where("doc_id % 3 = 0").withColumn("lyrics", F.lit(None).cast("string"))
    later = texts.where("doc_id % 4 = 0").withColumns({"lyrics": F.lit("!"), "source_no": F.lit(1)})
    return gaps.unionByName(texts).unionByName(later).drop("doc_id")


def exported_plays(spark, sf_dir):
    """Timed plays as an export file holds them: text under vendor names, some values unreadable."""
    i = F.col("play_id")
    text = lambda c: c.cast("string")
    return event_plays(spark, sf_dir).select(
        text(i).alias("play_id"), F.when(i % 11 != 0, text(F.col("user_id"))).alias("user_id"),
        F.when(i % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        text(F.col("track_id")).alias("track_id"), F.concat(F.lit("uri:"), text(F.col("track_id"))).alias("vendor_track_uri"),
        F.concat(F.lit("Track "), text(F.col("track_id"))).alias("master_metadata_track_name"),
        F.lit("Someone").alias("master_metadata_album_artist_name"),
        F.when(i % 3 == 0, F.when(F.col("skipped") == 1, "True").otherwise(" FALSE "))
        .when(i % 3 == 1, text(F.col("skipped"))).otherwise("1.0").alias("skipped"),
        F.when(i % 7 == 0, "long").otherwise(text(i * 10)).alias("ms_played"), F.lit("x").alias("unused"))


def exported_library(spark, sf_dir):
    """The library as text, some values unreadable."""
    i = F.col("track_id")
    return audio_library(spark, sf_dir).select(
        i.cast("string").alias("track_id"), F.when(i % 9 == 0, "fast").otherwise(F.col("tempo").cast("string")).alias("tempo"),
        F.concat(F.col("popularity").cast("string"), F.lit(".0")).alias("popularity"), "genres", "explicit",
        F.when(i % 4 == 0, "").otherwise(F.col("key").cast("string")).alias(" key "), F.lit("x").alias("unused"))


def genre_lookups(spark, sf_dir):
    """Artist and track lookup tables, and title rules, derived from the parts."""
    parts = table(spark, sf_dir, "part")
    artists = parts.select(F.col("p_brand").alias("artist")).distinct()
    number = F.regexp_extract("artist", "([0-9]+)", 1).cast("int")
    tags = lambda *names: F.array(*[F.lit(n) for n in names])
    empties = artists.where(number <= 8).withColumn("genres", tags("hip hop", "rap"))
    rules = artists.where(number == 9).select(
        "artist", F.explode(F.array(
            F.struct(F.lit(1).alias("priority"), F.lit("Red Widget").alias("title"), F.lit(False).alias("negate"), tags("reggaeton").alias("genres")),
            F.struct(F.lit(2).alias("priority"), F.lit("Red Widget").alias("title"), F.lit(True).alias("negate"), tags("r&b").alias("genres")))).alias("r")
    ).select("artist", "r.*")
    nulls = artists.where(number.between(6, 14)).withColumn("genres", tags("latin pop"))
    tracks = parts.where(F.col("p_size") > 25).select(F.col("p_partkey").alias("track_id"), tags("o'pop", "trap").alias("genres"))
    late = artists.where(number.between(10, 20)).withColumn("genres", tags("salsa"))
    return [empties], rules, [nulls, tracks, late]


def tagged_library(spark, sf_dir):
    """The library with parsed genres: lists are parsed once per track, not once per play."""
    return audio_library(spark, sf_dir).withColumn("genres_list", parse_list(F.col("genres")))


def clean_event_plays(spark, sf_dir):
    """Timed plays with their track's features, time parts and parsed genres."""
    return with_time_features(event_plays(spark, sf_dir).join(tagged_library(spark, sf_dir), "track_id"))


def counted_tracks(spark, sf_dir):
    """Plays per track and class with the track's features: counted before the join."""
    return track_counts(line_plays(spark, sf_dir)).join(tagged_library(spark, sf_dir), "track_id")


def clean_order_plays(spark, sf_dir):
    return with_time_features(order_plays(spark, sf_dir).join(tagged_library(spark, sf_dir), "track_id"))
