"""The clean table: one complete row per play."""

from pyspark.sql import functions as F

from tunetrail.operators.dedupe import first_per_key
from tunetrail.operators.impute import impute_genres
from tunetrail.schema import CORE, FILL_VALUES


def unique_library(library):
    """First row per track; earlier files win, then the smaller row content."""
    content = F.xxhash64(*[c for c in library.columns if c not in ("track_id", "source_no")])
    return first_per_key(library.withColumn("_content", content), ["track_id"], ["source_no", "_content"]).drop("_content")


def unique_lyrics(lyrics):
    """First text per track address; a row without a text counts only where no other has one."""
    texts = lyrics.select("track_uri", "lyrics", "source_no").withColumn("_none", F.col("lyrics").isNull())
    return first_per_key(texts, ["track_uri"], ["_none", "source_no", "lyrics"]).drop("_none", "source_no")


def enrich_plays(plays, library, lyrics, with_text=True):
    """History with audio features and lyrics; plays without a match keep NULLs.

    Both right sides hold one row per key, so the joins never multiply plays. Plays are the
    left side of each, which lets Spark split a hot track over many tasks. With
    `with_text=False` the `lyrics` column is only a marker (1 or NULL): texts stay in their
    own table, and are not repeated for every play of a track.
    """
    audio = unique_library(library).drop("source_no", "album_release_date")
    texts = unique_lyrics(lyrics)
    if not with_text:
        texts = texts.select("track_uri", F.when(F.col("lyrics").isNotNull(), 1).alias("lyrics"))
    return plays.join(audio, "track_id", "left").join(texts, "track_uri", "left")


def finish_clean(enriched, core=tuple(CORE)):
    """Drop incomplete rows, fill the three optional columns."""
    text = enriched.withColumn("explicit", F.col("explicit").cast("string"))
    return (text.dropna(subset=list(core)).fillna(FILL_VALUES)
            .withColumn("skipped", F.col("skipped").cast("int")))


def build_clean_plays(plays, library, lyrics, empties=(), rules=None, nulls=(), with_text=True):
    """History ⟕ library ⟕ lyrics → imputed genres → complete rows."""
    return finish_clean(impute_genres(enrich_plays(plays, library, lyrics, with_text), empties, rules, nulls))
