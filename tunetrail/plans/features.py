"""Feature columns shared by reports and models."""

from pyspark.sql import functions as F

from tunetrail.functions.genres import consolidate, dominant_genre, parse_list
from tunetrail.functions.time import with_time_features
from tunetrail.operators.features import assemble, genre_onehot, label_encode, tod_dummies, zscore_apply, zscore_fit
from tunetrail.operators.lyrics import counted_lyrics, tfidf_model, tokens_of, vocabulary
from tunetrail.schema import SCALED_AUDIO, TREE_FEATURES

#: Columns that the vectors of the snapshot models are made of, besides the key of the track.
SNAPSHOT_COLUMNS = [*SCALED_AUDIO, "time_of_day", "is_weekend", "genres_list"]


def add_features(plays, tz=None, on_error="single"):
    """Time parts and the parsed genre list."""
    return with_time_features(plays, tz=tz).withColumn("genres_list", parse_list(F.col("genres"), on_error))


def lyric_vectors(plays, lyrics, stop_words=(), key="track_id", cap=100, min_df=2, max_df=0.7, times=None):
    """(key, lyric_features) per track and the words of the vocabulary.

    The corpus is one document per play, but a text is tokenised once: document counts are
    weighted by the plays of its track, and only the finished vectors are joined to plays. `times`
    names a column that says how many plays a row stands for.
    """
    counts = plays.groupBy(key).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_plays"))
    terms = counted_lyrics(lyrics.where(F.col("lyrics").isNotNull()), key, stop_words=stop_words)
    # Spark takes an array for one entry: without the hint it may send all term counts to every task.
    weighted = terms.join(counts.hint("shuffle_hash"), key)
    model, words = tfidf_model(vocabulary(weighted, min_df, max_df, cap, weight="_plays"))
    return model.transform(terms.select(key, tokens_of().alias("tokens"))).select(key, "lyric_features"), words


def snapshot_features(plays, lyrics, split="split", stop_words=(), fit_on="train", top_genres=20, key="track_id", times=None,
                      **limits):
    """Vectors for the snapshot models: `with_lyrics` (given lyrics) and `audio_only`, with their column names.

    `plays` carries the columns of `add_features` and a `split` column; `lyrics` holds one
    text per track. Scaling, genres and vocabulary are fitted on the train rows, or on all
    rows with `fit_on="all"`. Plays without lyrics or with an unknown feature are left out. `times`
    names a column that says how many plays a row stands for.
    """
    plays = plays.dropna(subset=SNAPSHOT_COLUMNS)
    fit_rows = plays if fit_on == "all" else plays.where(F.col(split) == "train")
    scaled = zscore_apply(plays, zscore_fit(fit_rows, times=times))
    flagged, genre_names = genre_onehot(tod_dummies(scaled), top_genres, fit_on=fit_rows, times=times)
    day_names = [c for c in flagged.columns if c.startswith("time_of_day_")]
    rest = day_names + ["is_weekend"] + genre_names

    audio = assemble(flagged, SCALED_AUDIO + rest, "audio_only")
    if lyrics is None:
        return audio, {"audio_only": SCALED_AUDIO + rest}
    vectors, words = lyric_vectors(fit_rows, lyrics, stop_words, key, times=times, **limits)
    both = assemble(audio.join(vectors.hint("shuffle_hash"), key), SCALED_AUDIO + ["lyric_features"] + rest, "with_lyrics")
    return both, {"with_lyrics": SCALED_AUDIO + [f"lyric_{w}" for w in words] + rest, "audio_only": SCALED_AUDIO + rest}


def tree_features(plays, priority=None):
    """Inputs of the shallow tree: genre merged and encoded, rows with a NULL dropped."""
    df = plays.withColumn("dominant_genre", consolidate(dominant_genre(F.col("genres_list"), priority)))
    df = df.dropna(subset=TREE_FEATURES + ["skipped"])
    for col in ("dominant_genre", "time_of_day"):
        df = label_encode(df, col)
    inputs = [f"{c}_encoded" if c in ("dominant_genre", "time_of_day") else c for c in TREE_FEATURES]
    return assemble(df, inputs, "features"), list(TREE_FEATURES)
