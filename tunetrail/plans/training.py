"""Train and compare the skip classifiers."""

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tunetrail.functions.genres import dominant_genre, genre_flags
from tunetrail.functions.values import bools_to_int, numeric_columns, to_flag
from tunetrail.operators.evaluate import classification_metrics, compare_models, wordcloud_table
from tunetrail.operators.features import count_equal, tod_dummies, with_class_weight, zscore_apply, zscore_fit
from tunetrail.operators.lyrics import counted_lyrics, tfidf_model, tokens_of, vocabulary
from tunetrail.operators.models import (fit_boosted, fit_elastic_net, fit_sequence, fit_tree, flatten_windows,
                                        side_by_side)
from tunetrail.operators.sessions import sequence_windows, sessionize
from tunetrail.operators.split import stratified_split, time_split
from tunetrail.operators.stats import top_genres
from tunetrail.plans.features import SNAPSHOT_COLUMNS, snapshot_features, tree_features
from tunetrail.schema import (GRID_BOOSTED_AUDIO, GRID_BOOSTED_LYRICS, GRID_ELASTIC_AUDIO, GRID_ELASTIC_LYRICS,
                              GRID_ELASTIC_WORDS, POINT_BOOSTED_AUDIO, POINT_BOOSTED_LYRICS, POINT_ELASTIC_LYRICS)
from tunetrail.session import checkpoint

# The four snapshot models: name → (vector column, kind, grid, folds, metric, sampled grid points).
SNAPSHOT_MODELS = {
    "elastic net + lyrics": ("with_lyrics", "elastic", GRID_ELASTIC_LYRICS, 5, "roc_auc", None),
    "boosted trees + lyrics": ("with_lyrics", "boosted", GRID_BOOSTED_LYRICS, 3, "roc_auc", 50),
    "elastic net": ("audio_only", "elastic", GRID_ELASTIC_AUDIO, 5, "accuracy", None),
    "boosted trees": ("audio_only", "boosted", GRID_BOOSTED_AUDIO, 3, "accuracy", None),
}

# The same models where a search takes too long: only the nine points of the audio-only elastic net are searched.
QUICK_MODELS = SNAPSHOT_MODELS | {
    "elastic net + lyrics": ("with_lyrics", "elastic", POINT_ELASTIC_LYRICS, 5, "roc_auc", None),
    "boosted trees + lyrics": ("with_lyrics", "boosted", POINT_BOOSTED_LYRICS, 3, "roc_auc", None),
    "boosted trees": ("audio_only", "boosted", POINT_BOOSTED_AUDIO, 3, "accuracy", None),
}

# Plays from which a query that fits single points sees equal plays as one weighted row.
COUNT_FROM = 1_000_000

# Plays with lyric vectors, about 1 KB each, that a task puts in order.
PLAYS_PER_TASK = 25_000


def prepare_snapshot(plays, lyrics=None, stop_words=(), fit_on="train", seed=42, count_from=None, key="track_id", **limits):
    """Split, features and class weights for all model fits.

    The plays are stored once and the split, scaling, genres and vocabulary are fitted from that;
    the vectors are stored once more. Without `lyrics` only the audio vectors are made.

    From `count_from` plays on, plays of a track, class and side of the split that are equal in all
    that their vectors are made of become one row, with their number in `plays` and the weight of all
    of them: a track has few such rows, however often it is played. Sums over plays stay what they are, so this is for
    fits that only add up weights. Searches by folds (no play_id), subsamples and row counts per leaf need the plays.
    """
    needed = [key, "skipped", *SNAPSHOT_COLUMNS]
    plays = checkpoint(plays.select("play_id", *needed, F.xxhash64(*plays.columns).alias("_tie")))
    split, times, kept = stratified_split(plays, seed=seed, tie="_tie"), None, ["play_id"]
    if count_from is not None and plays.count() >= count_from:
        split, times, kept = checkpoint(count_equal(split, [*needed, "split"])), "plays", ["plays"]
    vectors, names = snapshot_features(split, lyrics, "split", stop_words, fit_on, key=key, times=times, **limits)
    stored = checkpoint(vectors.select(*kept, "skipped", "split", *names))
    train = stored.where("split = 'train'")
    for mode in ("balanced", "positive"):
        train = with_class_weight(train, mode=mode, out=mode, times=times, keep=True)
    return train, stored.where("split = 'test'"), names


def snapshot_fits(train, models=None, seed=42):
    """{name: function that gives (model, chosen grid point, vector column)}."""
    def fit(vector, kind, grid, folds, metric, n_iter):
        if kind == "elastic":
            return *fit_elastic_net(train, grid, folds, metric, seed, features=vector, weight="balanced"), vector
        return *fit_boosted(train, grid, n_iter, folds, metric, seed, features=vector, weight="positive"), vector

    return {name: partial(fit, *model) for name, model in (models or SNAPSHOT_MODELS).items()}


def fit_snapshot_models(train, models=None, seed=42):
    """{name: (model, chosen grid point, vector column)}."""
    return side_by_side(train.sparkSession, snapshot_fits(train, models, seed))


def score_models(fitted, test):
    """{name: classification report} on the test rows."""
    return {name: classification_metrics(model.transform(test)) for name, (model, _, _) in fitted.items()}


# Numeric columns that say which play it is, not what it is like.
NOT_FEATURES = ("play_id", "user_id", "track_id", "skipped", "ms_played", "source_no", "session_no", "session_plays")


def sequence_table(plays, gap_minutes=20, min_plays=3, n_steps=5, n_genres=20, lyric_vectors=None, exclude=NOT_FEATURES,
                   key="track_id", **segments):
    """Play windows over every numeric column but those excluded, and the names of the features.

    Audio columns are scaled; `explicit` becomes a flag; parts of the day and the most used genres
    are flags too. With `lyric_vectors` (key, lyric_features), one row per track, the steps also
    hold the vector of their track as an array; plays of other tracks are left out.
    """
    plays = checkpoint(plays)
    names = [g.genre for g in top_genres(plays, n_genres).collect()]
    flagged = genre_flags(tod_dummies(zscore_apply(plays, zscore_fit(plays))), names)
    flags = {"explicit": to_flag(F.col("explicit"))} if "explicit" in plays.columns else {}
    tagged = bools_to_int(flagged.withColumns(flags | {"primary_genre": dominant_genre(F.col("genres_list"), names)}))
    features = numeric_columns(tagged, exclude)
    extra = []
    if lyric_vectors is not None:
        vectors = lyric_vectors.select(key, vector_to_array("lyric_features").alias("lyric_features"))
        tagged, extra = tagged.join(vectors.hint("shuffle_hash"), key), ["lyric_features"]
        segments = {"tasks": -(-plays.count() // PLAYS_PER_TASK)} | segments
    sessions = sessionize(tagged, gap_minutes, min_plays, **segments)
    return sequence_windows(sessions, features + extra + ["primary_genre"], n_steps=n_steps), features + extra


def fit_sequence_model(windows, features, n_steps=5, fraction=0.8, seed=42, hidden=(64,), max_iter=50):
    """Chronological split, network fit; returns (model, scored test windows)."""
    vectors = time_split(checkpoint(flatten_windows(windows, features)), fraction)
    width = vectors.select(F.size(vector_to_array("features"))).head()
    model = fit_sequence(vectors.where("split = 'train'"), width[0] if width else n_steps * len(features), hidden, seed,
                         max_iter=max_iter)
    return model, model.transform(vectors.where("split = 'test'"))


def compare(fitted, test, sequence_scored=None):
    """Scoreboard of all fitted models, computed from their test predictions."""
    reports = score_models(fitted, test)
    for name, scored in (sequence_scored or {}).items():
        reports[name] = classification_metrics(scored, "target")
    return compare_models(reports)


def fit_word_model(texts, label="skipped", key="play_id", stop_words=(), grid=None, folds=5, seed=42, strip_escapes=True, **limits):
    """Lyrics-only elastic net; returns (model, words)."""
    terms = counted_lyrics(texts, key, stop_words=stop_words, strip_escapes=strip_escapes, keep=[label])
    stages, words = tfidf_model(vocabulary(terms, **limits), output="features")
    vectors = stages.transform(terms.withColumn("tokens", tokens_of())).select(key, label, "features")
    split = stratified_split(vectors, label, key, seed=seed)
    train = checkpoint(with_class_weight(split.where("split = 'train'"), label))
    model, _ = fit_elastic_net(train, grid or GRID_ELASTIC_WORDS, folds, "accuracy", seed, label, key=key)
    return model, words


def wordcloud(texts, **options):
    """Words that move the skip probability, from the lyrics-only model."""
    model, words = fit_word_model(texts, **options)
    return wordcloud_table(texts.sparkSession, model, words)


def fit_skip_tree(plays, priority=None, max_depth=3):
    """Depth-3 tree on the tree features; returns (model, feature names)."""
    vectors, names = tree_features(plays, priority)
    train = checkpoint(with_class_weight(vectors.select("play_id", "skipped", "features")))
    return fit_tree(train, max_depth), names
