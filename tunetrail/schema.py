"""Declared schemas, column groups and fixed values."""

from pyspark.sql import types as T

# ---- schemas -----------------------------------------------------------------------

PLAYS = T.StructType([
    T.StructField("play_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("track_id", T.StringType()),
    T.StructField("track_uri", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("skipped", T.IntegerType()),
    T.StructField("reason_start", T.StringType()),
    T.StructField("reason_end", T.StringType()),
    T.StructField("ms_played", T.LongType()),
    T.StructField("platform", T.StringType()),
])

LIBRARY = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("acousticness", T.DoubleType()),
    T.StructField("album_release_date", T.StringType()),
    T.StructField("danceability", T.DoubleType()),
    T.StructField("energy", T.DoubleType()),
    T.StructField("explicit", T.StringType()),
    T.StructField("genres", T.StringType()),
    T.StructField("instrumentalness", T.DoubleType()),
    T.StructField("key", T.IntegerType()),
    T.StructField("liveness", T.DoubleType()),
    T.StructField("loudness", T.DoubleType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("popularity", T.IntegerType()),
    T.StructField("speechiness", T.DoubleType()),
    T.StructField("tempo", T.DoubleType()),
    T.StructField("time_signature", T.IntegerType()),
    T.StructField("valence", T.DoubleType()),
])

LYRICS = T.StructType([
    T.StructField("track_uri", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("lyrics", T.StringType()),
])

# ---- column groups (fixed values) ---------------------------------------------------

# Continuous audio columns that are z-scored for the models.
SCALED_AUDIO = [
    "tempo", "energy", "popularity", "danceability", "valence",
    "acousticness", "liveness", "instrumentalness", "loudness", "speechiness",
]

# Columns of the correlation table, in output order.
CORRELATED = SCALED_AUDIO + ["key", "mode", "time_signature", "skipped"]

# A row of the clean table needs every one of these.
AUDIO_CORE = [
    "tempo", "energy", "key", "popularity", "mode", "time_signature", "speechiness",
    "danceability", "valence", "acousticness", "liveness", "instrumentalness", "loudness",
]
CORE = ["track_name", "artist", "track_uri", "genres"] + AUDIO_CORE + ["lyrics"]

# NULL replacements of the clean table.
FILL_VALUES = {"reason_start": "unknown", "reason_end": "unknown", "explicit": "unknown"}

MOOD_FEATURES = ["danceability", "energy", "valence", "acousticness"]

# Inputs of the shallow decision tree, in order.
TREE_FEATURES = [
    "dominant_genre", "energy", "danceability", "valence", "tempo", "acousticness",
    "speechiness", "loudness", "hour", "is_weekend", "time_of_day",
]

TIME_OF_DAY = ["Morning", "Afternoon", "Evening", "Night"]
DAY_LABELS = ["Mon", "Tues", "Wed", "Thurs", "Fri", "Sat", "Sun"]

# ---- genre values (fixed values) ----------------------------------------------------

GENRE_PRIORITY = [
    "reggaeton", "urbano latino", "trap latino", "rap", "hip hop", "latin pop", "pop",
    "dance pop", "pop rap", "reggaeton colombiano", "trap", "puerto rican pop",
    "trap boricua", "latin hip hop", "trap triste", "urban contemporary",
    "colombian pop", "reggaeton flow", "afrobeats",
]

GENRE_CONSOLIDATION = {
    "Rap": "Rap/Hip Hop",
    "Hip Hop": "Rap/Hip Hop",
    "Trap": "Rap/Hip Hop",
    "Urban Contemporary": "Rap/Hip Hop",
    "Trap Latino": "Urbano Latino",
    "Latin Hip Hop": "Urbano Latino",
    "Trap Triste": "Urbano Latino",
    "Colombian Pop": "Latin Pop",
    "Pop Rap": "Pop",
    "Dance Pop": "Pop",
}

# Mood names by (danceability, energy, valence, acousticness) bin; the rest get the default.
DEFAULT_MOOD = "🎵 Everyday Bop"
MOOD_LABELS = [
    ("High", "High", "High", "Low", "🔥 Hype Mode!"),
    ("High", "High", "High", "Mid", "🔥 Hype Mode!"),
    ("High", "High", "High", "High", "🎉 Festival Ready"),
    ("High", "High", "Mid", "Low", "💪 Power Hour"),
    ("High", "High", "Mid", "Mid", "💪 Power Hour"),
    ("High", "High", "Low", "Low", "😤 Rage Fuel"),
    ("High", "High", "Low", "Mid", "😤 Rage Fuel"),
    ("Mid", "High", "High", "Low", "🌟 Feel Good Flow"),
    ("Mid", "High", "Mid", "Low", "🏃 Runner's High"),
    ("Low", "High", "Low", "Low", "🌩️ Dark Energy"),
    ("Low", "Low", "High", "High", "🌤️ Sunday Morning"),
    ("Low", "Low", "High", "Mid", "☀️ Good Vibes Only"),
    ("Mid", "Low", "High", "High", "🎸 Acoustic Feels"),
    ("Low", "Low", "Mid", "High", "🌙 Late Night Drive"),
    ("Low", "Low", "Low", "High", "🌧️ Rainy Day Mood"),
    ("Mid", "Low", "Mid", "High", "🍂 Cozy & Calm"),
    ("Low", "Low", "Low", "Mid", "😶‍🌫️ Introspective"),
    ("High", "Mid", "High", "Low", "💃 Dance Party"),
    ("High", "Mid", "High", "Mid", "💃 Dance Party"),
    ("High", "Mid", "Mid", "Low", "🎶 Groove Session"),
    ("Mid", "Mid", "High", "Low", "😊 Happy Place"),
    ("Mid", "Mid", "Mid", "Low", "🎵 Everyday Bop"),
    ("Mid", "Mid", "Mid", "Mid", "🎵 Everyday Bop"),
    ("Mid", "Mid", "Low", "Low", "🌀 Moody Vibes"),
    ("Low", "Mid", "High", "Mid", "🎹 Melodic Feels"),
    ("Low", "Mid", "Low", "Mid", "🖤 Brooding"),
]

# ---- page keys (fixed values) --------------------------------------------------------

# Page-name rewrites applied to a lower-cased, de-accented artist name.
ARTIST_ALIASES = {
    "beyonce": "beyonceknowles",
    "big pun": "bigpunisher",
    "bigpun": "bigpunisher",
    "a$ap rocky": "asaprocky",
    "asap rocky": "asaprocky",
    "a$ap ferg": "asapferg",
    "asap ferg": "asapferg",
    "the weeknd": "weeknd",
    "weeknd": "weeknd",
    "the police": "police",
    "the who": "who",
    "the notorious big": "notoriousbig",
    "the notorious b.i.g.": "notoriousbig",
    "the roots": "roots",
    "the game": "game",
}

# Characters dropped from page keys.
KEY_PUNCTUATION = "`',-/.!"

# ---- tuning grids (fixed values) ----------------------------------------------------

GRID_ELASTIC_LYRICS = {
    "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0],
    "C": [10.0 ** (-4 + 8 * i / 9) for i in range(10)],
}
GRID_ELASTIC_AUDIO = {"l1_ratio": [0.1, 0.5, 0.9], "C": [0.1, 1.0, 10.0]}
GRID_ELASTIC_WORDS = {"l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9, 1.0], "C": [0.01, 0.1, 1.0, 10.0]}
GRID_BOOSTED_LYRICS = {
    "n_estimators": [100, 200, 300, 400],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "max_depth": [3, 4, 5, 6, 7, 8],
    "min_child_weight": [1, 3, 5],
    "subsample": [0.6, 0.7, 0.8, 1.0],
    "colsample_bytree": [0.4, 0.6, 0.8, 1.0],
}
GRID_BOOSTED_AUDIO = {
    "n_estimators": [100, 200],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.1],
}

# One point of each grid, for fits without a search.
POINT_ELASTIC_LYRICS = {"l1_ratio": [0.5], "C": [10.0 ** (-4 + 8 * 4 / 9)]}
POINT_BOOSTED_LYRICS = {"n_estimators": [100], "learning_rate": [0.1], "max_depth": [3], "min_child_weight": [3],
                        "subsample": [0.8], "colsample_bytree": [0.6]}
POINT_BOOSTED_AUDIO = {"n_estimators": [100], "max_depth": [3], "learning_rate": [0.1]}
