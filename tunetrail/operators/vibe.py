"""Track recommendations: the nearest tracks to each mood bin."""

from itertools import product
from math import inf, sqrt

from pyspark.sql import Window, functions as F

from tunetrail.functions.genres import dominant_genre
from tunetrail.operators.stats import frequent_only
from tunetrail.schema import DEFAULT_MOOD, MOOD_FEATURES, MOOD_LABELS
from tunetrail.session import checkpoint

BINS = [("Low", 1 / 6), ("Mid", 0.5), ("High", 5 / 6)]


def mood_bins():
    """The 81 bins: (names of the four bins, centre coordinates)."""
    return [(tuple(n for n, _ in combo), tuple(x for _, x in combo)) for combo in product(BINS, repeat=4)]


def vibe_tracks(plays, features=MOOD_FEATURES, min_quantile=0.25, tags="genres_list"):
    """One row per (track, artist) played more often than the quantile of play counts.

    Plays are read once: play count and the features of the earliest play come out of one
    aggregate, combined on the map side, and the track table is stored. Tracks whose first
    row lacks a feature are dropped after that.
    """
    first = F.min_by(F.struct(*features, tags), F.struct("ts", "play_id"))
    tracks = checkpoint(
        plays.dropna(subset=["track_name", "artist"]).groupBy("track_name", "artist")
        .agg(F.count(F.lit(1)).alias("play_count"), first.alias("_first"))
        .select("track_name", "artist", "play_count", "_first.*"))
    return frequent_only(tracks, min_quantile).dropna(subset=list(features))


def _sum_of_squares(gaps):
    """Summed squares, added in the order given."""
    squares = [g * g for g in gaps]
    total = squares[0]
    for square in squares[1:]:
        total = total + square
    return total


def _reaches(tracks, features, k):
    """Per bin, a distance within which k tracks lie for certain (infinite with fewer tracks).

    The k tracks nearest to the centre of their own bin make a sample of at most 81·k tracks;
    a bin's k-th nearest sampled track bounds its k-th nearest track from above.
    """
    centre = lambda c: F.when(c <= 1 / 3, BINS[0][1]).when(c <= 2 / 3, BINS[1][1]).otherwise(BINS[2][1])
    own = [centre(F.col(f)) for f in features]
    near = Window.partitionBy("_bin").orderBy("_own")
    sample = (tracks.withColumn("_bin", F.concat_ws("/", *own))
              .withColumn("_own", _sum_of_squares([F.col(f) - c for f, c in zip(features, own)]))
              .withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= k)
              .select(*features).collect())
    reaches = []
    for _, point in mood_bins():
        nearest = sorted(sqrt(_sum_of_squares([x - y for x, y in zip(row, point)])) for row in sample)
        reaches.append(nearest[k - 1] * (1 + 1e-9) if len(nearest) >= k else inf)
    return reaches


def vibe_top_k(tracks, features=MOOD_FEATURES, k=5, priority=None, labels=None, default=DEFAULT_MOOD):
    """The k nearest tracks to the centre of each of the 81 bins, by Euclidean distance.

    Exact without pairing every track with every bin: a first pass finds, per centre, a
    distance that k tracks are known to reach, and the second pass emits only the (track,
    centre) pairs within it, about k per centre.
    """
    spark = tracks.sparkSession
    bins = mood_bins()
    centres = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(reach).alias("reach"), *[F.lit(x).alias(f) for f, x in zip(features, point)])
                        for i, ((_, point), reach) in enumerate(zip(bins, _reaches(tracks, features, k)))])
    measured = F.transform(centres, lambda c: F.struct(
        c["bin"].alias("_bin"), c["reach"].alias("_reach"),
        F.sqrt(_sum_of_squares([F.col(f) - c[f] for f in features])).alias("_distance")))
    hits = (tracks.withColumn("_hit", F.explode_outer(F.filter(measured, lambda m: m["_distance"] <= m["_reach"])))
            .where(F.col("_hit").isNotNull())
            .select(*tracks.columns, "_hit._bin", "_hit._distance"))
    nearest = Window.partitionBy("_bin").orderBy("_distance", "track_name", "artist")
    best = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    names = [f"{f}_bin" for f in features]
    table = spark.createDataFrame(
        [(i, *n) for i, (n, _) in enumerate(bins)], "_bin int, " + ", ".join(f"{n} string" for n in names))
    if labels is None:
        labels = spark.createDataFrame(MOOD_LABELS, ", ".join(f"{n} string" for n in names) + ", vibe_label string")
    table = table.join(labels, names, "left").fillna({"vibe_label": default})
    # 81 rows.
    return best.join(F.broadcast(table), "_bin").select(
        *names, "vibe_label", "rank", "track_name", "artist",
        dominant_genre(F.col("genres_list"), priority).alias("genre"), "play_count",
        *[F.round(f, 3).alias(f) for f in features], F.round("_distance", 4).alias("distance"))
