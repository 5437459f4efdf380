"""The dashboard export: report tables of the clean plays."""

from pyspark.sql import functions as F

from tunetrail.functions.genres import parse_list
from tunetrail.operators.stats import (corr_long, exploded_genres, hourly_skip, kpi_summary, report_counts, skip_heatmap,
                                       wide_stats)
from tunetrail.operators.vibe import vibe_top_k, vibe_tracks
from tunetrail.plans.features import add_features
from tunetrail.session import checkpoint
from tunetrail.sources.sinks import write_tables


def top_lists(plays, top_n=10, times=None):
    """Artist, song and genre tables of plays, or of rows that stand for `times` plays each.

    Unparsable genre text counts as no genre here.
    """
    tags = plays.withColumn("genres_list", parse_list(F.col("genres"), "empty"))
    return {
        "artists": wide_stats(plays, "artist", top_n, times),
        "songs": wide_stats(plays, ["track_name", "artist"], top_n, times),
        "genres": wide_stats(exploded_genres(tags), "genre", top_n, times),
    }


def count_tables(plays):
    """{table name: DataFrame} of the tables that count plays, with time parts in `plays`.

    Plays are read once: the counts of two grouping sets are stored, and every table sums those;
    genre texts are parsed and exploded per counted track. Runs a job.
    """
    counts = checkpoint(report_counts(plays))
    by_time, by_track = counts.where("by_time"), counts.where("NOT by_time")
    tables = {
        "skip_heatmap": skip_heatmap(by_time, "plays"),
        "hourly_skip": hourly_skip(by_time, "plays"),
        "kpis": kpi_summary(by_time, "plays"),
    }
    tables.update({f"top_lists/{name}": df for name, df in top_lists(by_track, times="plays").items()})
    return tables


def dashboard_tables(clean, wordcloud=None):
    """{table name: DataFrame}; every table is bounded (168 rows, 405 rows, top lists …).

    Reads the clean table three times: for the counts, for the tracks of the recommender (both
    stored) and for the correlations. Runs jobs.
    """
    plays = add_features(clean)
    tables = count_tables(plays)
    tables["pick_your_vibe"] = vibe_top_k(vibe_tracks(plays))
    tables["correlations"] = corr_long(plays)
    if wordcloud is not None:
        tables["wordcloud"] = wordcloud
    return tables


def export_dashboard(clean, folder, fmt="parquet", wordcloud=None, single_file=False):
    """Write the dashboard tables; returns (name, rows). Pass a stored clean table: it is read three times."""
    return write_tables(dashboard_tables(clean, wordcloud), folder, fmt, single_file)
