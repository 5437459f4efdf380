"""Named queries over the test tables: name → (spark, sf_dir) → DataFrame."""

from functools import reduce
from uuid import uuid4

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tunetrail.functions.genres import consolidate, dominant_genre, parse_list
from tunetrail.functions.text import artist_key, fix_mojibake, page_url, strip_accents, title_case, title_key
from tunetrail.functions.time import clock_label, context_label, day_label, with_time_features
from tunetrail.functions.values import bin3, bools_to_int, remap, to_flag, to_number
from tunetrail.operators import evaluate, features, lyrics, stats
from tunetrail.operators.dedupe import duplicate_count, first_per_key
from tunetrail.operators.impute import impute_candidates, impute_genres
from tunetrail.operators.models import flatten_windows, side_by_side
from tunetrail.operators.sessions import sequence_windows, sessionize
from tunetrail.operators.split import stratified_split, time_split
from tunetrail.operators.vibe import vibe_top_k, vibe_tracks
from tunetrail.plans import testviews as views, training
from tunetrail.plans.clean import build_clean_plays, enrich_plays, unique_library
from tunetrail.plans.dashboard import count_tables
from tunetrail.plans.features import lyric_vectors
from tunetrail.schema import CORRELATED, FILL_VALUES, MOOD_FEATURES, SCALED_AUDIO
from tunetrail.session import checkpoint, shared_folder
from tunetrail.sources.pages import content_lyrics, extract_page_lyrics
from tunetrail.sources.readers import conform_library, conform_plays, enrichment_worklist, stack
from tunetrail.sources.sinks import write_tables

# Gap of the test plays: users are sparse, a 20-minute gap leaves no long sessions.
GAP = 720
SEQUENCE = ["energy", "valence", "popularity"]
EXPLAINED = ["popularity", "loudness", "speechiness", "valence"]
PAGE_PATTERN = "https://lyrics.example/%s/%s.html"

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- time and dashboard aggregates ---------------------------------------------------

@query
def time_features(spark, sf):
    df = with_time_features(views.event_plays(spark, sf))
    return df.select("play_id", "hour", "day_of_week", "month", "is_weekend", "time_of_day",
                     day_label(F.col("day_of_week")).alias("day_label"),
                     clock_label(F.col("hour")).alias("clock_label"),
                     context_label(F.col("hour")).alias("context_label"))


@query
def skip_heatmap(spark, sf):
    return stats.skip_heatmap(with_time_features(views.event_plays(spark, sf)))


@query
def hourly_skip(spark, sf):
    return stats.hourly_skip(with_time_features(views.event_plays(spark, sf)))


@query
def hour_extremes(spark, sf):
    return stats.hour_extremes(hourly_skip(spark, sf))


@query
def kpi_summary(spark, sf):
    return stats.kpi_summary(views.line_plays(spark, sf))


@query
def class_distribution(spark, sf):
    return stats.class_distribution(views.line_plays(spark, sf))


@query
def tod_skip_delta(spark, sf):
    return stats.tod_skip_rate(with_time_features(views.event_plays(spark, sf)))


# ---- sources, duplicates, clean table ------------------------------------------------

@query
def library_union(spark, sf):
    return stack(views.library_files(spark, sf)).select(
        "track_id", "source_no", F.round("tempo", 4).alias("tempo"), "popularity", "genres")


@query
def library_dedupe(spark, sf):
    return unique_library(stack(views.library_files(spark, sf))).select(
        "track_id", "source_no", F.round("tempo", 4).alias("tempo"), "popularity", "genres")


@query
def duplicate_counts(spark, sf):
    return duplicate_count(stack(views.library_files(spark, sf)), "track_id")


@query
def distinct_genre_texts(spark, sf):
    return views.audio_library(spark, sf).select("genres").distinct()


def named_plays(spark, sf):
    """Order plays with names and an address for their track."""
    return views.order_plays(spark, sf).join(
        views.audio_library(spark, sf).select("track_id", "track_name", "artist"), "track_id").withColumn(
        "track_uri", F.concat(F.lit("track:"), F.col("track_id").cast("string")))


@query
def enrichment_batch(spark, sf):
    done = views.lyrics(spark, sf).select(F.concat(F.lit("track:"), F.col("track_id").cast("string")).alias("track_uri"))
    return enrichment_worklist(named_plays(spark, sf), done)


@query
def enrichment_top(spark, sf):
    return enrichment_worklist(named_plays(spark, sf), limit=100, offset=50)


@query
def first_plays(spark, sf):
    return first_per_key(views.order_plays(spark, sf), ["track_id"], ["ts", "play_id"])


def enriched_plays(spark, sf):
    """History ⟕ deduplicated library files ⟕ lyrics."""
    library = stack(views.library_files(spark, sf)).drop("track_name", "artist")
    plays = named_plays(spark, sf).withColumns({
        "reason_start": F.when(F.col("skipped") == 1, "clickrow"), "reason_end": F.lit(None).cast("string")})
    return enrich_plays(plays, library, views.lyric_files(spark, sf))


def imputed_plays(spark, sf):
    empties, rules, nulls = views.genre_lookups(spark, sf)
    return impute_genres(enriched_plays(spark, sf), empties, rules, nulls)


@query
def clean_plays(spark, sf):
    """The library's own path, over files with repeated and missing lyrics."""
    empties, rules, nulls = views.genre_lookups(spark, sf)
    plays = named_plays(spark, sf).withColumns({
        "reason_start": F.when(F.col("skipped") == 1, "clickrow"), "reason_end": F.lit(None).cast("string")})
    library = stack(views.library_files(spark, sf)).drop("track_name", "artist")
    df = build_clean_plays(plays, library, views.lyric_files(spark, sf), empties, rules, nulls)
    return rounded(df, ["tempo", "loudness", "energy"]).select(
        "play_id", "user_id", "track_id", "track_name", "artist", "genres", "explicit", "reason_start", "reason_end",
        "skipped", "popularity", "tempo", "loudness", "energy", F.md5("lyrics").alias("lyrics_md5"))


@query
def conformed_plays(spark, sf):
    """Text rows under export names through the conforming step of the play reader."""
    return conform_plays(views.exported_plays(spark, sf)).select(
        "play_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "track_id", "track_uri", "track_name",
        "artist", "skipped", "ms_played", "platform")


@query
def conformed_library(spark, sf):
    return conform_library(views.exported_library(spark, sf)).select(
        "track_id", F.round("tempo", 4).alias("tempo"), "popularity", "genres", "explicit", "key")


@query
def genre_imputation(spark, sf):
    empties, rules, nulls = views.genre_lookups(spark, sf)
    return impute_genres(views.audio_library(spark, sf), empties, rules, nulls).select(
        "track_id", "artist", "track_name", "genres")


@query
def impute_candidate_tracks(spark, sf):
    return impute_candidates(enriched_plays(spark, sf)).select("track_uri", "play_id", "artist", "track_name")


@query
def null_fill(spark, sf):
    plays = views.event_plays(spark, sf)
    return plays.fillna({c: v for c, v in FILL_VALUES.items() if c in plays.columns}).select("play_id", "reason_start", "reason_end")


@query
def explicit_normalise(spark, sf):
    df = views.audio_library(spark, sf).withColumn("loud", F.col("loudness") > -30)
    return bools_to_int(df).select("track_id", to_flag(F.col("explicit")).alias("explicit"), "loud",
                                   to_number(F.col("explicit")).alias("explicit_number"))


@query
def remapped_reasons(spark, sf):
    reasons = views.event_plays(spark, sf)
    names = reasons.select(F.col("reason_end").alias("from")).distinct().where(F.col("from").isin("view", "error")) \
        .withColumn("to", F.concat(F.lit("skip:"), "from"))
    kept = remap(reasons.withColumn("reason", F.col("reason_end")), "reason", names)
    return remap(kept.withColumn("known", F.col("reason_end")), "known", names, keep_unmatched=False).select(
        "play_id", "reason", "known")


# ---- genres --------------------------------------------------------------------------

@query
def genre_parse(spark, sf):
    return views.audio_library(spark, sf).select(
        "track_id", F.array_join(parse_list(F.col("genres")), "|").alias("single"),
        F.array_join(parse_list(F.col("genres"), "empty"), "|").alias("empty"),
        F.size(parse_list(F.col("genres"))).alias("n"))


@query
def genre_top20(spark, sf):
    return stats.top_genres(views.counted_tracks(spark, sf), times="plays")


@query
def genre_onehot(spark, sf):
    flagged, names = features.genre_onehot(views.clean_event_plays(spark, sf))
    return flagged.select("play_id", *names).unpivot("play_id", names, "column", "flag")


@query
def genre_share_top10(spark, sf):
    return stats.genre_share(views.counted_tracks(spark, sf), times="plays")


def with_dominant(spark, sf):
    df = imputed_plays(spark, sf).withColumn("genres_list", parse_list(F.col("genres")))
    return df.withColumn("dominant_genre", dominant_genre(F.col("genres_list")))


@query
def dominant_genres(spark, sf):
    return with_dominant(spark, sf).select(
        "play_id", "dominant_genre", consolidate(F.col("dominant_genre")).alias("merged_genre"))


@query
def dominant_genre_report(spark, sf):
    return stats.category_report(
        with_dominant(spark, sf).withColumn("dominant_genre", consolidate(F.col("dominant_genre"))), "dominant_genre")


@query
def wide_artists(spark, sf):
    return stats.wide_stats(views.counted_tracks(spark, sf), "artist", times="plays")


@query
def wide_songs(spark, sf):
    return stats.wide_stats(views.counted_tracks(spark, sf), ["track_name", "artist"], times="plays")


@query
def wide_genres(spark, sf):
    return stats.wide_stats(stats.exploded_genres(views.counted_tracks(spark, sf)), "genre", times="plays")


@query
def wide_listener_tracks(spark, sf):
    """Top (listener, track) pairs, of which there are about as many as plays."""
    return stats.wide_stats_of_many(views.order_plays(spark, sf), ["user_id", "track_id"])


@query
def frequent_tracks(spark, sf):
    return stats.frequent_values(views.line_plays(spark, sf), "track_id", 50)


@query
def export_tables(spark, sf):
    """The count tables of the export, written by the sink and read back, as one long table."""
    folder = f"{shared_folder(spark).rstrip('/')}/export-{uuid4().hex}"
    written = write_tables(count_tables(views.clean_event_plays(spark, sf)), folder)
    columns = {
        "skip_heatmap": ["day_label", "hour", "total_skips", "total_plays"],
        "hourly_skip": ["time_label", "hour", "total_skips", "total_plays"],
        "kpis": ["Metric", None, "Value", None],
        "top_lists/artists": ["artist", None, "Skipped_Count", "Completed_Count"],
        "top_lists/songs": ["track_name", "artist", "Skipped_Count", "Completed_Count"],
        "top_lists/genres": ["genre", None, "Skipped_Count", "Completed_Count"],
    }
    kinds = {"first": "string", "second": "string", "skips": "double", "plays": "double"}
    long = reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("name"), *[
            (F.lit(None) if c is None else F.col(c)).cast(kind).alias(alias) for c, (alias, kind) in zip(picked, kinds.items())])
        for name, picked in columns.items()])
    return long.join(written.withColumnRenamed("rows", "rows_written"), "name")


# ---- sessions ------------------------------------------------------------------------

def session_rows(found):
    return found.select("play_id", "user_id", "session_no", "session_plays", F.round("diff_minutes", 4).alias("diff_minutes"))


@query
def sessions(spark, sf):
    return session_rows(sessionize(views.event_plays(spark, sf), GAP))


@query
def heavy_listener_sessions(spark, sf):
    """The same sessions through the bucketed path of heavy listeners."""
    return session_rows(sessionize(views.event_plays(spark, sf), GAP, hot_rows=10))


@query
def rough_sessions(spark, sf):
    """Plays without a time or a listener, and one busy hour."""
    return session_rows(sessionize(views.rough_event_plays(spark, sf), 20))


@query
def rough_heavy_sessions(spark, sf):
    return session_rows(sessionize(views.rough_event_plays(spark, sf), 20, hot_rows=100))


@query
def session_summary(spark, sf):
    plays = views.event_plays(spark, sf)
    return stats.session_summary(plays, sessionize(plays, GAP))


def event_windows(spark, sf, features=None, **options):
    plays = views.clean_event_plays(spark, sf)
    tagged = plays.withColumn("primary_genre", dominant_genre(F.col("genres_list"), ["small", "medium", "large"]))
    return sequence_windows(sessionize(tagged, GAP, **options), (features or SEQUENCE) + ["primary_genre"])


def joined_steps(field, digits=None):
    value = lambda s: (s[field] if digits is None else F.round(s[field], digits).cast("decimal(12,4)")).cast("string")
    return F.array_join(F.transform("seq", value), "|")


@query
def seq_windows(spark, sf):
    return event_windows(spark, sf).select(
        "play_id", "user_id", "target", joined_steps("energy", 4).alias("energy"),
        joined_steps("popularity").alias("popularity"))


@query
def heavy_listener_windows(spark, sf):
    return event_windows(spark, sf, hot_rows=10).select(
        "play_id", "user_id", "target", joined_steps("energy", 4).alias("energy"),
        joined_steps("popularity").alias("popularity"))


@query
def rough_windows(spark, sf):
    found = sessionize(views.rough_event_plays(spark, sf), 20, hot_rows=100)
    return sequence_windows(found, ["track_id"]).select("play_id", "user_id", "target", joined_steps("track_id").alias("tracks"))


@query
def seq_genres(spark, sf):
    return event_windows(spark, sf).select("play_id", joined_steps("primary_genre").alias("genres"))


@query
def chronological_split(spark, sf):
    return time_split(checkpoint(event_windows(spark, sf).drop("seq"))).select("play_id", "target", "split")


@query
def window_explain(spark, sf):
    return rounded(evaluate.explain_windows(event_windows(spark, sf), SEQUENCE), ["value", "intensity"], 4)


@query
def window_explain_moods(spark, sf):
    """The four features that a window is explained by."""
    windows = event_windows(spark, sf, EXPLAINED)
    return rounded(evaluate.explain_windows(windows, EXPLAINED), ["value", "intensity"], 4)


# ---- text ----------------------------------------------------------------------------

def page_names(spark, sf):
    """Track names as an export spells them: articles, brackets, guests, versions."""
    return views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("track_id"),
        F.concat(F.lit("The "), F.col("p_brand"), F.lit(" & Añe$, Jr.")).alias("artist"),
        F.concat(F.initcap("p_name"), F.lit(" ("), F.col("p_type"), F.lit(" Édit) [Live] "),
                 F.when(F.col("p_size") > 25, F.concat(F.lit("feat. "), "p_brand")).otherwise(F.lit("- Remastered"))).alias("title"))


@query
def artist_keys(spark, sf):
    return page_names(spark, sf).select("track_id", artist_key(F.col("artist")).alias("artist_key"))


@query
def title_keys(spark, sf):
    return page_names(spark, sf).select(
        "track_id", title_key(F.col("title")).alias("title_key"), title_case(F.col("title")).alias("title_case"))


@query
def page_urls(spark, sf):
    return page_names(spark, sf).select("track_id", page_url(F.col("artist"), F.col("title"), PAGE_PATTERN).alias("url"))


@query
def plain_lyrics(spark, sf):
    return views.lyrics(spark, sf).select("track_id", strip_accents(F.col("lyrics")).alias("plain"))


@query
def repaired_lyrics(spark, sf):
    broken = F.decode(F.encode("lyrics", "UTF-8"), "ISO-8859-1")
    return views.lyrics(spark, sf).select(
        "track_id", F.md5(fix_mojibake(broken)).alias("repaired"), F.md5(fix_mojibake(F.col("lyrics"))).alias("untouched"))


@query
def repaired_escapes(spark, sf):
    """Lyrics as a spreadsheet export leaves them: escapes for line ends, some texts missing."""
    texts = views.lyrics(spark, sf)
    escaped = F.concat(F.replace("lyrics", F.lit(" "), F.lit(r"\n")), F.lit(r"_X000d_\r"))
    escaped = F.when(F.col("track_id") % 7 != 0, F.decode(F.encode(escaped, "UTF-8"), "ISO-8859-1"))
    return texts.select("track_id", F.md5(fix_mojibake(escaped, strip_escapes=True)).alias("repaired"))


@query
def page_lyrics(spark, sf):
    return extract_page_lyrics(views.table(spark, sf, "pages")).select("page_id", "n_br", "lyrics")


@query
def page_lyrics_plain_first(spark, sf):
    """The page rule that prefers the second class-less block."""
    return extract_page_lyrics(views.table(spark, sf, "pages"), prefer_plain=True).select("page_id", F.md5("lyrics").alias("lyrics_md5"))


@query
def page_content_lyrics(spark, sf):
    """Every page behind a content block with nested blocks, of one plain block or two, by page number."""
    number = F.col("page_id").cast("string")
    two = F.concat(F.lit('<div class="text"><div>head</div> <div>'), number,
                   F.lit('<br>line<div class="note">in<p>deep</div>tail</div></div>'))
    one = F.concat(F.lit('<div class="text"><p class="a">x<br></p><p>'), number,
                   F.lit('<br>a<b>bold<br/></b>z</p><div>one</div></div>'))
    nested = views.table(spark, sf, "pages").withColumn("html", F.concat(
        F.when(F.col("page_id") % 2 == 0, two).otherwise(one), F.coalesce("html", F.lit(""))))
    return content_lyrics(nested, "text").select("page_id", "lyrics")


def stop_words(spark):
    words = lyrics.language_stop_words("english") + lyrics.language_stop_words("spanish")
    return lyrics.analysed_words(spark, list(words) + views.EXTRA_STOP_WORDS)


def lyric_terms(spark, sf):
    return lyrics.counted_lyrics(views.lyrics(spark, sf), "track_id", stop_words=stop_words(spark))


@query
def tokens_clean(spark, sf):
    tokens = lyrics.drop_stop_words(lyrics.tokenize(views.lyrics(spark, sf)), stop_words(spark))
    return tokens.select("track_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query
def vocab_top100(spark, sf):
    return lyrics.vocabulary(lyric_terms(spark, sf)).select("token", "position", "df", "total")


@query
def played_vocab_top100(spark, sf):
    """Vocabulary over plays: a track's lyrics count once per play, but are tokenised once."""
    plays = views.order_plays(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("plays"))
    docs = lyric_terms(spark, sf).join(plays, "track_id")
    return lyrics.vocabulary(docs, weight="plays").select("token", "position", "df", "total")


@query
def lyrics_tfidf(spark, sf):
    docs = lyric_terms(spark, sf)
    return rounded(lyrics.tfidf(docs, lyrics.vocabulary(docs), "track_id"), ["weight"])


@query
def token_weight_top50(spark, sf):
    docs = lyric_terms(spark, sf)
    return rounded(lyrics.token_totals(lyrics.tfidf(docs, lyrics.vocabulary(docs), "track_id")), ["weight"], 4)


@query
def tfidf_vectors(spark, sf):
    """The Spark ML form of the weights, read back as rows."""
    docs = lyric_terms(spark, sf)
    stages, names = lyrics.tfidf_model(lyrics.vocabulary(docs))
    words = F.array(*[F.lit(n) for n in names])
    cells = F.transform(vector_to_array("lyric_features"), lambda v, i: F.struct(F.get(words, i).alias("token"), v.alias("weight")))
    vectors = stages.transform(docs.select("track_id", lyrics.tokens_of().alias("tokens")))
    return rounded(lyrics.unfold(vectors.withColumn("cells", F.filter(cells, lambda c: c["weight"] != 0)),
                                 "cells", "track_id"), ["weight"])


# ---- correlation, recommender --------------------------------------------------------

def correlated_plays(spark, sf):
    library = unique_library(stack(views.library_files(spark, sf)))
    return views.order_plays(spark, sf).join(library, "track_id")


@query
def correlations(spark, sf):
    return stats.corr_long(correlated_plays(spark, sf), CORRELATED)


@query
def correlations_listwise(spark, sf):
    return stats.corr_long(correlated_plays(spark, sf), CORRELATED, "listwise")


@query
def play_count_filter(spark, sf):
    return stats.frequent_only(stats.play_counts(views.clean_order_plays(spark, sf)))


@query
def feature_bins(spark, sf):
    return views.audio_library(spark, sf).select("track_id", *[bin3(F.col(f)).alias(f"{f}_bin") for f in MOOD_FEATURES])


@query
def vibe_top5(spark, sf):
    return vibe_top_k(vibe_tracks(views.clean_order_plays(spark, sf)), priority=["small", "promo", "ring"])


# ---- model inputs --------------------------------------------------------------------

@query
def zscores(spark, sf):
    library = views.audio_library(spark, sf).withColumn("constant", F.lit(3.0))
    cols = SCALED_AUDIO + ["constant"]
    scaled = features.zscore_apply(library, features.zscore_fit(library, cols), cols)
    return rounded(scaled, cols).select("track_id", *cols)


@query
def tod_dummies(spark, sf):
    df = features.tod_dummies(with_time_features(views.event_plays(spark, sf)))
    return df.select("play_id", "time_of_day_Evening", "time_of_day_Morning", "time_of_day_Night")


@query
def label_codes(spark, sf):
    return features.label_encode(views.event_plays(spark, sf), "reason_start").select("play_id", "reason_start_encoded")


@query
def strat_split(spark, sf):
    return stratified_split(views.order_plays(spark, sf)).select("play_id", "skipped", "split")


@query
def class_weights(spark, sf):
    plays = views.line_plays(spark, sf)
    balanced = features.class_weights(plays).withColumnRenamed("weight", "balanced")
    positive = features.class_weights(plays, mode="positive").withColumnRenamed("weight", "positive")
    return rounded(balanced.join(positive, "skipped"), ["balanced", "positive"])


@query
def class_ratio(spark, sf):
    return rounded(features.class_ratio(views.line_plays(spark, sf)), ["ratio"])


def rule_scored(spark, sf):
    score = F.round(0.6 * F.col("energy") + 0.4 * (1 - F.col("valence")), 3)
    return views.clean_order_plays(spark, sf).withColumn("score", score).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int"))


@query
def eval_report(spark, sf):
    return evaluate.classification_metrics(rule_scored(spark, sf))


@query
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(rule_scored(spark, sf)), ["auc"])


@query
def scoreboard(spark, sf):
    """Two rule-based scores side by side, in long form."""
    plays = rule_scored(spark, sf)
    other = plays.withColumn("prediction", (F.col("popularity") > 25).cast("int"))
    return evaluate.compare_models({"mood rule": evaluate.classification_metrics(plays),
                                    "popularity rule": evaluate.classification_metrics(other)})


# ---- models (rows only: fitted parameters are not expressible in SQL) ----------------

def prepared(spark, sf, with_lyrics=True, **options):
    """Plays of the tracks that have lyrics, as model inputs. Other plays are left out before they are joined to the library."""
    texts = views.lyrics(spark, sf)
    known = views.order_plays(spark, sf).join(texts.select("track_id"), "track_id", "left_semi")
    plays = with_time_features(known.join(views.tagged_library(spark, sf), "track_id"))
    return training.prepare_snapshot(plays, texts if with_lyrics else None, stop_words(spark) if with_lyrics else (),
                                     **options)


def sequence_scores(spark, sf):
    """{name: scored test windows} of the next-skip network, without and with lyrics."""
    plays = views.clean_event_plays(spark, sf)
    vectors, _ = lyric_vectors(plays, views.lyrics(spark, sf), stop_words(spark))
    tables = {"play windows": None, "play windows + lyrics": checkpoint(vectors)}
    return {name: training.fit_sequence_model(*training.sequence_table(plays, GAP, lyric_vectors=table))[1]
            for name, table in tables.items()}


@query
def model_scoreboard(spark, sf):
    """All six models; the audio-only elastic net over its whole grid, the others at one point of theirs."""
    train, test, _ = prepared(spark, sf)
    fits = training.snapshot_fits(train, training.QUICK_MODELS)
    fitted = side_by_side(spark, fits | {"windows": lambda: sequence_scores(spark, sf)})
    return training.compare({name: fitted[name] for name in fits}, test, fitted["windows"])


@query
def model_coefficients(spark, sf):
    train, _, names = prepared(spark, sf, count_from=training.COUNT_FROM)
    model, _, vector = training.fit_snapshot_models(train, {"m": training.QUICK_MODELS["elastic net + lyrics"]})["m"]
    return evaluate.coefficient_table(spark, model, names[vector], 15)


@query
def model_importances(spark, sf):
    train, _, names = prepared(spark, sf, with_lyrics=False, count_from=training.COUNT_FROM)
    model, _, vector = training.fit_snapshot_models(train, {"m": training.QUICK_MODELS["boosted trees"]})["m"]
    return evaluate.importance_table(spark, model, names[vector], 15)


@query
def skip_tree(spark, sf):
    model, names = training.fit_skip_tree(views.clean_event_plays(spark, sf), ["small", "medium", "large"])
    return evaluate.importance_table(spark, model, names)


@query
def skip_tree_rules(spark, sf):
    """Split rules of the tree, a line a row."""
    model, names = training.fit_skip_tree(views.clean_event_plays(spark, sf), ["small", "medium", "large"])
    rules = evaluate.tree_rules(model, names).splitlines()[1:]
    return spark.createDataFrame(list(enumerate(rules)), "line int, rule string")


@query
def wordcloud(spark, sf):
    labelled = views.table(spark, sf, "labels").select(F.col("doc_id").alias("track_id"), (1 - F.col("quality")).alias("skipped"))
    return training.wordcloud(views.lyrics(spark, sf).join(labelled, "track_id"), key="track_id",
                              stop_words=stop_words(spark))


@query
def word_effects(spark, sf):
    """The word table over a stand-in for coefficients: by how many plays a track is skipped more often than not."""
    margin = (F.sum("skipped") * 4 - F.count("skipped")).cast("double")
    tracks = views.line_plays(spark, sf).groupBy("track_id").agg(margin.alias("coefficient"))
    return evaluate.word_effects(tracks.select(F.concat(F.lit("lyric_"), "track_id").alias("feature"), "coefficient"))


def track_vectors(spark, sf):
    """Three simple lyric numbers per track, in place of fitted token weights."""
    texts = views.lyrics(spark, sf)
    n = F.length("lyrics")
    return texts.select("track_id", array_to_vector(F.array(
        (n % 7).cast("double"), (n % 11).cast("double"), (n % 13).cast("double"))).alias("lyric_features"))


def vector_text(windows, names):
    """A flattened window as text: three decimals of every number."""
    vectors = flatten_windows(windows, names).withColumn("values", vector_to_array("features"))
    shown = F.transform("values", lambda v: (F.round(v, 3) + 0.0).cast("decimal(12,3)").cast("string"))
    return vectors.select("play_id", "target", F.size("values").alias("n_values"), F.md5(F.array_join(shown, "|")).alias("vector_md5"))


@query
def window_vectors(spark, sf):
    """Every numeric column of the last five plays, flattened."""
    return vector_text(*training.sequence_table(views.clean_event_plays(spark, sf), GAP))


@query
def window_vectors_with_lyrics(spark, sf):
    return vector_text(*training.sequence_table(views.clean_event_plays(spark, sf), GAP, lyric_vectors=track_vectors(spark, sf)))


@query
def sequence_confident_skips(spark, sf):
    plays = views.clean_event_plays(spark, sf)
    windows, names = training.sequence_table(plays, GAP)
    _, scored = training.fit_sequence_model(windows, names)
    return evaluate.confident_skips(scored, n=10).select("play_id", "user_id", "confidence", "target")


@query
def sequence_confident_skips_with_lyrics(spark, sf):
    """The same with the lyric vector of each step's track; only tracks with lyrics."""
    plays = views.clean_event_plays(spark, sf)
    vectors, _ = lyric_vectors(plays, views.lyrics(spark, sf), stop_words(spark))
    windows, names = training.sequence_table(plays, GAP, lyric_vectors=checkpoint(vectors))
    _, scored = training.fit_sequence_model(windows, names)
    return evaluate.confident_skips(scored, n=10).select("play_id", "user_id", "confidence", "target")
