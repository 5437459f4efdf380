"""DuckDB SQL for the named queries, written independently of the Spark code."""

import glob
import os
import re
import unicodedata
import zipfile
from functools import lru_cache

import pyspark

from tunetrail.plans.queries import GAP
from tunetrail.schema import (CORRELATED, DEFAULT_MOOD, GENRE_CONSOLIDATION, GENRE_PRIORITY, MOOD_FEATURES, MOOD_LABELS,
                              SCALED_AUDIO)

# ---- views ---------------------------------------------------------------------------

EVENT_PLAYS = """
event_plays AS (
  SELECT event_id AS play_id, user_id, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS track_id,
         CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END AS skipped,
         CASE WHEN event_type <> 'click' THEN event_type END AS reason_start,
         event_type AS reason_end
  FROM events),
timed AS (
  SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
         CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon'
              WHEN hour(ts) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END AS time_of_day
  FROM event_plays)"""

ORDER_PLAYS = """
order_plays AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS play_id, o_custkey AS user_id,
         l_shipdate AS ts, l_partkey AS track_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS skipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _unit(i):
    return f"least(greatest(0.5::DOUBLE + 2.0::DOUBLE * CAST(embedding[{i + 1}] AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


LIBRARY = f"""
library AS (
  SELECT p_partkey AS track_id, p_name AS track_name, p_brand AS artist,
         CASE p_partkey % 10 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN lower(p_type)
              ELSE concat('[''', lower(p_type), ''', ''', split_part(p_name, ' ', 1), ''', ''', split_part(p_name, ' ', 2), ''']') END AS genres,
         CASE p_partkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN '1' WHEN 3 THEN '0.0' END AS explicit,
         {_unit(0)} AS danceability, {_unit(1)} AS energy, {_unit(2)} AS valence, {_unit(3)} AS acousticness,
         {_unit(4)} AS liveness, {_unit(5)} AS instrumentalness, {_unit(6)} AS speechiness,
         CAST(p_size AS INTEGER) AS popularity, 60 + p_retailprice % 120 AS tempo, 0 - 60 * {_unit(7)} AS loudness,
         CAST(p_partkey % 12 AS INTEGER) AS key, CAST(p_partkey % 2 AS INTEGER) AS mode, CAST(3 + p_partkey % 3 AS INTEGER) AS time_signature
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""

FILES = """
files AS (
  SELECT * EXCLUDE (popularity, tempo), tempo, NULL::INTEGER AS popularity, 0 AS source_no FROM library WHERE popularity >= 20
  UNION ALL BY NAME
  SELECT * EXCLUDE (tempo), tempo + 1 AS tempo, 1 AS source_no FROM library),
unique_files AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY source_no) = 1)"""

LOOKUPS = """
brands AS (SELECT DISTINCT p_brand AS artist, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS number FROM part),
lookups AS (
  SELECT artist, CASE WHEN number <= 8 THEN '[''hip hop'', ''rap'']' END AS empty_genres, number = 9 AS ruled,
         CASE WHEN number BETWEEN 6 AND 14 THEN '[''latin pop'']' END AS null_genres,
         CASE WHEN number BETWEEN 10 AND 20 THEN '[''salsa'']' END AS late_genres
  FROM brands)"""

IMPUTED = """
  CASE WHEN trim(genres) = '[]' THEN coalesce(empty_genres,
            CASE WHEN ruled AND lower(track_name) = 'red widget' THEN '[''reggaeton'']' WHEN ruled THEN '[''r&b'']' END, genres)
       WHEN genres IS NULL THEN coalesce(null_genres,
            CASE WHEN p_size > 25 THEN '["o''pop", ''trap'']' END, late_genres)
       ELSE genres END"""

# Parses the list texts that occur in these tables.
TAGS = """CASE WHEN genres IS NULL THEN []::VARCHAR[] WHEN genres LIKE '[%'
          THEN list_transform(regexp_extract_all(genres, '''[^'']*''|"[^"]*"'), lambda g: g[2:-2]) ELSE [genres] END"""

CLEAN_ORDERS = f"""
clean_orders AS (SELECT o.*, l.* EXCLUDE (track_id), {TAGS} AS tags FROM order_plays o JOIN library l USING (track_id))"""

CLEAN_EVENTS = f"""
clean_events AS (SELECT e.*, l.* EXCLUDE (track_id), {TAGS} AS tags FROM timed e JOIN library l USING (track_id))"""

ENRICHED = """
enriched AS (
  SELECT o.*, CASE WHEN skipped = 1 THEN 'clickrow' END AS reason_start, f.* EXCLUDE (track_id), d.text AS lyrics, p.p_size
  FROM order_plays o LEFT JOIN unique_files f USING (track_id) LEFT JOIN documents d ON d.doc_id = track_id
  LEFT JOIN part p ON p.p_partkey = track_id)"""

IMPUTED_PLAYS = f"""
imputed AS (SELECT e.* EXCLUDE (genres), {IMPUTED} AS genres FROM enriched e LEFT JOIN lookups USING (artist))"""

SESSIONS = f"""
gaps AS (
  SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 60e6 AS diff_minutes FROM event_plays
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, play_id)),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN diff_minutes IS NULL OR diff_minutes > {GAP} THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, play_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gaps),
kept AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, session_no) AS session_plays FROM numbered) WHERE session_plays >= 3)"""

ROUGH = """
rough AS (
  SELECT * REPLACE (CASE WHEN play_id % 5 = 0 THEN 1 WHEN play_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
                    CASE WHEN play_id % 37 = 0 THEN NULL
                         WHEN play_id % 5 = 0 THEN TIMESTAMP '2024-01-10 10:00:00' + to_seconds((play_id * 7919) % 3600)
                         ELSE ts END AS ts) FROM event_plays)"""


def rough(gap):
    return SESSIONS.replace("FROM event_plays", "FROM rough WHERE ts IS NOT NULL").replace(f"> {GAP} ", f"> {gap} ")


WINDOWS = f"""
tagged AS (
  SELECT k.*, l.energy, l.valence, l.popularity, l.loudness, l.speechiness,
         CASE WHEN list_contains(t.tags, 'small') THEN 'Small' WHEN list_contains(t.tags, 'medium') THEN 'Medium'
              WHEN list_contains(t.tags, 'large') THEN 'Large' ELSE 'Other' END AS primary_genre
  FROM kept k JOIN library l USING (track_id) JOIN (SELECT track_id, {TAGS} AS tags FROM library) t USING (track_id)),
windows AS (
  SELECT play_id, user_id, ts, skipped AS target,
         list(energy) OVER w AS energies, list(valence) OVER w AS valences, list(popularity) OVER w AS popularities,
         list(loudness) OVER w AS loudnesses, list(speechiness) OVER w AS speechinesses,
         list(primary_genre) OVER w AS genres, count(*) OVER w AS n
  FROM tagged WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, play_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
full_windows AS (SELECT * FROM windows WHERE n = 5)"""

EVENT_SESSIONS = f"{EVENT_PLAYS}, {SESSIONS}"
EVENT_WINDOWS = f"{EVENT_SESSIONS}, {LIBRARY}, {WINDOWS}"


def with_(*parts):
    return "WITH " + ",".join(parts)


# ---- text ----------------------------------------------------------------------------

@lru_cache(maxsize=None)
def stop_list():
    """Language lists shipped in Spark's jar plus the extra words, lower-cased, unaccented, tokenised."""
    words = ["die", "der", "und", "les", "des", "une", "Été"]
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as archive:
        for language in ("english", "spanish"):
            words += archive.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split("\n")
    plain = ["".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)) for w in words]
    return sorted({t for w in plain for t in re.findall(r"\w{2,}", w)})


def tokens():
    stops = ", ".join(f"'{w}'" for w in stop_list())
    return f"""
raw_tokens AS (
  SELECT doc_id AS track_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM documents),
doc_tokens AS (SELECT track_id, list_filter(toks, lambda t: t NOT IN ({stops})) AS toks FROM raw_tokens),
tok AS (SELECT track_id, unnest(toks) AS token FROM doc_tokens),
tf AS (SELECT track_id, token, count(*) AS tf FROM tok GROUP BY ALL)"""


VOCAB = """
n AS (SELECT count(*) AS n FROM documents),
totals AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY token),
kept_words AS (SELECT token, df, total FROM totals, n WHERE df >= 2 AND df <= 0.7 * n ORDER BY total DESC, token LIMIT 100),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS position, df, total FROM kept_words)"""

TFIDF = """
raw AS (SELECT track_id, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN vocab USING (token), n),
weights AS (SELECT track_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY track_id)) AS weight FROM raw)"""

KEY_CHARS = "'[`'',\\-/.!]'"

PAGE_NAMES = """
names AS (
  SELECT p_partkey AS track_id, concat('The ', p_brand, ' & Añe$, Jr.') AS artist,
         concat(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' '),
                ' (', p_type, ' Édit) [Live] ', CASE WHEN p_size > 25 THEN 'feat. ' || p_brand ELSE '- Remastered' END) AS title
  FROM part)"""
ARTIST_KEY = f"""regexp_replace(replace(replace(regexp_replace(trim(lower(strip_accents(artist))), '^the ', ''), '$', 's'), ' ', ''), {KEY_CHARS}, '', 'g')"""
TITLE_KEY = f"""regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(title),
    '\\(([^)]*)\\)', ' \\1 ', 'g'), '\\[[^\\]]*\\]', '', 'g'), '(?i)\\b(feat\\.?|ft\\.?|featuring)\\b[^\\n]*', '', 'g'), '-[^\\n]*$', '')),
    {KEY_CHARS}, '', 'g'), '[#\\s]', '', 'g')"""

# ---- reports -------------------------------------------------------------------------


def wide(keys, source, n, cte):
    return f"""{with_(*cte)},
g AS (SELECT {keys}, CAST(count(*) FILTER (skipped = 1) AS BIGINT) AS "Skipped_Count", CAST(count(*) FILTER (skipped = 0) AS BIGINT) AS "Completed_Count" FROM {source} GROUP BY {keys}),
r AS (SELECT *, row_number() OVER (ORDER BY "Skipped_Count" DESC, {keys}) AS a, row_number() OVER (ORDER BY "Completed_Count" DESC, {keys}) AS b FROM g)
SELECT {keys}, "Skipped_Count", "Completed_Count" FROM r WHERE (a <= {n} AND "Skipped_Count" > 0) OR (b <= {n} AND "Completed_Count" > 0)"""


def correlation(listwise):
    source = "correlated"
    if listwise:
        source = "(SELECT * FROM correlated WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CORRELATED) + ")"
    cells = []
    for a in CORRELATED:
        for b in CORRELATED:
            value = f"CASE WHEN max({a}) > min({a}) THEN 1.0::DOUBLE END" if a == b else f"round(corr({a}, {b}), 2) + 0"
            cells.append(f"SELECT '{a}' AS \"Variable1\", '{b}' AS \"Variable2\", {value} AS \"Correlation\" FROM data")
    return f"""{with_(ORDER_PLAYS, LIBRARY, FILES)},
correlated AS (SELECT o.skipped, f.* FROM order_plays o JOIN unique_files f USING (track_id)),
data AS MATERIALIZED (SELECT * FROM {source})
""" + "\nUNION ALL ".join(cells)


def priority_case(tags, priority):
    return "CASE " + " ".join(f"WHEN list_contains({tags}, '{g}') THEN '{g.title()}'" for g in priority) + " ELSE 'Other' END"


def merged(c):
    return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in GENRE_CONSOLIDATION.items()) + f" ELSE {c} END"


def vibe():
    labels = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in MOOD_LABELS)
    bins = "(VALUES ('Low', 1::DOUBLE / 6), ('Mid', 0.5::DOUBLE), ('High', 5::DOUBLE / 6)) AS"
    names = [f"{f}_bin" for f in MOOD_FEATURES]
    square = lambda f, t: f"({f} - {t}.x) * ({f} - {t}.x)"
    return f"""{with_(ORDER_PLAYS, LIBRARY, CLEAN_ORDERS)},
counts AS (SELECT track_name, artist, count(*) AS play_count FROM clean_orders GROUP BY ALL),
firsts AS (SELECT * FROM clean_orders QUALIFY row_number() OVER (PARTITION BY track_name, artist ORDER BY ts, play_id) = 1),
eligible AS (SELECT f.*, c.play_count FROM firsts f JOIN counts c USING (track_name, artist)
             WHERE c.play_count > (SELECT quantile_cont(play_count, 0.25) FROM counts)),
labels({", ".join(names)}, vibe_label) AS (VALUES {labels}),
scored AS (
  SELECT d.name AS {names[0]}, e.name AS {names[1]}, v.name AS {names[2]}, a.name AS {names[3]}, t.*,
         sqrt({square('danceability', 'd')} + {square('energy', 'e')} + {square('valence', 'v')} + {square('acousticness', 'a')}) AS dist
  FROM eligible t, {bins} d(name, x), {bins} e(name, x), {bins} v(name, x), {bins} a(name, x)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {", ".join(names)} ORDER BY dist, track_name, artist) AS INTEGER) AS rank FROM scored)
SELECT {", ".join(names)}, coalesce(vibe_label, '{DEFAULT_MOOD}') AS vibe_label, rank, track_name, artist,
       {priority_case('tags', ['small', 'promo', 'ring'])} AS genre, play_count,
       {", ".join(f"round({f}, 3) AS {f}" for f in MOOD_FEATURES)}, round(dist, 4) AS distance
FROM ranked LEFT JOIN labels USING ({", ".join(names)}) WHERE rank <= 5"""


def report(prediction):
    """Cells of a binary report on `scored`, as one row r."""
    return f"""
cells AS (SELECT count(*) FILTER (skipped = 0 AND {prediction} = 0)::DOUBLE AS a, count(*) FILTER (skipped = 0 AND {prediction} = 1)::DOUBLE AS b,
                 count(*) FILTER (skipped = 1 AND {prediction} = 0)::DOUBLE AS c, count(*) FILTER (skipped = 1 AND {prediction} = 1)::DOUBLE AS d FROM scored),
r AS (SELECT *, a / (a + c) AS p0, a / (a + b) AS r0, d / (b + d) AS p1, d / (c + d) AS r1, a + b AS s0, c + d AS s1, (a + d) / (a + b + c + d) AS acc FROM cells),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM r)"""


SCORED = """
scored AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction, CASE WHEN popularity > 25 THEN 1 ELSE 0 END AS other
           FROM (SELECT *, round(0.6::DOUBLE * energy + 0.4::DOUBLE * (1 - valence), 3) AS score FROM clean_orders))"""

CLOCK = """concat(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END, CASE WHEN hour < 12 THEN ':00 AM' ELSE ':00 PM' END)"""
CONTEXT = """CASE WHEN hour BETWEEN 6 AND 9 THEN 'Morning Commute' WHEN hour BETWEEN 10 AND 11 THEN 'Late Morning'
     WHEN hour BETWEEN 12 AND 13 THEN 'Lunch' WHEN hour BETWEEN 14 AND 17 THEN 'Afternoon' WHEN hour BETWEEN 18 AND 21 THEN 'Evening'
     WHEN hour BETWEEN 22 AND 23 THEN 'Night' ELSE 'Late Night' END"""
DAY = "['Mon', 'Tues', 'Wed', 'Thurs', 'Fri', 'Sat', 'Sun'][day_of_week + 1]"
HOURLY = f"""
hourly AS (SELECT CAST(hour AS INTEGER) AS hour, count(skipped) AS total_plays, CAST(sum(skipped) AS BIGINT) AS total_skips,
                  round(sum(skipped) / count(skipped) * 100, 2) AS skip_rate, {CLOCK} AS time_label, {CONTEXT} AS context
           FROM timed GROUP BY hour)"""

BIN = "CASE WHEN {0} >= 0 AND {0} <= 1::DOUBLE / 3 THEN 'Low' WHEN {0} > 1::DOUBLE / 3 AND {0} <= 2::DOUBLE / 3 THEN 'Mid' WHEN {0} > 2::DOUBLE / 3 AND {0} <= 1 THEN 'High' END"

SESSION_ROWS = f"""{with_(EVENT_SESSIONS)}
SELECT play_id, user_id, session_no, session_plays, round(diff_minutes, 4) AS diff_minutes FROM kept"""

WINDOW_ROWS = f"""{with_(EVENT_WINDOWS)}
SELECT play_id, user_id, target,
       array_to_string(list_transform(energies, lambda e: CAST(CAST(round(e, 4) AS DECIMAL(12,4)) AS VARCHAR)), '|') AS energy,
       array_to_string(list_transform(popularities, lambda e: CAST(e AS VARCHAR)), '|') AS popularity
FROM full_windows"""


def named_orders():
    return f"{ORDER_PLAYS}, named AS (SELECT o.*, p_name AS track_name, p_brand AS artist, 'track:' || track_id AS track_uri FROM order_plays o JOIN part ON p_partkey = track_id)"


def explain(**features):
    cells = []
    for f, col in features.items():
        cells.append(f"""SELECT play_id, 't-' || (6 - i) AS step, genres[i] AS genre, '{f}' AS feature, round(CAST({col}[i] AS DOUBLE), 4) AS value,
            round(CASE WHEN list_max({col}) = list_min({col}) THEN 0.5 ELSE ({col}[i] - list_min({col})) / CAST(list_max({col}) - list_min({col}) AS DOUBLE) END, 4) AS intensity
            FROM full_windows, range(1, 6) AS s(i)""")
    return f"{with_(EVENT_WINDOWS)} " + " UNION ALL ".join(cells)


def metric_rows(model, prediction):
    return f"""SELECT '{model}' AS model, m.metric, m.value FROM (
        {with_(report(prediction))} SELECT unnest(['Accuracy', 'Recall', 'Precision', 'F1']) AS metric,
        unnest([round(acc, 6), round(r1, 6), round(p1, 6), round(f1, 6)]) AS value FROM f) m"""


def page_text():
    tags = "div|p|article|section|td|li|main|body"
    return f"""WITH bodies AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<nav\\b.*?</nav>', '', 'g') AS body FROM pages),
parts AS (SELECT page_id, string_split_regex(body, '(?i)</?(?:{tags})\\b[^>]*>') AS blocks FROM bodies),
blocks AS (SELECT page_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS i FROM parts),
counted AS (SELECT *, len(regexp_extract_all(block, '(?i)<br\\b')) AS n_br FROM blocks),
best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n_br DESC, i) = 1),
texts AS (SELECT page_id, n_br, regexp_replace(regexp_replace(block, '(?i)<br\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM best)
SELECT page_id, CAST(n_br AS INTEGER) AS n_br,
       CASE WHEN n_br > 0 THEN nullif(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
            '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '') END AS lyrics FROM texts"""


def window_vectors(with_lyrics):
    """Flattened windows: flags, scaled audio, time parts, top genres, then three numbers of the lyrics."""
    z = lambda c: f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END"
    audio = ["danceability", "energy", "valence", "acousticness", "liveness", "instrumentalness", "speechiness", "popularity",
             "tempo", "loudness"]
    parts = [f"CASE WHEN time_of_day = '{v}' THEN 1 ELSE 0 END" for v in ("Evening", "Morning", "Night")]
    numbers = ["CASE WHEN lower(explicit) IN ('true', '1', '1.0') THEN 1 ELSE 0 END", *map(z, audio), "key", "mode",
               "time_signature", "hour", "day_of_week", "month", "is_weekend", *parts]
    cells = "[" + ", ".join(f"CAST({n} AS DOUBLE)" for n in numbers) + "]"
    texts, join = "", ""
    if with_lyrics:
        texts = " || [CAST(length(text) % 7 AS DOUBLE), CAST(length(text) % 11 AS DOUBLE), CAST(length(text) % 13 AS DOUBLE)]"
        join = " JOIN documents ON doc_id = track_id"
    return f"""{with_(EVENT_PLAYS, LIBRARY, CLEAN_EVENTS)},
        c AS (SELECT genre, count(*) AS n FROM (SELECT unnest(tags) AS genre FROM clean_events) GROUP BY genre),
        top AS (SELECT list(genre ORDER BY n DESC, genre) AS names FROM (SELECT * FROM c ORDER BY n DESC, genre LIMIT 20)),
        vectored AS (SELECT play_id, track_id, user_id, ts, skipped, {cells}
                     || list_transform(names, lambda g: CASE WHEN list_contains(tags, g) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v
                     FROM clean_events, top),
        plays AS (SELECT n.play_id, n.user_id, n.ts, n.skipped, v{texts} AS v FROM vectored n{join}),
        {SESSIONS.replace("FROM event_plays", "FROM plays").strip()},
        w AS (SELECT play_id, skipped AS target, flatten(list(v) OVER w) AS v, count(*) OVER w AS n FROM kept
              WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, play_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT play_id, target, CAST(len(v) AS INTEGER) AS n_values,
               md5(array_to_string(list_transform(v, lambda x: CAST(CAST(round(x, 3) AS DECIMAL(12,3)) AS VARCHAR)), '|')) AS vector_md5
        FROM w WHERE n = 5"""


def exported():
    """The count tables of the export as one long table."""
    lists = {"artists": ("artist", "NULL", "clean_events"), "songs": ("track_name", "artist", "clean_events"),
             "genres": ("genre", "NULL", "(SELECT skipped, unnest(tags) AS genre FROM clean_events WHERE genres LIKE '[%')")}
    stats = "".join(f""",
        {name}_all AS (SELECT {first} AS first, CAST({second} AS VARCHAR) AS second, count(*) FILTER (skipped = 1) AS s, count(*) FILTER (skipped = 0) AS c
                       FROM {source} WHERE {first} IS NOT NULL GROUP BY ALL),
        {name} AS ((SELECT * FROM {name}_all WHERE s > 0 ORDER BY s DESC, first, second LIMIT 10) UNION
                   (SELECT * FROM {name}_all WHERE c > 0 ORDER BY c DESC, first, second LIMIT 10))"""
                    for name, (first, second, source) in lists.items())
    union = "".join(f" UNION ALL SELECT 'top_lists/{name}', first, second, s, c FROM {name}" for name in lists)
    return f"""{with_(EVENT_PLAYS, LIBRARY, CLEAN_EVENTS)}{stats},
        long(name, first, second, skips, plays) AS (
          SELECT 'skip_heatmap', {DAY}, CAST(hour AS VARCHAR), sum(skipped), count(*) FROM clean_events GROUP BY day_of_week, hour UNION ALL
          SELECT 'hourly_skip', {CLOCK}, CAST(hour AS VARCHAR), sum(skipped), count(*) FROM clean_events GROUP BY hour UNION ALL
          SELECT 'kpis', 'Total Songs', NULL, count(*), NULL FROM clean_events UNION ALL
          SELECT 'kpis', 'Total Skips', NULL, sum(skipped), NULL FROM clean_events UNION ALL
          SELECT 'kpis', 'Skip Rate', NULL, round(sum(skipped) / count(*), 4), NULL FROM clean_events{union})
        SELECT name, first, second, CAST(skips AS DOUBLE) AS skips, CAST(plays AS DOUBLE) AS plays,
               count(*) OVER (PARTITION BY name) AS rows_written FROM long"""


@lru_cache(maxsize=None)
def oracles():
    sql = {}
    sql["time_features"] = f"""{with_(EVENT_PLAYS)} SELECT play_id, CAST(hour AS INTEGER) AS hour, CAST(day_of_week AS INTEGER) AS day_of_week,
        CAST(month AS INTEGER) AS month, is_weekend, time_of_day, {DAY} AS day_label, {CLOCK} AS clock_label, {CONTEXT} AS context_label FROM timed"""
    sql["skip_heatmap"] = f"""{with_(EVENT_PLAYS)} SELECT CAST(day_of_week AS INTEGER) AS day_of_week, CAST(hour AS INTEGER) AS hour,
        CAST(sum(skipped) AS BIGINT) AS total_skips, count(*) AS total_plays, round(sum(skipped) / count(*), 4) AS skip_rate, {DAY} AS day_label
        FROM timed GROUP BY day_of_week, hour"""
    sql["hourly_skip"] = f"{with_(EVENT_PLAYS, HOURLY)} SELECT * FROM hourly"
    sql["hour_extremes"] = f"""{with_(EVENT_PLAYS, HOURLY)}
        (SELECT 'most impatient' AS kind, * FROM hourly ORDER BY skip_rate DESC, hour LIMIT 1) UNION ALL
        (SELECT 'most chill' AS kind, * FROM hourly ORDER BY skip_rate, hour LIMIT 1)"""
    sql["kpi_summary"] = f"""{with_(ORDER_PLAYS)} SELECT 'Total Songs' AS "Metric", CAST(count(*) AS DOUBLE) AS "Value" FROM order_plays UNION ALL
        SELECT 'Total Skips', CAST(sum(skipped) AS DOUBLE) FROM order_plays UNION ALL
        SELECT 'Skip Rate', round(sum(skipped) / count(*), 4) FROM order_plays"""
    sql["class_distribution"] = f"""{with_(ORDER_PLAYS)} SELECT skipped, count(*) AS plays,
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM order_plays), 4) AS percent,
        round((SELECT count(*) FILTER (skipped = 0) / count(*) FILTER (skipped = 1) FROM order_plays), 4) AS listen_skip_ratio
        FROM order_plays GROUP BY skipped"""
    sql["tod_skip_delta"] = f"""{with_(EVENT_PLAYS)}, overall AS (SELECT avg(skipped) * 100 AS o FROM timed),
        parts(position, time_of_day) AS (VALUES (0, 'Morning'), (1, 'Afternoon'), (2, 'Evening'), (3, 'Night')),
        rates AS (SELECT time_of_day, avg(skipped) * 100 AS r, count(*) AS n FROM timed GROUP BY time_of_day)
        SELECT position, time_of_day, round(r, 4) AS skip_rate, coalesce(n, 0) AS plays, round(abs(r - o), 4) AS difference,
               CASE WHEN r - o > 0 THEN 'up' WHEN r - o <= 0 THEN 'down' END AS direction
        FROM parts LEFT JOIN rates USING (time_of_day), overall"""

    file_columns = "track_id, source_no, round(tempo, 4) AS tempo, popularity, genres"
    sql["library_union"] = f"{with_(LIBRARY, FILES)} SELECT {file_columns} FROM files"
    sql["library_dedupe"] = f"{with_(LIBRARY, FILES)} SELECT {file_columns} FROM unique_files"
    sql["duplicate_counts"] = f"""{with_(LIBRARY, FILES)} SELECT count(*) AS rows, count(DISTINCT track_id) AS keys,
        count(*) - count(DISTINCT track_id) AS duplicates FROM files"""
    sql["distinct_genre_texts"] = f"{with_(LIBRARY)} SELECT DISTINCT genres FROM library"
    worklist = "SELECT DISTINCT track_uri, artist, track_name FROM named"
    sql["enrichment_batch"] = f"{with_(named_orders())} {worklist} WHERE track_id NOT IN (SELECT doc_id FROM documents)"
    sql["enrichment_top"] = f"{with_(named_orders())} {worklist} ORDER BY track_uri LIMIT 100 OFFSET 50"
    sql["first_plays"] = f"""{with_(ORDER_PLAYS)} SELECT * FROM order_plays
        QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ts, play_id) = 1"""
    full = [ORDER_PLAYS, LIBRARY, FILES, LOOKUPS, ENRICHED, IMPUTED_PLAYS]
    sql["clean_plays"] = f"""{with_(*full)} SELECT play_id, user_id, track_id, track_name, artist, genres, coalesce(explicit, 'unknown') AS explicit,
        coalesce(reason_start, 'unknown') AS reason_start, 'unknown' AS reason_end, skipped, popularity, round(tempo, 4 + 2) AS tempo,
        round(loudness, 6) AS loudness, round(energy, 6) AS energy, md5(lyrics) AS lyrics_md5
        FROM imputed WHERE genres IS NOT NULL AND popularity IS NOT NULL AND lyrics IS NOT NULL"""
    sql["conformed_plays"] = f"""{with_(EVENT_PLAYS)} SELECT CAST(play_id AS VARCHAR) AS play_id,
        CASE WHEN play_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS user_id,
        CASE WHEN play_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CAST(track_id AS VARCHAR) AS track_id,
        'uri:' || track_id AS track_uri, 'Track ' || track_id AS track_name, 'Someone' AS artist,
        CASE WHEN play_id % 3 = 2 THEN 1 ELSE skipped END AS skipped,
        CASE WHEN play_id % 7 <> 0 THEN play_id * 10 END AS ms_played, NULL::VARCHAR AS platform FROM event_plays"""
    sql["conformed_library"] = f"""{with_(LIBRARY)} SELECT CAST(track_id AS VARCHAR) AS track_id,
        CASE WHEN track_id % 9 <> 0 THEN round(tempo, 4) END AS tempo, popularity, genres, explicit,
        CASE WHEN track_id % 4 <> 0 THEN key END AS key FROM library"""
    sql["genre_imputation"] = f"""{with_(LIBRARY, LOOKUPS)} SELECT track_id, artist, track_name, {IMPUTED} AS genres
        FROM library LEFT JOIN lookups USING (artist) JOIN part ON p_partkey = track_id"""
    sql["impute_candidate_tracks"] = f"""{with_(*full)} SELECT 'track:' || track_id AS track_uri, play_id, artist, track_name
        FROM enriched WHERE genres IS NULL AND popularity IS NOT NULL AND lyrics IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY ts, play_id) = 1"""
    sql["null_fill"] = f"{with_(EVENT_PLAYS)} SELECT play_id, coalesce(reason_start, 'unknown') AS reason_start, reason_end FROM event_plays"
    sql["explicit_normalise"] = f"""{with_(LIBRARY)} SELECT track_id, CASE WHEN lower(explicit) IN ('true', '1', '1.0') THEN 1 ELSE 0 END AS explicit,
        CASE WHEN loudness > -30 THEN 1 ELSE 0 END AS loud, TRY_CAST(explicit AS DOUBLE) AS explicit_number FROM library"""
    sql["remapped_reasons"] = f"""{with_(EVENT_PLAYS)} SELECT play_id, CASE WHEN reason_end IN ('view', 'error') THEN 'skip:' || reason_end ELSE reason_end END AS reason,
        CASE WHEN reason_end IN ('view', 'error') THEN 'skip:' || reason_end END AS known FROM event_plays"""

    sql["genre_parse"] = f"""{with_(LIBRARY)}, p AS (SELECT track_id, genres, {TAGS} AS tags FROM library)
        SELECT track_id, array_to_string(tags, '|') AS single, CASE WHEN genres LIKE '[%' THEN array_to_string(tags, '|') ELSE '' END AS empty,
        CAST(len(tags) AS INTEGER) AS n FROM p"""
    orders = [ORDER_PLAYS, LIBRARY, CLEAN_ORDERS]
    sql["genre_top20"] = f"""{with_(*orders)}, x AS (SELECT unnest(tags) AS genre FROM clean_orders)
        SELECT genre, count(*) AS n FROM x GROUP BY genre ORDER BY n DESC, genre LIMIT 20"""
    sql["genre_share_top10"] = f"""{with_(*orders)}, x AS (SELECT skipped, unnest(tags) AS genre FROM clean_orders),
        c AS (SELECT skipped, genre, count(*) AS plays FROM x GROUP BY ALL)
        SELECT skipped, CAST(row_number() OVER w AS INTEGER) AS position, genre, plays, round(plays / sum(plays) OVER (PARTITION BY skipped) * 100, 1) AS percent
        FROM c WINDOW w AS (PARTITION BY skipped ORDER BY plays DESC, genre) QUALIFY position <= 10"""
    dominant = f"""{with_(*full)}, d AS (SELECT play_id, {priority_case(TAGS, GENRE_PRIORITY)} AS dominant_genre FROM imputed)"""
    sql["dominant_genres"] = f"{dominant} SELECT play_id, dominant_genre, {merged('dominant_genre')} AS merged_genre FROM d"
    sql["dominant_genre_report"] = f"""{dominant}, m AS MATERIALIZED (SELECT {merged('dominant_genre')} AS dominant_genre FROM d)
        SELECT dominant_genre, count(*) AS plays, (SELECT count(DISTINCT dominant_genre) FROM m) AS categories,
        (SELECT count(*) FROM m WHERE dominant_genre = 'Other') AS default_plays FROM m GROUP BY dominant_genre"""
    sql["wide_artists"] = wide("artist", "clean_orders", 10, orders)
    sql["wide_songs"] = wide("track_name, artist", "clean_orders", 10, orders)
    sql["wide_genres"] = wide("genre", "(SELECT skipped, unnest(tags) AS genre FROM clean_orders)", 10, orders)

    sql["wide_listener_tracks"] = wide("user_id, track_id", "order_plays", 10, [ORDER_PLAYS])
    sql["frequent_tracks"] = """SELECT l_partkey AS track_id, count(*) AS n FROM lineitem
        GROUP BY l_partkey ORDER BY n DESC, track_id LIMIT 50"""
    sql["word_effects"] = """SELECT CAST(l_partkey AS VARCHAR) AS word, abs(c) AS importance, c AS coefficient,
        CASE WHEN c > 0 THEN 'skip' ELSE 'listen' END AS category
        FROM (SELECT l_partkey, CAST(4 * count(*) FILTER (l_returnflag = 'R') - count(*) AS DOUBLE) AS c FROM lineitem GROUP BY l_partkey)
        WHERE c <> 0"""
    sql["export_tables"] = exported()

    sql["sessions"] = sql["heavy_listener_sessions"] = SESSION_ROWS
    sql["rough_sessions"] = sql["rough_heavy_sessions"] = f"""{with_(EVENT_PLAYS, ROUGH, rough(20))}
        SELECT play_id, user_id, session_no, session_plays, round(diff_minutes, 4) AS diff_minutes FROM kept"""
    sql["rough_windows"] = f"""{with_(EVENT_PLAYS, ROUGH, rough(20))}, w AS (
        SELECT play_id, user_id, skipped AS target, list(track_id) OVER w AS tracks, count(*) OVER w AS n FROM kept
        WINDOW w AS (PARTITION BY user_id, session_no ORDER BY ts, play_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
        SELECT play_id, user_id, target, array_to_string(tracks, '|') AS tracks FROM w WHERE n = 5"""
    sql["session_summary"] = f"""{with_(EVENT_SESSIONS)} SELECT (SELECT count(*) FROM event_plays) AS rows_before, count(*) AS rows_kept,
        count(DISTINCT (user_id, session_no)) AS sessions FROM kept"""
    sql["seq_windows"] = sql["heavy_listener_windows"] = WINDOW_ROWS
    sql["seq_genres"] = f"{with_(EVENT_WINDOWS)} SELECT play_id, array_to_string(genres, '|') AS genres FROM full_windows"
    sql["chronological_split"] = f"""{with_(EVENT_WINDOWS)} SELECT play_id, target,
        CASE WHEN row_number() OVER (ORDER BY ts, play_id) <= floor((SELECT count(*) FROM full_windows) * 0.8) THEN 'train' ELSE 'test' END AS split FROM full_windows"""
    sql["window_explain"] = explain(energy="energies", valence="valences", popularity="popularities")
    sql["window_explain_moods"] = explain(popularity="popularities", loudness="loudnesses", speechiness="speechinesses", valence="valences")
    sql["window_vectors"] = window_vectors(False)
    sql["window_vectors_with_lyrics"] = window_vectors(True)

    sql["artist_keys"] = f"{with_(PAGE_NAMES)} SELECT track_id, {ARTIST_KEY} AS artist_key FROM names"
    sql["title_keys"] = f"""{with_(PAGE_NAMES)} SELECT track_id, {TITLE_KEY} AS title_key,
        array_to_string(list_transform(regexp_extract_all(title, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title_case FROM names"""
    sql["page_urls"] = f"""{with_(PAGE_NAMES)} SELECT track_id, concat('https://lyrics.example/', {ARTIST_KEY}, '/', {TITLE_KEY}, '.html') AS url FROM names"""
    sql["plain_lyrics"] = "SELECT doc_id AS track_id, strip_accents(text) AS plain FROM documents"
    sql["repaired_lyrics"] = "SELECT doc_id AS track_id, md5(text) AS repaired, md5(text) AS untouched FROM documents"
    sql["repaired_escapes"] = r"""SELECT doc_id AS track_id, md5(coalesce(CASE WHEN doc_id % 7 <> 0 THEN
        regexp_replace(replace(text, ' ', '\n') || '_X000d_\r', '_x000d_|\\n|\\r', ' ', 'gi') END, '')) AS repaired FROM documents"""
    sql["page_lyrics"] = page_text()
    sql["page_content_lyrics"] = """SELECT page_id, CASE WHEN page_id % 2 = 0
        THEN concat_ws(chr(10), page_id, 'line', 'in', 'deep', 'tail') ELSE page_id || 'aboldz' END AS lyrics FROM pages"""
    entities = lambda t: f"replace(replace(replace(replace({t}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    sql["page_lyrics_plain_first"] = f"""WITH blocks AS ({page_text()}),
        bodies AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
            '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<nav\\b.*?</nav>', '', 'g') AS body FROM pages),
        plain AS (SELECT page_id, list_filter(regexp_extract_all(body, '(?is)<div\\b[^>]*>.*?</div>'),
            lambda d: NOT regexp_matches(d, '(?i)^<div\\b[^>]*\\bclass\\s*=')) AS divs FROM bodies)
        SELECT page_id, md5(coalesce(regexp_replace({entities("regexp_replace(divs[2], '(<[^>]*>)+', chr(10), 'g')")},
            '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), lyrics)) AS lyrics_md5 FROM plain JOIN blocks USING (page_id)"""
    sql["tokens_clean"] = f"{with_(tokens())} SELECT track_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM doc_tokens"
    sql["vocab_top100"] = f"{with_(tokens(), VOCAB)} SELECT * FROM vocab"
    sql["played_vocab_top100"] = f"""{with_(tokens(), ORDER_PLAYS)},
        played AS (SELECT track_id, count(*) AS plays FROM order_plays JOIN documents ON doc_id = track_id GROUP BY track_id),
        n AS (SELECT sum(plays) AS n FROM played),
        totals AS (SELECT token, CAST(sum(plays) AS BIGINT) AS df, CAST(sum(tf * plays) AS BIGINT) AS total FROM tf JOIN played USING (track_id) GROUP BY token),
        kept_words AS (SELECT token, df, total FROM totals, n WHERE df >= 2 AND df <= 0.7 * n ORDER BY total DESC, token LIMIT 100)
        SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS position, df, total FROM kept_words"""
    sql["lyrics_tfidf"] = sql["tfidf_vectors"] = f"{with_(tokens(), VOCAB, TFIDF)} SELECT track_id, token, round(weight, 6) AS weight FROM weights"
    sql["token_weight_top50"] = f"""{with_(tokens(), VOCAB, TFIDF)}, s AS (SELECT token, sum(weight) AS weight FROM weights GROUP BY token)
        SELECT token, round(weight, 4) AS weight FROM s ORDER BY s.weight DESC, token LIMIT 50"""

    sql["correlations"] = correlation(False)
    sql["correlations_listwise"] = correlation(True)
    sql["play_count_filter"] = f"""{with_(*orders)}, c AS (SELECT track_name, artist, count(*) AS play_count FROM clean_orders GROUP BY ALL)
        SELECT * FROM c WHERE play_count > (SELECT quantile_cont(play_count, 0.25) FROM c)"""
    sql["feature_bins"] = f"{with_(LIBRARY)} SELECT track_id, " + ", ".join(f"{BIN.format(f)} AS {f}_bin" for f in MOOD_FEATURES) + " FROM library"
    sql["vibe_top5"] = vibe()

    scaled = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED_AUDIO)
    sql["zscores"] = f"{with_(LIBRARY)} SELECT track_id, {scaled}, 0.0::DOUBLE AS constant FROM library"
    sql["tod_dummies"] = f"{with_(EVENT_PLAYS)} SELECT play_id, " + ", ".join(
        f"CASE WHEN time_of_day = '{v}' THEN 1 ELSE 0 END AS \"time_of_day_{v}\"" for v in ("Evening", "Morning", "Night")) + " FROM timed"
    sql["label_codes"] = f"""{with_(EVENT_PLAYS)} SELECT play_id, CASE WHEN reason_start IS NOT NULL THEN
        CAST(dense_rank() OVER (ORDER BY reason_start NULLS LAST) - 1 AS INTEGER) END AS reason_start_encoded FROM event_plays"""
    sql["strat_split"] = f"""{with_(ORDER_PLAYS)} SELECT play_id, skipped,
        CASE WHEN row_number() OVER (PARTITION BY skipped ORDER BY md5('42:' || play_id), play_id)
             <= floor(0.8 * count(*) OVER (PARTITION BY skipped)) THEN 'train' ELSE 'test' END AS split FROM order_plays"""
    sql["class_weights"] = f"""{with_(ORDER_PLAYS)}, t AS (SELECT count(*) AS n, sum(skipped) AS pos FROM order_plays)
        SELECT skipped, round(n / (2.0::DOUBLE * count(*)), 6) AS balanced,
               round(CASE WHEN skipped = 1 THEN (n - pos) / pos ELSE 1.0::DOUBLE END, 6) AS positive FROM order_plays, t GROUP BY skipped, n, pos"""
    sql["class_ratio"] = f"{with_(ORDER_PLAYS)} SELECT round(sum(1 - skipped) / sum(skipped), 6) AS ratio FROM order_plays"
    sql["eval_report"] = f"""{with_(*orders, SCORED, report('prediction'))}
        SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f UNION ALL
        SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f UNION ALL
        SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(s0 + s1 AS BIGINT) FROM f UNION ALL
        SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(s0 + s1 AS BIGINT) FROM f UNION ALL
        SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6),
               round((f0 * s0 + f1 * s1) / (s0 + s1), 6), CAST(s0 + s1 AS BIGINT) FROM f"""
    sql["roc_auc"] = f"""{with_(*orders, SCORED)},
        ranks AS (SELECT skipped, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored)
        SELECT round((sum(rk) FILTER (skipped = 1) - count(*) FILTER (skipped = 1) * (count(*) FILTER (skipped = 1) + 1) / 2)
               / (count(*) FILTER (skipped = 1)::DOUBLE * count(*) FILTER (skipped = 0)), 6) AS auc FROM ranks"""
    sql["scoreboard"] = f"{with_(*orders, SCORED)} " + metric_rows("mood rule", "prediction") + " UNION ALL " + metric_rows("popularity rule", "other")
    sql["genre_onehot"] = f"""{with_(EVENT_PLAYS, LIBRARY, CLEAN_EVENTS)},
        c AS (SELECT genre, count(*) AS n FROM (SELECT unnest(tags) AS genre FROM clean_events) GROUP BY genre)
        SELECT play_id, 'genre_' || replace(genre, ' ', '_') AS "column", CASE WHEN list_contains(tags, genre) THEN 1 ELSE 0 END AS flag
        FROM clean_events, (SELECT genre FROM c ORDER BY n DESC, genre LIMIT 20)"""
    return sql
