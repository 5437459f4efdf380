"""One named query per corpus operator, on its whole table, and the SQL of those that SQL can express."""

from pyspark.sql import functions as F

from tunetrail.llm import (ball_tree, block_anchors, circulant, edit_match, grace, line_crf, periodic, raking,
                           simhash, suffix_groups, toxicity, transcripts, warc)
from tunetrail.llm.shared import scratch_folder, stored


def _table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents", "doc_id", "text")


def op1_simhash(spark, sf_dir):
    return simhash.simhash_groups(_texts(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_line_crf(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    model = line_crf.train_quality(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return line_crf.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_raking(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return raking.mix_to_targets(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability",
                                              "sampled")


def op4_transcripts(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    lines = transcripts.as_transcripts(turns)
    model = transcripts.fit_roles(lines.where(transcripts.fold_of("conv_id") != 0))
    found = transcripts.format_chats(lines, model)
    return found.select("conv_id", "block", (transcripts.fold_of("conv_id") == 0).alias("held_out"), "n_lines",
                        F.size("roles").alias("n_turns"), "line_roles", "roles", "rendered")


def op5_toxicity(spark, sf_dir):
    docs = _texts(spark, sf_dir)
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_block_anchors(spark, sf_dir):
    found = block_anchors.drop_repeats(_texts(spark, sf_dir))
    return found.select("doc_id", "n_words", block_anchors.removed_length("removed").alias("n_removed"),
                        F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_grace(spark, sf_dir):
    return grace.exact_groups(_texts(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark, sf_dir):
    path = f"{scratch_folder(spark)}/archives"
    warc.write_warc(_table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    records = stored(warc.read_warc(spark, path, keep_payload=False), "records")
    return warc.resolve_revisits(warc.transactions(records)).select("page_id", "payload_bytes", "payload_digest",
                                                                    "record_type", "refers_to")


def op9_suffix_groups(spark, sf_dir):
    found = suffix_groups.drop_substrings(_texts(spark, sf_dir))
    return found.select("doc_id", "n_bytes", block_anchors.removed_length("removed").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_edit_match(spark, sf_dir):
    found = edit_match.match_items(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op11_circulant(spark, sf_dir):
    return circulant.minhash_groups(_texts(spark, sf_dir))


def op12_ball_tree(spark, sf_dir):
    return ball_tree.best_documents(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def planted_periods(docs):
    """Texts (doc_id, text) where a tenth of the documents get a periodic tail, as the contract of op13 has it."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    chosen = docs.withColumn("h", code).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn(
        "n", F.size("words"))
    start = F.when(F.col("n") > 0, g % F.col("n"))
    chosen = chosen.withColumn("a", start).withColumn(
        "p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)))
    changed = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", changed)).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark, sf_dir):
    found = periodic.periodic_runs(planted_periods(_texts(spark, sf_dir)))
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
                    lambda a, b: F.when(a.isNull() | (b["length"] > a["length"]), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_line_crf, op3_raking, op4_transcripts, op5_toxicity, op6_block_anchors, op7_grace, op8_warc,
    op9_suffix_groups, op10_edit_match, op11_circulant, op12_ball_tree, op13_periodic)}

ORACLES = {
    "op6_block_anchors": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, range(1, len(w) - 48) t(i)),
             least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
             gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (h), range(50) r(k) WHERE m < doc_id),
             word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
             kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
             lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_suffix_groups": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
             n AS (SELECT doc_id, b, length(b) // 2 AS n FROM d),
             win AS (SELECT doc_id, i, md5(substr(b, 2 * i + 1, 800)) AS h FROM n, range(0, n - 399) t(i)),
             twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
             hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (h)),
             run AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
             span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY doc_id, r),
             piece AS (SELECT doc_id, a, z, coalesce(lag(z) OVER w, 0) AS from_byte FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
             head AS (SELECT doc_id, string_agg(substr(b, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) AS t,
                             max(z) AS last_byte, count(*) AS spans, sum(z - a) AS lost
                      FROM piece JOIN n USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(coalesce(t, '') || substr(b, 2 * coalesce(last_byte, 0) + 1))) AS kept_sha256
        FROM n LEFT JOIN head USING (doc_id)""",
    "op11_circulant": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x20\x09-\x0D]+') AS w FROM documents),
             shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
                         FROM d, range(1, greatest(len(w) - 4, least(len(w), 1)) + 1) t(i)),
             size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
             common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b USING (h)
                        WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             link AS (SELECT u, v FROM common JOIN size a ON a.doc_id = u JOIN size b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
             reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, v FROM reach JOIN link ON u = other),
             root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM root LEFT JOIN size USING (doc_id)""",
    "op12_ball_tree": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             size AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
             total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
             tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
             weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
                        FROM tf, total GROUP BY term),
             item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             hit AS (SELECT item_id, doc_id,
                            CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
                     FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM hit WHERE score > 0 QUALIFY rank <= 50""",
    "op13_periodic": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                              lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                  lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS h FROM documents),
             s AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
             e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM s),
             t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
                          list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM e),
             word AS (SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
             gram AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS h FROM t, range(0, n - 5) r(i)),
             gap AS (SELECT DISTINCT l.doc_id, r.i - l.i AS q FROM gram l JOIN gram r USING (doc_id, h) WHERE r.i > l.i),
             same AS (SELECT l.doc_id, l.i, gap.q FROM gap JOIN word l USING (doc_id) JOIN word r ON r.doc_id = l.doc_id AND r.i = l.i + gap.q AND r.x = l.x),
             part AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
             wide AS (SELECT doc_id, q, min(i) AS a, max(i) + q + 1 AS z FROM part GROUP BY doc_id, q, k HAVING max(i) + q + 1 - min(i) >= greatest(12, 2 * q)),
             run AS (SELECT * FROM wide l WHERE NOT EXISTS (SELECT 1 FROM wide s WHERE s.doc_id = l.doc_id AND s.q < l.q AND s.a <= l.a AND s.z >= l.z)),
             runs AS (SELECT doc_id, count(*) AS n_runs, arg_max(a, (z - a, -a, -q)) AS start, arg_max(z - a, (z - a, -a, -q)) AS length,
                             arg_max(q, (z - a, -a, -q)) AS period, string_agg(a || ',' || (z - a) || ',' || q || chr(10), '' ORDER BY a, q) AS lines
                      FROM run GROUP BY doc_id),
             gone AS (SELECT DISTINCT doc_id, i FROM run, range(a + q, z) r(i)),
             kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
               CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
        FROM t LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_grace": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
        FROM d JOIN g USING (text)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT html, min(page_id) AS first_page FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_page THEN first_page END AS refers_to
        FROM p LEFT JOIN f USING (html)""",
}
