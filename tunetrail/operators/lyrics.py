"""Bag-of-words features of lyrics.

A text is one row, so its term counts are made inside the row: tokens are sorted and equal
neighbours merged. `counted_lyrics` stores them once; document counts, weights and vectors all
read the stored counts. Only (token, count) pairs that are already combined per task are
shuffled, and weighting needs no shuffle at all.
"""

from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window, functions as F

from tunetrail.functions.text import fix_mojibake, strip_accents
from tunetrail.session import checkpoint

# Runs of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


@lru_cache(maxsize=None)
def language_stop_words(language):
    """The stop-word list Spark ships for a language. Needs a running session."""
    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def analysed_words(spark, words):
    """Stop words as the tokenizer would see them: lower, unaccented, split into tokens."""
    df = spark.createDataFrame([(w,) for w in words], "word string")
    tokens = tokenize(df, "word").select(F.explode("tokens").alias("token")).distinct()
    return sorted(r.token for r in tokens.collect())


def tokenize(df, text="lyrics", strip_escapes=False):
    """Add `tokens`: repaired, lower-cased, unaccented tokens; NULL text has none."""
    clean = df.withColumn("_clean", F.lower(F.coalesce(fix_mojibake(F.col(text), strip_escapes), F.lit(""))))
    plain = clean.withColumn("_clean", strip_accents(F.col("_clean")))
    return plain.withColumn("tokens", F.regexp_extract_all("_clean", F.lit(TOKEN), F.lit(0))).drop("_clean")


def drop_stop_words(df, stop_words, tokens="tokens"):
    """Remove stop words from each token list, keeping repeats of the other tokens."""
    stop_words = list(stop_words)
    if not stop_words:
        return df
    return df.withColumn(tokens, F.filter(tokens, lambda t: ~t.isin(stop_words)))


def term_counts(df, tokens="tokens"):
    """Add `terms`: array<struct<token, tf>>, one entry per distinct token."""
    last = F.size("_sorted") - 1
    ends = F.filter(F.sequence(F.lit(0), last),
                    lambda i: (i == last) | (F.get("_sorted", i) != F.get("_sorted", i + 1)))
    counted = F.transform("_ends", lambda end, k: F.struct(
        F.get("_sorted", end).alias("token"),
        (end - F.coalesce(F.get("_ends", k - 1), F.lit(-1))).cast("bigint").alias("tf")))
    empty = F.array().cast("array<int>")
    return (df.withColumn("_sorted", F.sort_array(tokens))
            .withColumn("_ends", F.when(F.size("_sorted") > 0, ends).otherwise(empty))
            .withColumn("terms", counted).drop("_sorted", "_ends"))


def unfold(df, terms, *keep):
    """One row per term. The outer form keeps Spark from adding a size filter below, which
    would work out each array a second time."""
    return df.select(*keep, F.inline_outer(terms)).where(F.col("token").isNotNull())


def token_stats(docs, weight=None, terms="terms"):
    """(token, df, total): documents that hold the token and its uses over all documents.

    Reads the term counts of each document, so a token is one row per document; one aggregate,
    combined on the map side, does both sums.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    return (unfold(docs.select(times.alias("_times"), terms), terms, "_times").groupBy("token")
            .agg(F.sum("_times").alias("df"), F.sum(F.col("tf") * F.col("_times")).alias("total")))


def vocabulary(docs, min_df=2, max_df=0.7, cap=100, weight=None):
    """The `cap` most used tokens among those in `min_df` … `max_df`·N documents.

    `docs` holds `terms` (see `term_counts`). Returns (token, position, df, total, documents);
    positions follow the alphabet. `weight` names a column that says how many documents a row
    stands for.
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    n_docs = docs.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).scalar()
    kept = (token_stats(docs, weight).withColumn("documents", n_docs)
            .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("documents")))
            .orderBy(F.desc("total"), "token").limit(cap))
    # At most `cap` rows reach this window.
    return kept.select("token", (F.row_number().over(Window.partitionBy().orderBy("token")) - 1).alias("position"),
                       "df", "total", "documents")


def counted_lyrics(texts, key, text="lyrics", stop_words=(), strip_escapes=False, keep=()):
    """(key, kept columns, terms) of every text, stored once: all later steps read the counts.

    Runs the one job that tokenises the corpus.
    """
    tokens = drop_stop_words(tokenize(texts.select(key, *keep, text), text, strip_escapes), stop_words)
    return checkpoint(term_counts(tokens.select(key, *keep, "tokens")).drop("tokens"))


def idf(vocab):
    """ln((1 + N) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((1.0 + F.col("documents")) / (1.0 + F.col("df"))) + 1.0)


def tfidf(docs, vocab, key):
    """(key, token, weight): tf · idf, scaled to unit length per document.

    Collects the vocabulary (bounded by its cap); each document's term counts are then weighted
    inside its row.
    """
    factors = {r.token: r.idf for r in idf(vocab).collect()}
    if not factors:
        return docs.select(key, F.lit("").alias("token"), F.lit(0.0).alias("weight")).limit(0)
    weighed = docs.select(key, _weighed(factors).alias("_terms"))
    norm = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda total, t: total + t["raw"] * t["raw"]))
    return (unfold(weighed.withColumn("_norm", norm), "_terms", key, "_norm")
            .select(key, "token", (F.col("raw") / F.col("_norm")).alias("weight")))


def _weighed(factors):
    """Known terms with tf · idf."""
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return F.transform(F.filter("terms", lambda t: t["token"].isin(list(factors))), lambda t: F.struct(
        t["token"].alias("token"), (t["tf"] * F.try_element_at(table, t["token"])).alias("raw")))


def tokens_of(terms="terms"):
    """The token list behind term counts, each token as often as it was used."""
    return F.flatten(F.transform(terms, lambda t: F.array_repeat(t["token"], t["tf"].cast("int"))))


def tfidf_model(vocab, tokens="tokens", output="lyric_features"):
    """Spark ML stages that turn tokens into the same weights as sparse vectors.

    Collects the vocabulary (bounded by its cap).
    """
    rows = idf(vocab).orderBy("position").collect()
    if not rows:
        raise ValueError("the vocabulary is empty")
    names = [r.token for r in rows]
    spark = vocab.sparkSession
    counts = CountVectorizerModel.from_vocabulary(names, inputCol=tokens, outputCol="_counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_counts", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=output)
    stages = Pipeline(stages=[counts, scale, unit]).fit(spark.createDataFrame([([],)], f"{tokens} array<string>"))
    return stages, names


def token_totals(weights, n=50):
    """Tokens by summed weight, heaviest first."""
    return (weights.groupBy("token").agg(F.sum("weight").alias("weight"))
            .orderBy(F.desc("weight"), "token").limit(n))


def pivot_tokens(weights, vocab, key):
    """One `lyric_<token>` column per vocabulary token, for export. Collects the vocabulary."""
    names = [r.token for r in vocab.orderBy("position").collect()]
    return (weights.groupBy(key).pivot("token", names).agg(F.first("weight")).fillna(0.0, names)
            .select(key, *[F.col(f"`{n}`").alias(f"lyric_{n}") for n in names]))
