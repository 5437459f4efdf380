"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of `docs`;
mixing adds its weight columns. `run` writes every stage as Parquet and rereads it.
"""

from pyspark.sql import functions as F

from tunetrail.llm import edit_match, grace, line_crf, raking, simhash
from tunetrail.llm.shared import free_name, stored


def quality(spark, docs, sf_dir):
    """Drop documents whose line CRF score is below the threshold; learns from `labels` of documents in `docs`."""
    model = line_crf.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def exact_dedup(spark, docs, sf_dir):
    """Of rows with equal texts, the one with the largest id stays."""
    return grace.exact_groups(docs).where("kept").select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One row of each group stays: the smallest id, then a hash of the text."""
    kept = free_name(docs, "_kept")
    return simhash.simhash_groups(docs, kept=kept).where(kept).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Drop documents with a benchmark passage within its edit budget."""
    found = edit_match.match_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def mixing(spark, docs, sf_dir):
    """Sample documents so that token shares of source, language and form come near their targets."""
    mixed = raking.mix_to_targets(docs)
    return mixed.where("sampled").select(*docs.columns, "topic", "n_tokens", "weight", "probability")


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing)]

#: Models and rolling hashes have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of `sf_dir`, each stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
