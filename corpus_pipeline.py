"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from plinth.llm import decontaminate, pii, quality, sentencepiece_codec, similarity
from plinth.session import prepare, shared_path

#: SQL can express neither the trained stages nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark, docs, sf_dir):
    """Documents that the discriminant rejects go."""
    prepare(spark)
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one with the least id: five-word shingles, similarity 0.8, on SimHash and MinHash candidates."""
    prepare(spark)
    return similarity.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go."""
    prepare(spark)
    return decontaminate.remove_leaking(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark, docs, sf_dir):
    """Personal data in texts gives way to its kind in brackets; ``n_chars`` follows the text."""
    prepare(spark)
    text = pii.redacted(pii.fit(docs), F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sentencepiece_stage(spark, docs, sf_dir):
    """Ids of each text, with their number and the text that they decode to.

    Blocks are a quarter of the operator's own: executors still hold what the stages before left in memory, and smaller
    tables of words cost more shuffle only.
    """
    prepare(spark)
    out = sentencepiece_codec.sentencepiece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"), block_chars=sentencepiece_codec.BLOCK_CHARS // 4)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark, sf_dir):
    docs, folder = _table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
