"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, PII, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histofold.llm import exact_dedup, jaccard, packing, pii, toxicity
from histofold.llm.common import OWN, Scratch, documents


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose compression-distance score reaches the toxic threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.is_training(F.col("doc_id")))
    score = f"{OWN}score"
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < toxicity.REJECT).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the 5-word Jaccard join stays."""
    return jaccard.representatives(docs)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Detected entities get surrogates; ``n_chars`` follows the new text."""
    out = pii.checked(docs, pii.session_key(spark), spans_col=None)
    size = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", size).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences of at most 2048 ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", hide_pii),
    ("packing", pack),
]

#: Compression scores, shingle links, keyed surrogates and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    store, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), name)
        if k:
            store.drop(STAGES[k - 1][0])  # its only reader has been written
    return docs
