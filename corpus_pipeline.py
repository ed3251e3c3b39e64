"""From raw documents to packed sequences: five stages, each one operator of ``targetloom.llm``.

Every stage reads the whole result of the one before, which ``run`` writes as Parquet in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.content_sort import drop_exact
from targetloom.llm.debruijn import drop_passages
from targetloom.llm.packing import pack_documents
from targetloom.llm.prefix_orders import drop_near
from targetloom.llm.weak_labels import score_quality
from targetloom.session import cut_lineage

NEAR_PERCENT = 80
NEAR_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; null, empty and blank texts go, whatever else the row holds.

    Rows with null or repeated identifiers are judged by their text alone; an empty table stays empty; other columns
    come back as they were, also where they are named as the classifier's own.
    """
    inside = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inside.items()])
    return score_quality(renamed).where("keep").select(*[F.col(name).alias(c) for c, name in inside.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its runs of five words."""
    return drop_near(docs, percent=NEAR_PERCENT, size=NEAR_WORDS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that are met elsewhere; n_chars, where there is one, counts what is left."""
    left = drop_passages(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packed", packed),
]

ORACLE_SQL = None  # estimated accuracies, trained weights, components and library token ids are not SQL; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
