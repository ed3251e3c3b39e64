"""Exact deduplication by a content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, the external sort of each range places equal texts next to
each other, and a window over (text, salt) compares neighbouring texts in full.  A group of copies that would fill a
range by itself is salted: its rows are dealt over many ranges, each range keeps its smallest identifier, and the few
sub-results of such a group (one per salt) are compared in full once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from targetloom.llm.registry import query, table
from targetloom.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256[, row]) per input row; ``row`` holds its columns when ``carry``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"), *row).withColumn("sha", F.sha2("norm", 256))
    # groups above a quarter of a range's share: at most 4 x parts of them, so the broadcasts below are bounded
    limit = max(1, docs.count() // (4 * parts))
    hot = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("sha", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), "sha", "left").withColumn("salt", salt)
    # a text's first characters and digest order the ranges, so the sampled splitters stay short; all of the text
    # decides inside one.  The range columns are part of the windows' keys: no further exchange
    ranged = salted.withColumn("head", F.substring("norm", 1, 32)).repartitionByRange(parts, "head", "sha", "salt")
    run = Window.partitionBy("head", "sha", "salt", "norm")
    first_in_run = F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())) == 1
    runs = cut_lineage(
        ranged.select(
            "doc_id", "sha", F.coalesce("hot", F.lit(False)).alias("hot"), first_in_run.alias("first"),
            F.min("doc_id").over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"), "norm", *(["row"] if carry else []),
        ).withColumn("norm", F.when(F.col("hot") & F.col("first"), F.col("norm")))
    )
    # one row per salt of a salted group; the text decides, the digest only finds the way back
    merged = (
        runs.where(F.col("norm").isNotNull()).groupBy("norm")
        .agg(F.first("sha").alias("sha"), F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        .drop("norm")
    )
    joined = runs.drop("norm").join(F.broadcast(merged), "sha", "left")
    return joined.select(
        "doc_id", F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("first") & (~F.col("hot") | F.col("keep_id").eqNullSafe(F.col("all_keep")))).alias("kept"),
        F.col("sha").alias("text_sha256"), *(["row"] if carry else []),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after each run of ASCII white space became one space; null counts as the
    empty text.  Of equal texts the row with the smallest identifier stays; of rows repeating that identifier, one.  A
    null identifier sorts after every other, so it stays only where its whole group has none.  An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    return _sorted_runs(docs, id_col, text_col, carry=False)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with their columns as they were."""
    kept = _sorted_runs(docs, id_col, text_col, carry=True).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@query(
    "op7_content_sort",
    """
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
    """,
)
def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
