"""Result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.text import pair_key


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet, CSV, TSV or JSON; one file per task, never gathered."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def with_pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pair tables as (key 'a|b', other columns), the form of the JSON edge exports."""
    return df.withColumn("key", pair_key(a, b)).drop(a, b)


def read_pair_map(df: DataFrame, col: str = "payload") -> DataFrame:
    """JSON object {'a|b': weight} back to edge rows."""
    kv = df.select(F.explode(F.from_json(F.col(col), "map<string,double>")).alias("key", "weight"))
    return kv.select(F.split("key", r"\|")[0].alias("source"), F.split("key", r"\|")[1].alias("target"), "weight")


def write_stage_audit(audit: DataFrame, path: str) -> None:
    """The id set of every funnel stage, one folder per stage."""
    write_table(audit, path, "parquet", ["stage"])


def stamped(df: DataFrame, version: str, commit: str, timestamp: str) -> DataFrame:
    return df.withColumns({"pipeline_version": F.lit(version), "git_commit": F.lit(commit), "generated_at": F.lit(timestamp)})
