"""Session defaults and checkpoint-folder handling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "targetloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC timestamps; everything else is the cluster's business."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; where it is unset, one below the warehouse, which executors share as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    else:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go as soon as it has ended, not when the driver happens to collect its garbage.

    For queries that write a table: nobody reads their shuffles again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, bucketed: tuple[int, str] | None = None) -> DataFrame:
    """Materialise an intermediate result as a table in the checkpoint folder and read it back.

    The folder is shared and reliable, so a lost executor never replays earlier rounds.  Reading a table instead of
    a checkpointed RDD gives the next plan real sizes and column pruning, and drops the constraints that otherwise
    pile up over the rounds of an iterative operator.  The shuffles behind the table are dropped once it is written, so
    disk holds those of one step.  ``bucketed`` = (number, column) keeps the rows dealt by a column,
    so that rounds which group or join by it do not shuffle them again; rows should come dealt the same way.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{name}"
    with shuffles_dropped(spark):
        if bucketed:
            df.write.bucketBy(*bucketed).option("path", path).saveAsTable(f"bucketed_{name}")
            return spark.table(f"bucketed_{name}")
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
