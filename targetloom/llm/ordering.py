"""Places of rows within a key, for keys of any size: no window ever holds more than a range of the sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from targetloom.session import cut_lineage


def number_within(rows: DataFrame, by: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Add the place of each row (from 0) among the rows with its ``by``, ordered by ``order`` (nulls first).

    The rows are range-partitioned on (by, order), so a key that holds a third of all rows spreads over a third of the
    ranges, and numbered range by range.  Only the first key of a range can have rows in earlier ones: the offsets that
    are broadcast are at most one row per range.  Rows equal in ``by`` and ``order`` are dealt over ranges as well and
    take any order, so they have to be interchangeable.  ``by`` must not be null.  The rows are written before they are sampled
for the borders of the ranges, so what they are computed from is read once, and written again with their range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cut_lineage(rows.withColumn("_salt", F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(parts, by, *order, "_salt").drop("_salt").withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").select(by, "_range", "_before")
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_place", place.cast("long")).join(F.broadcast(offsets), [by, "_range"], "left")
    return numbered.withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_range", "_place", "_before")
