"""Running totals and ranks that never sort a whole table in one task.

A window without a partition key moves every row to one task.  Here the rows are first pre-aggregated to one row
per distinct value, the values are range-partitioned in their own type, a window runs inside each range, and
the totals of the earlier ranges (one row per range) are added as an offset.  The result is exact; the
sampled range bounds only decide how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from targetloom.session import cut_lineage

_FOLDS = {
    "sum": (F.sum, lambda here, before: here + F.coalesce(before, F.lit(0))),
    "min": (F.min, lambda here, before: F.least(here, before)),
    "max": (F.max, lambda here, before: F.greatest(here, before)),
}


def running(
    per_value: DataFrame,
    order: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
    how: str = "sum",
) -> DataFrame:
    """Add ``cum_<c>``: inclusive running sum, min or max of each column along ``order`` within ``by``.

    ``per_value`` holds one row per (by, order) value, so ties are already merged; ``order`` is of any type that sorts.
    There are ``ranges`` ranges, by default as many as shuffle partitions; the result does not depend on it.  The ranged
    rows are written once (so this runs a job), as the range of a row must not change between the two reads below.
    """
    by = list(by)
    fold, combine = _FOLDS[how]
    ranges = ranges or max(2, int(per_value.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    along = F.col(order).desc() if descending else F.col(order).asc()
    if ranges > 1:
        keyed = cut_lineage(per_value.repartitionByRange(ranges, along).withColumn("_range", F.spark_partition_id()))
    else:
        keyed = per_value.withColumn("_range", F.lit(0))
    inside = Window.partitionBy(*by, "_range").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", *[fold(c).over(inside).alias(f"cum_{c}") for c in cols])
    if ranges == 1:
        return local.drop("_range")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*by, "_range").agg(*[fold(c).alias(f"_t_{c}") for c in cols])
    offsets = totals.select(
        *[F.col(b).alias(f"_o_{b}") for b in by],
        F.col("_range").alias("_o_range"),
        *[fold(f"_t_{c}").over(earlier).alias(f"_o_c_{c}") for c in cols],
    )
    cond = F.col("_range") == F.col("_o_range")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    joined = local.join(offsets, cond, "inner")
    return joined.select(*per_value.columns, *[combine(F.col(f"cum_{c}"), F.col(f"_o_c_{c}")).alias(f"cum_{c}") for c in cols])


def running_sums(
    per_value: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, ranges: int | None = None
) -> DataFrame:
    return running(per_value, order, sums, by, descending, ranges, "sum")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_at"))


def average_ranks(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    out: str = "rank",
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Average rank of ties (1-based), for groups of any size."""
    counts = running_sums(value_counts(df, value, by), value, ["n_at"], by, descending, ranges)
    ranked = counts.select(*by, value, (F.col("cum_n_at") - (F.col("n_at") - 1) / 2.0).alias(out))
    return df.join(ranked, [*by, value], "inner")


def ranks_within(df: DataFrame, value: str, by: Sequence[str], out: str = "rank", descending: bool = False) -> DataFrame:
    """Average rank of ties inside groups whose size the caller bounds (a trial over a fixed panel)."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    first = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return df.withColumn(out, first + (ties - 1) / 2.0)


def dense_positions(df: DataFrame, key: str, by: Sequence[str] = (), out: str = "pos", ranges: int | None = None) -> DataFrame:
    """1-based position of each distinct numeric ``key``; equal keys share a position."""
    distinct = df.select(*by, key).distinct().withColumn("one", F.lit(1))
    pos = running_sums(distinct, key, ["one"], by, ranges=ranges).select(*by, key, F.col("cum_one").alias(out))
    return df.join(pos, [*by, key], "inner")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by..., q, quantile) with linear interpolation between order statistics; nulls are ignored.

    Works on distinct values with their counts, so neither a large group nor a hot value lands in one task.
    """
    by = list(by)
    counts = value_counts(df.where(F.col(value).isNotNull()), value, by)
    cum = running_sums(counts, value, ["n_at"], by, ranges=ranges)
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n_at").alias("_n"))
        cum = cum.join(totals, by)
    else:
        cum = cum.withColumn("_n", counts.agg(F.sum("n_at").alias("n")).scalar())
    rows = cum.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    rows = rows.withColumn("_p", F.col("q") * (F.col("_n") - 1)).withColumn("_lo", F.floor("_p")).withColumn("_hi", F.ceil("_p"))
    before = F.col("cum_n_at") - F.col("n_at")

    def at(pos: str) -> Column:
        return F.max(F.when((before <= F.col(pos)) & (F.col(pos) < F.col("cum_n_at")), F.col(value)))

    picked = rows.groupBy(*by, "q").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.first("_p").alias("_p"))
    frac = F.col("_p") - F.floor("_p")
    return picked.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("quantile"))


def medians(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median", ranges: int | None = None) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, ranges).select(*by, F.col("quantile").alias(out))


def row_positions(df: DataFrame, value: str, tie: Sequence[str], by: Sequence[str] = (), out: str = "pos", ranges: int | None = None) -> DataFrame:
    """Distinct 1-based positions 1..n per group, ordered by value and then by ``tie``.

    Meant for values with few ties (hash draws): only rows that share a value are numbered by a window.
    """
    counts = running_sums(value_counts(df, value, by), value, ["n_at"], by, ranges=ranges)
    starts = counts.select(*by, value, (F.col("cum_n_at") - F.col("n_at")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*by, value).orderBy(*tie))
    return df.withColumn("_w", within).join(starts, [*by, value]).withColumn(out, F.col("_start") + F.col("_w")).drop("_start", "_w")
