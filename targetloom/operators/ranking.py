"""Rank statistics, multiple-testing correction, overlaps and model comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from targetloom.operators.prefix import average_ranks, exact_quantiles, ranks_within, running, value_counts
from targetloom.session import cut_lineage


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's rho of two columns (average-tie ranks over the whole table)."""
    ranked = average_ranks(average_ranks(df, a, out="_ra"), b, out="_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman_rho"), F.count(F.lit(1)).alias("n"))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """q = min over larger p of p n / rank, capped at 1.  Depends on the distinct p-values only."""
    counts = running(value_counts(df.where(F.col(p).isNotNull()), p), p, ["n_at"])
    n = df.agg(F.count(p).alias("n")).scalar()
    raw = counts.select(p, (F.col(p) * n / F.col("cum_n_at")).alias("_raw"))
    q = running(raw, p, ["_raw"], descending=True, how="min").select(p, F.least(F.lit(1.0), "cum__raw").alias(out))
    return df.join(q, p, "left")


def naive_fdr(df: DataFrame, p: str = "p_value", alpha: float = 0.05, out: str = "fdr") -> DataFrame:
    """Parity form: only p < alpha, m = their number, forward running maximum of p m / rank."""
    kept = df.where(F.col(p) < alpha)
    counts = running(value_counts(kept, p), p, ["n_at"])
    m = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    raw = counts.select(p, (F.col(p) * (m / (F.col("cum_n_at") - F.col("n_at") + 1))).alias("_raw"))
    fdr = running(raw, p, ["_raw"], how="max").select(p, F.col("cum__raw").alias(out))
    return kept.join(fdr, p)


def top_k(df: DataFrame, score: str, keys: Sequence[str], k: int) -> DataFrame:
    """k best rows, keys ascending on ties: a take-ordered, no full sort."""
    return df.orderBy(F.desc(score), *keys).limit(k)


def top_k_overlap(a: DataFrame, b: DataFrame, score: str, keys: Sequence[str], k: int) -> DataFrame:
    """Shared share of two top-k lists and their Jaccard index."""
    both = top_k(a, score, keys, k).select(*keys).intersect(top_k(b, score, keys, k).select(*keys))
    n = F.count(F.lit(1))
    return both.agg((n / F.lit(k)).alias("overlap"), (n / (2 * F.lit(k) - n)).alias("jaccard"))


def positions_within(df: DataFrame, score: str, keys: Sequence[str], by: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position per group; the caller bounds the group (a trial over a fixed panel)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *keys)))


def compare_scenarios(base: DataFrame, trials: DataFrame, keys: Sequence[str], by: Sequence[str], ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Spearman's rho and top-k overlap of every scenario with the baseline.

    ``base`` (unique keys, score); ``trials`` (by, keys, score).  One trial ranks one panel, so its group is panel-sized.
    """
    base = cut_lineage(base.select(*keys, "score"))
    most = max(ks)  # only these places of the baseline matter, so the window below holds that many rows
    first = top_k(base, "score", keys, most).withColumn("_bp", F.row_number().over(Window.orderBy(F.desc("score"), *keys))).select(*keys, "_bp")
    b = average_ranks(base, "score", out="_br", descending=True).join(F.broadcast(first), list(keys), "left").fillna(most + 1, ["_bp"]).select(*keys, "_br", "_bp")
    t = positions_within(ranks_within(trials, "score", by, "_tr", True), "score", keys, by, "_tp")
    j = t.join(b, list(keys))
    overlaps = [(F.count_if((F.col("_tp") <= k) & (F.col("_bp") <= k)) / F.lit(float(k))).alias(f"top{k}_overlap") for k in ks]
    return j.groupBy(*by).agg(F.corr("_tr", "_br").alias("spearman_rho"), *overlaps)


def times_in_top(trials: DataFrame, keys: Sequence[str], by: Sequence[str], k: int, universe: DataFrame) -> DataFrame:
    """How many trials place a key in their top-k; keys never seen count 0."""
    top = positions_within(trials, "score", keys, by).where(F.col("pos") <= k).groupBy(*keys).agg(F.count(F.lit(1)).alias("times_in_top"))
    return universe.select(*keys).distinct().join(top, list(keys), "left").fillna(0, ["times_in_top"])


def empirical_p_z(null: DataFrame, observed: float | Column, value: str = "null_score", by: Sequence[str] = ()) -> DataFrame:
    """p = (#null >= observed + 1) / (n + 1), Z with the sample sd; null_sd is the population sd."""
    obs = observed if isinstance(observed, Column) else F.lit(float(observed))
    rows = null.withColumn("_obs", obs)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("_obs").alias("observed"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"),
        F.stddev_samp(value).alias("_sd"), F.count_if(F.col(value) >= F.col("_obs")).alias("_ge"),
    )
    z = F.when(F.col("_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("_sd"))
    return agg.select(*by, "n", "observed", "null_mean", "null_sd", z.alias("z"), ((F.col("_ge") + 1) / (F.col("n") + 1)).alias("empirical_p"))


def quantile_groups(df: DataFrame, score: str, groups: int = 3, out: str = "risk_group") -> DataFrame:
    """Group = number of inner quantile cuts <= score."""
    cuts = exact_quantiles(df, score, [i / groups for i in range(1, groups)])
    arr = cuts.agg(F.array_sort(F.collect_list("quantile")).alias("c")).scalar()
    return df.withColumn("_cuts", arr).withColumn(out, F.size(F.filter("_cuts", lambda c: c <= F.col(score)))).drop("_cuts")


def median_split(df: DataFrame, value: str, by: Sequence[str], out: str = "expression_group") -> DataFrame:
    """high above the median of the group, low at or below it."""
    med = exact_quantiles(df, value, [0.5], by).select(*by, F.col("quantile").alias("_med"))
    return df.join(med, list(by)).withColumn(out, F.when(F.col(value) > F.col("_med"), "high").otherwise("low")).drop("_med")


def rank_shift(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str, moved: int = 50) -> DataFrame:
    """Median absolute rank shift of two rankings and the share that moved more than ``moved`` places."""
    ra = average_ranks(a.select(*keys, score), score, out="_ra", descending=True).select(*keys, "_ra")
    rb = average_ranks(b.select(*keys, score), score, out="_rb", descending=True).select(*keys, "_rb")
    d = ra.join(rb, list(keys)).select(*keys, F.abs(F.col("_ra") - F.col("_rb")).alias("shift"))
    med = exact_quantiles(d, "shift", [0.5]).select("quantile").scalar()
    return d.agg(F.avg((F.col("shift") > moved).cast("double")).alias("share_moved"), F.max("shift").alias("max_shift")).select(
        med.alias("median_shift"), "share_moved", "max_shift"
    )


def newcomers(before: DataFrame, after: DataFrame, score: str, keys: Sequence[str], k: int = 20) -> DataFrame:
    return top_k(after, score, keys, k).select(*keys).exceptAll(top_k(before, score, keys, k).select(*keys))


def score_summary(df: DataFrame, score: str, by: Sequence[str] = (), keys: Sequence[str] = (), top_n: int = 20) -> DataFrame:
    """Rows, distinct scores, extremes, and how many of the top-n rows share their score with another of them."""
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(score).alias("distinct_scores"), F.max(score).alias("max_score"), F.min(score).alias("min_score"),
        F.avg(score).alias("mean_score"),
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *keys))
    top = df.withColumn("_p", place).where(F.col("_p") <= top_n).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_c"))
    ties = top.groupBy(*by).agg(F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("tied_in_top"))
    return base.join(ties, list(by)) if by else base.withColumn("tied_in_top", ties.select("tied_in_top").scalar())


def winner_concentration(winners: DataFrame, by: Sequence[str], tops: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of winning-pair slots held by the most frequent entities.  ``winners``: (by, ki, kj)."""
    counts = winners.select(*by, F.explode(F.array("ki", "kj")).alias("entity")).groupBy(*by, "entity").agg(F.count(F.lit(1)).alias("n"))
    pos = positions_within(counts, "n", ["entity"], by)
    return pos.groupBy(*by).agg(*[(F.sum(F.when(F.col("pos") <= t, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{t}_share") for t in tops])


def edge_set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes, intersection, union and Jaccard of two undirected edge sets (columns s, t)."""
    def canon(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct().withColumn(flag, F.lit(1))

    j = canon(a, "in_a").join(canon(b, "in_b"), ["s", "t"], "full")
    both = F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull())
    total = F.count(F.lit(1))
    return j.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), both.alias("shared"), total.alias("union_size"), (both / total).alias("jaccard"))


def merged_edges(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of two (source, target, weight) tables; the second overrides the first on the same ordered key."""
    rows = base.select("source", "target", "weight", F.lit(0).alias("p")).unionByName(extra.select("source", "target", "weight", F.lit(1).alias("p")))
    return rows.groupBy("source", "target").agg(F.max_by("weight", "p").alias("weight"))


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}
