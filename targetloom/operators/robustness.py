"""Weight perturbation, ablation and permutation null models; the scenario or replicate is always a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from targetloom.functions.numeric import keyed_uniform
from targetloom.operators.permutation import numbered, round_keys, shuffled_place
from targetloom.operators.ranking import normalised


def _weight_struct(name: str, weights: Mapping[str, float], **labels: object) -> Column:
    cols = [F.lit(name).alias("scenario")] + [F.lit(v).alias(k) for k, v in labels.items()] + [F.lit(float(v)).alias(f"w_{k}") for k, v in weights.items()]
    return F.struct(*cols)


def perturbation_scenarios(weights: Mapping[str, float], fractions: Sequence[float] = (-0.25, 0.25)) -> Column:
    """Array of one-at-a-time perturbations, each renormalised to sum 1."""
    out = []
    for term in weights:
        for frac in fractions:
            changed = {**weights, term: weights[term] * (1 + frac)}
            out.append(_weight_struct(f"{term}{frac:+.2f}", normalised(changed)))
    return F.array(*out)


def ablation_scenarios(weights: Mapping[str, float], terms: Sequence[str] | None = None) -> Column:
    """Array with one term zeroed at a time, the others renormalised."""
    out = []
    for term in terms or list(weights):
        rest = normalised({k: v for k, v in weights.items() if k != term})
        out.append(_weight_struct(term, {k: rest.get(k, 0.0) for k in weights}))
    return F.array(*out)


def apply_scenarios(df: DataFrame, scenarios: Column, score: Column) -> DataFrame:
    """Each row once per scenario, scored with the scenario's weights (columns ``w_*``): one pass for all."""
    return df.withColumn("_s", F.explode(scenarios)).select("*", "_s.*").drop("_s").withColumn("score", F.round(score, 9))


def trial_ids(spark: SparkSession, trials: int, column: str = "trial") -> DataFrame:
    return spark.range(trials).select(F.col("id").cast("int").alias(column))


def dirichlet_weights(spark: SparkSession, terms: Sequence[str], trials: int, seed: int, shape: int = 5) -> DataFrame:
    """(trial, w_<term>...): Dirichlet(shape, ...) draws from keyed uniforms; Gamma(5) is a sum of five exponentials."""
    ids = trial_ids(spark, trials)
    gamma = {
        t: -sum((F.log(keyed_uniform(seed, "trial", F.lit(f"{t}{i}"))) for i in range(1, shape)), F.log(keyed_uniform(seed, "trial", F.lit(f"{t}0"))))
        for t in terms
    }
    g = ids.select("trial", *[e.alias(f"g_{t}") for t, e in gamma.items()])
    total = sum((F.col(f"g_{t}") for t in terms[1:]), F.col(f"g_{terms[0]}"))
    return g.select("trial", *[F.round(F.col(f"g_{t}") / total, 9).alias(f"w_{t}") for t in terms])


def score_trials(rows: DataFrame, draws: DataFrame, score: Column, keep: Sequence[str]) -> DataFrame:
    """Every row under every draw.  The draws are packed into one array (bounded by the trial count, a parameter)
    that travels as a scalar subquery, so the rows are expanded in place without a join."""
    packed = draws.agg(F.array_sort(F.collect_list(F.struct(*draws.columns))).alias("d")).scalar()
    return rows.withColumn("_d", F.explode(packed)).select(*keep, *[c for c in rows.columns if c not in keep], "_d.*").select(
        "trial", *keep, F.round(score, 9).alias("score")
    )


def permuted_column(rows: DataFrame, value: str, order: Sequence[str], replicates: DataFrame, seed: int) -> DataFrame:
    """(replicate, order..., value): the value column shuffled against its unique keys, once per replicate.

    Rows are numbered once; a replicate's shuffle is a keyed bijection of the places, so nothing is sorted per
    replicate.  The keys travel as one array, bounded by the number of replicates.
    """
    base = numbered(rows.select(*order, value), order)
    packed = replicates.agg(F.collect_list(F.struct("replicate", round_keys(seed, "replicate").alias("keys"))).alias("r")).scalar()
    spread = base.select(*order, "_place", F.explode(packed).alias("_r"))
    drawn = spread.select(*order, "_r.replicate", shuffled_place(F.col("_place"), base.count(), F.col("_r.keys")).alias("_place"))
    return drawn.join(base.select("_place", value), "_place").select("replicate", *order, value)


def best_pair_per_replicate(pairs: DataFrame, permuted: DataFrame, score: Column) -> DataFrame:
    """Null A: highest pair score per replicate when entity scores are permuted.  ``pairs``: (k1, k2, comp, xtalk)."""
    a = permuted.select("replicate", F.col("kinase_id").alias("k1"), F.col("target_score").alias("s1"))
    b = permuted.select("replicate", F.col("kinase_id").alias("k2"), F.col("target_score").alias("s2"))
    rows = pairs.drop("s1", "s2").join(a, "k1").join(b, ["replicate", "k2"])
    return rows.groupBy("replicate").agg(F.max(score).alias("null_score"))


def best_pair_with_shuffled_edges(pairs: DataFrame, edges: DataFrame, score: Column) -> DataFrame:
    """Null B': pair scores with per-replicate edge weights (replicate, source, target, weight).

    A pair without an edge scores the same in every replicate, so only linked pairs are expanded.
    """
    look = edges.select("replicate", F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2"), F.col("weight").alias("xtalk"))
    linked = pairs.drop("xtalk").join(look, ["k1", "k2"]).groupBy("replicate").agg(F.max(score).alias("m"))
    ends = edges.select(F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2")).distinct()
    rest = pairs.join(ends, ["k1", "k2"], "left_anti").withColumn("xtalk", F.lit(0.0)).agg(F.max(score).alias("m")).scalar()
    return linked.select("replicate", F.greatest("m", rest).alias("null_score"))


def best_pair_with_rewired_edges(pairs: DataFrame, edges: DataFrame, score: Column) -> DataFrame:
    """Null B: the topology changes per replicate, so the unlinked maximum is taken per replicate as well."""
    look = edges.select("replicate", F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2"), F.col("weight").alias("xtalk"))
    reps = edges.select("replicate").distinct().agg(F.array_sort(F.collect_set("replicate")).alias("r")).scalar()
    spread = pairs.drop("xtalk").withColumn("replicate", F.explode(reps))
    rows = spread.join(look, ["replicate", "k1", "k2"], "left").withColumn("xtalk", F.coalesce("xtalk", F.lit(0.0)))
    return rows.groupBy("replicate").agg(F.max(score).alias("null_score"))


def best_drug_pair_per_replicate(assignment: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """Null C: best score over all drug pairs when the target column is permuted.

    The best over drug pairs is the best over entity pairs held by two different drugs.  An entity pair is missing
    only when both entities sit on one and the same single drug, so counting drugs per entity is enough and no drug
    pair is enumerated.  ``assignment``: (replicate, drug, kinase_id); ``pair_scores``: (k1 <= k2, score), self pairs
    included; the score must not depend on the order of the two entities.
    """
    held = assignment.groupBy("replicate", "kinase_id").agg(F.countDistinct("drug").alias("n"), F.min("drug").alias("only"))
    a = held.select("replicate", F.col("kinase_id").alias("k1"), F.col("n").alias("n1"), F.col("only").alias("o1"))
    b = held.select("replicate", F.col("kinase_id").alias("k2"), F.col("n").alias("n2"), F.col("only").alias("o2"))
    rows = a.join(pair_scores, "k1").join(b, ["replicate", "k2"])
    possible = ~((F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("o1") == F.col("o2")))
    return rows.where(possible).groupBy("replicate").agg(F.max("score").alias("null_score"))
