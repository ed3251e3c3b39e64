"""Composite target scores, entity pairs, drug pairs and drug triplets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from targetloom.functions.numeric import null_skipping_mean
from targetloom.functions.text import is_junk_drug_name
from targetloom.operators.pairs import co_occurrence, unordered_pairs

# Term weights of the published scores.
TARGET_WEIGHTS = {"centrality": 0.30, "essentiality": 0.25, "survival": 0.25, "druggability": 0.20}
PAIR_WEIGHTS = {"alpha": 0.35, "beta": 0.35, "gamma": 0.20, "delta": 0.10}
DRUG_PAIR_WEIGHTS = {"toxicity": 0.30, "synergy": 0.30}
TRIPLET_WEIGHTS = {"modules": 0.30, "non_redundancy": 0.25, "escape": 0.30, "toxicity": 0.15}
NETWORK_MODELS = {
    "first_network": {"alpha": 0.35, "beta": 0.35, "gamma": 0.20, "delta": 0.10, "delta2": 0.00},
    "second_network": {"alpha": 0.35, "beta": 0.35, "gamma": 0.20, "delta": 0.00, "delta2": 0.10},
    "combined": {"alpha": 0.35, "beta": 0.35, "gamma": 0.20, "delta": 0.05, "delta2": 0.05},
}
CENTRALITY_COLUMNS = ("betweenness", "pagerank", "degree")
DRUG_COLUMNS = ("dgidb_score", "chembl_count", "trial_stage")


def druggability(interactions: DataFrame, entity: str = "kinase_id") -> DataFrame:
    """(entity, dgidb_score, dgidb_score_count): mean score and distinct drugs of the rows whose drug name is no junk."""
    real = interactions.where(~F.coalesce(is_junk_drug_name("drug"), F.lit(False)))
    return real.groupBy(entity).agg(F.avg("interaction_score").alias("dgidb_score"), F.countDistinct("drug").alias("dgidb_score_count"))


def assemble_entities(
    panel: DataFrame, essentiality: DataFrame, survival: DataFrame, centrality: DataFrame, interactions: DataFrame, entity: str = "kinase_id"
) -> DataFrame:
    """One row per panel entity with the evidence of four tables and the drug table; what a table lacks stays null.

    ``essentiality`` has mean_depmap_score, ``survival`` cox_hr and logrank_p, ``centrality`` betweenness, pagerank and
    degree, ``interactions`` drug and interaction_score.  Both druggability aggregates are kept.
    """
    out = panel.select(entity).distinct()
    out = out.join(essentiality.select(entity, F.col("mean_depmap_score").alias("depmap_score")), entity, "left")
    out = out.join(survival.select(entity, "cox_hr", "logrank_p"), entity, "left")
    out = out.join(centrality.select(entity, *CENTRALITY_COLUMNS), entity, "left")
    return out.join(druggability(interactions, entity), entity, "left")


def with_min_max(df: DataFrame, exprs: Mapping[str, Column], lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_unit``: min-max scaled over all rows.

    One aggregate computes every bound; it reaches the rows as one scalar subquery.  A column without variance
    becomes 0.5 on every row, also where the value is null.
    """
    bounds = df.agg(*[f(e).alias(f"{p}_{n}") for n, e in exprs.items() for p, f in (("lo", F.min), ("hi", F.max))])
    out = df.withColumn("_bounds", bounds.select(F.struct(*bounds.columns).alias("b")).scalar())
    units = {}
    for name, value in exprs.items():
        lo, hi = F.col(f"_bounds.lo_{name}"), F.col(f"_bounds.hi_{name}")
        scaled = (value - lo) / (hi - lo)
        if name in lower_is_better:
            scaled = F.lit(1.0) - scaled
        units[f"{name}_unit"] = F.when(hi == lo, F.lit(0.5)).otherwise(scaled)
    return out.withColumns(units).drop("_bounds")


def target_score(metrics: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Composite score with one missing-value rule per term: neutral 0.5, but 0 for absent drug evidence."""
    w = dict(weights or TARGET_WEIGHTS)
    central = [c for c in CENTRALITY_COLUMNS if c in metrics.columns]
    drug = [c for c in DRUG_COLUMNS if c in metrics.columns]
    lacking = [c for c in ("depmap_score", "cox_hr", "logrank_p") if c not in metrics.columns]
    if not central or not drug or lacking:
        raise ValueError(f"metrics need a centrality column, a drug-evidence column and {lacking or 'the rest'}")
    floor_p = F.when(F.col("logrank_p") < 1e-300, F.lit(1e-300)).otherwise(F.col("logrank_p"))
    raw = {c: F.col(c) for c in (*central, *drug, "depmap_score")}
    raw["survival"] = F.signum(F.col("cox_hr") - 1.0) * (-F.log10(floor_p))
    scaled = with_min_max(metrics, raw, lower_is_better=("depmap_score",))

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) == 0

    def all_zero(cols: Sequence[str]) -> Column:
        out = zero(cols[0])
        for c in cols[1:]:
            out = out & zero(c)
        return out

    scaled = scaled.withColumns(
        {
            "_central": null_skipping_mean([F.col(f"{c}_unit") for c in central]),
            "_drug": null_skipping_mean([F.col(f"{c}_unit") for c in drug]),
        }
    )
    flags = {
        "centrality_missing": F.col("_central").isNull() | (zero("degree") if "degree" in central else all_zero(central)),
        "essentiality_missing": F.col("depmap_score").isNull(),
        "survival_missing": F.col("cox_hr").isNull() | F.col("logrank_p").isNull(),
        "druggability_missing": F.col("_drug").isNull() | all_zero(drug),
    }
    terms = {
        "centrality": ("_central", 0.5),
        "essentiality": ("depmap_score_unit", 0.5),
        "survival": ("survival_unit", 0.5),
        "druggability": ("_drug", 0.0),
    }
    out = scaled.withColumns(flags).withColumns(
        {f"{t}_norm": F.when(F.col(f"{t}_missing"), F.lit(fb)).otherwise(F.col(c)) for t, (c, fb) in terms.items()}
    )
    kept = [*metrics.columns, *flags, *[f"{t}_norm" for t in terms]]
    return out.select(*kept, weighted_terms(w).alias("target_score"))


def weighted_terms(weights: Mapping[str, float | Column]) -> Column:
    total = None
    for term in ("centrality", "essentiality", "survival", "druggability"):
        w = weights[term]
        part = (w if isinstance(w, Column) else F.lit(float(w))) * F.col(f"{term}_norm")
        total = part if total is None else total + part
    return total


def both_orientations(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """(a, b, weight) for lookups in either order; the stated orientation wins over the reversed one."""
    fwd = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(weight).alias("w"), F.lit(0).alias("p"))
    rev = edges.select(F.col(target).alias("a"), F.col(source).alias("b"), F.col(weight).alias("w"), F.lit(1).alias("p"))
    return fwd.unionByName(rev).groupBy("a", "b").agg(F.min_by("w", "p").alias("w"))


def with_crosstalk(pairs: DataFrame, left: str, right: str, edges: DataFrame, names: tuple[str, str, str], out: str) -> DataFrame:
    look = both_orientations(edges, *names).select(F.col("a").alias(left), F.col("b").alias(right), F.col("w").alias(out))
    return pairs.join(look, [left, right], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def complementarity(ci: str, cj: str, cross: float = 1.0, same: float = 0.0) -> Column:
    """Reward for different communities; an unknown community on either side gives 0."""
    known = F.col(ci).isNotNull() & F.col(cj).isNotNull()
    return F.when(~known, 0.0).when(F.col(ci) != F.col(cj), F.lit(cross)).otherwise(F.lit(same))


def pair_expression(w: Mapping[str, float | Column], si: str, sj: str, comp: str, cross: str, cross2: str | None = None) -> Column:
    def c(v: float | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    out = c(w["alpha"]) * F.col(si) + c(w["beta"]) * F.col(sj) + c(w["gamma"]) * F.col(comp) + c(w["delta"]) * F.col(cross)
    return out + c(w["delta2"]) * F.col(cross2) if cross2 else out


def entity_attributes(scores: DataFrame, community: DataFrame) -> DataFrame:
    return scores.select("kinase_id", "target_score").join(community.select("kinase_id", "community"), "kinase_id", "left")


def entity_pairs(scores: DataFrame, community: DataFrame, edges: DataFrame, edges2: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """All unordered panel pairs with the terms of the pair score."""
    pairs = unordered_pairs(entity_attributes(scores, community), "kinase_id", blocks)
    out = with_crosstalk(pairs, "kinase_id_1", "kinase_id_2", edges, ("source", "target", "weight"), "xtalk")
    if edges2 is not None:
        out = with_crosstalk(out, "kinase_id_1", "kinase_id_2", edges2, ("gene1", "gene2", "score"), "xtalk2")
    out = out.withColumn("comp", complementarity("community_1", "community_2"))
    return out.select(
        F.col("kinase_id_1").alias("k1"), F.col("kinase_id_2").alias("k2"), F.col("target_score_1").alias("s1"),
        F.col("target_score_2").alias("s2"), "comp", "xtalk", *(["xtalk2"] if edges2 is not None else []),
    )


def drug_score_simple(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """Sum over target rows, duplicates included; an unscored target adds 0."""
    joined = targets.join(scores.select("kinase_id", "target_score"), "kinase_id", "left")
    return joined.groupBy("drug").agg(F.sum(F.coalesce("target_score", F.lit(0.0))).alias("drug_score"))


def drug_score_refined(
    targets: DataFrame,
    scores: DataFrame,
    toxicity: DataFrame | None = None,
    synergy_prior: DataFrame | None = None,
    off_target_penalty: float = 0.1,
) -> DataFrame:
    """Potency- and selectivity-weighted sum minus off-target burden and toxicity, plus a synergy prior."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(1.0)) if c in targets.columns else F.lit(1.0)

    joined = targets.join(scores.select("kinase_id", "target_score"), "kinase_id", "left")
    out = joined.groupBy("drug").agg(
        F.sum(F.coalesce("target_score", F.lit(0.0)) * part("potency") * part("selectivity")).alias("weighted"),
        F.count(F.lit(1)).alias("n_targets"),
    )
    for extra, name in ((toxicity, "toxicity"), (synergy_prior, "synergy_prior")):
        if extra is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            out = out.join(extra.select("drug", name), "drug", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    burden = F.lit(off_target_penalty) * F.greatest(F.col("n_targets") - 1, F.lit(0))
    return out.withColumn("drug_score", F.col("weighted") - burden - F.col("toxicity") + F.col("synergy_prior"))


def drug_panels(targets: DataFrame, scores: DataFrame, community: DataFrame) -> DataFrame:
    """One row per drug with its targets, their scores and communities packed in list order."""
    rows = targets.join(scores.select("kinase_id", "target_score"), "kinase_id", "left")
    rows = rows.join(community.select("kinase_id", "community"), "kinase_id", "left")
    packed = F.struct("ord", "kinase_id", F.coalesce("target_score", F.lit(0.0)).alias("s"), F.col("community").alias("c"))
    return rows.groupBy("drug").agg(F.array_sort(F.collect_list(packed)).alias("t"))


def target_pair_rows(
    targets: DataFrame, scores: DataFrame, community: DataFrame, edges: DataFrame, edges2: DataFrame | None = None, blocks: int | None = None
) -> DataFrame:
    """Every drug pair crossed with its target pairs, with the pair-score terms attached."""
    pairs = unordered_pairs(drug_panels(targets, scores, community), "drug", blocks)
    rows = pairs.select("drug_1", "drug_2", F.explode("t_1").alias("i"), "t_2").select("drug_1", "drug_2", "i", F.explode("t_2").alias("j"))
    rows = rows.select(
        "drug_1", "drug_2", F.col("i.ord").alias("ord_i"), F.col("j.ord").alias("ord_j"), F.col("i.kinase_id").alias("ki"),
        F.col("j.kinase_id").alias("kj"), F.col("i.s").alias("si"), F.col("j.s").alias("sj"), F.col("i.c").alias("ci"), F.col("j.c").alias("cj"),
    ).withColumn("comp", complementarity("ci", "cj"))
    rows = with_crosstalk(rows, "ki", "kj", edges, ("source", "target", "weight"), "xtalk")
    if edges2 is not None:
        rows = with_crosstalk(rows, "ki", "kj", edges2, ("gene1", "gene2", "score"), "xtalk2")
    return rows


def best_target_pairs(rows: DataFrame, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """Highest target pair of each drug pair; the first pair in list order wins a tie.

    The arg-max is a plain aggregate over one struct, so it is combined before the shuffle and needs no sort.
    """
    key = F.struct(score.alias("score"), (-F.col("ord_i")).alias("oi"), (-F.col("ord_j")).alias("oj"), "ki", "kj")
    best = rows.groupBy(*by, "drug_1", "drug_2").agg(F.max(key).alias("b"))
    return best.select(*by, "drug_1", "drug_2", F.col("b.score").alias("base_score"), F.col("b.ki").alias("ki"), F.col("b.kj").alias("kj"))


def reaction_jaccard(reactions: DataFrame, blocks: int = 1) -> DataFrame:
    """Jaccard of the reaction sets of all drug pairs that have reactions; 0 where nothing is shared."""
    sets = reactions.select("drug", F.lower("reaction").alias("reaction")).distinct()
    sizes = sets.groupBy("drug").agg(F.count(F.lit(1)).alias("n_reactions"))
    shared = co_occurrence(sets, "reaction", "drug", blocks).select(
        F.col("item_a").alias("drug_1"), F.col("item_b").alias("drug_2"), F.col("n").alias("shared")
    )
    pairs = unordered_pairs(sizes, "drug").join(shared, ["drug_1", "drug_2"], "left").fillna(0, ["shared"])
    union = F.col("n_reactions_1") + F.col("n_reactions_2") - F.col("shared")
    return pairs.select("drug_1", "drug_2", "shared", F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("toxicity"))


def co_report_ratio(reports: DataFrame, blocks: int = 1) -> DataFrame:
    """co-reports / min(single counts); a zero denominator counts as 1.  ``reports``: (report_id, drug)."""
    rows = reports.select("report_id", "drug").distinct()
    solo = rows.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    both = co_occurrence(rows, "report_id", "drug", blocks).select(
        F.col("item_a").alias("drug_1"), F.col("item_b").alias("drug_2"), F.col("n").alias("co")
    )
    pairs = unordered_pairs(solo, "drug").join(both, ["drug_1", "drug_2"], "left").fillna(0, ["co"])
    low = F.least("n_1", "n_2")
    return pairs.select("drug_1", "drug_2", "co", (F.col("co") / F.when(low == 0, 1).otherwise(low)).alias("ratio"))


def apply_pair_lookup(pairs: DataFrame, lookup: DataFrame | None, value: str) -> DataFrame:
    """Left join of an unordered pair table; absent pairs are 0."""
    if lookup is None:
        return pairs.withColumn(value, F.lit(0.0))
    look = lookup.select(F.least("drug_1", "drug_2").alias("drug_1"), F.greatest("drug_1", "drug_2").alias("drug_2"), value)
    return pairs.join(look, ["drug_1", "drug_2"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def drug_pair_scores(best: DataFrame, toxicity: DataFrame | None, synergy: DataFrame | None = None) -> DataFrame:
    """base - 0.30 toxicity, plus 0.30 synergy only when a synergy table is given."""
    out = apply_pair_lookup(best, toxicity, "toxicity")
    score = F.col("base_score") - F.lit(DRUG_PAIR_WEIGHTS["toxicity"]) * F.col("toxicity")
    if synergy is not None:
        out = apply_pair_lookup(out, synergy, "synergy")
        score = score + F.lit(DRUG_PAIR_WEIGHTS["synergy"]) * F.col("synergy")
    return out.withColumn("drug_pair_score", score)


def winner_frequency(best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sorted winning pair and how many drug pairs it wins; counted first, then joined, so a winner that takes a
    third of all pairs is never gathered in one task."""
    won = best.withColumn("w1", F.least("ki", "kj")).withColumn("w2", F.greatest("ki", "kj"))
    freq = won.groupBy(*by, "w1", "w2").agg(F.count(F.lit(1)).alias("winner_frequency"))
    return won.join(freq, [*by, "w1", "w2"], "left")


def redundancy_penalised(
    best: DataFrame, toxicity: DataFrame | None, synergy: DataFrame | None = None, penalty_weight: float = 0.15, by: Sequence[str] = ()
) -> DataFrame:
    """Penalise winners that recur, floor at 0, then apply toxicity: only toxicity can make a score negative."""
    out = apply_pair_lookup(apply_pair_lookup(winner_frequency(best, by), toxicity, "toxicity"), synergy, "synergy")
    out = out.withColumn("penalty", F.lit(penalty_weight) * F.greatest(F.col("winner_frequency") - 1, F.lit(0)))
    out = out.withColumn("adjusted_base", F.greatest(F.col("base_score") - F.col("penalty"), F.lit(0.0)))
    return out.withColumn(
        "drug_pair_score",
        F.col("adjusted_base")
        - F.lit(DRUG_PAIR_WEIGHTS["toxicity"]) * F.col("toxicity")
        + F.lit(DRUG_PAIR_WEIGHTS["synergy"]) * F.col("synergy"),
    )


def primary_targets(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """The highest-scoring known target per drug; first in list order on ties."""
    rows = targets.join(scores.select("kinase_id", "target_score"), "kinase_id", "inner")
    key = F.struct("target_score", (-F.col("ord")).alias("o"), "kinase_id")
    return rows.groupBy("drug").agg(F.max(key).alias("b")).select("drug", F.col("b.kinase_id").alias("kinase_id"), F.lit(1).alias("ord"))


def top_drugs(targets: DataFrame, scores: DataFrame, limit: int = 60) -> DataFrame:
    """Drugs with at least one scored target, the ``limit`` highest by best target score."""
    rows = targets.join(scores.select("kinase_id", "target_score"), "kinase_id", "inner")
    return rows.groupBy("drug").agg(F.max("target_score").alias("best_target_score")).orderBy(F.desc("best_target_score"), "drug").limit(limit)


def triplets_from_pairs(pair_table: DataFrame, drugs: DataFrame) -> DataFrame:
    """d1 < d2 < d3 from an unordered drug-pair table (drug_1, drug_2, toxicity) restricted to ``drugs``.

    Two equi-joins on shared members; each triplet carries the sum of its three pair toxicities.
    """
    keep = drugs.select("drug")
    p = pair_table.select("drug_1", "drug_2", "toxicity")
    p = p.join(keep.withColumnRenamed("drug", "drug_1"), "drug_1", "left_semi").join(keep.withColumnRenamed("drug", "drug_2"), "drug_2", "left_semi")
    ab = p.select(F.col("drug_1").alias("d1"), F.col("drug_2").alias("d2"), F.col("toxicity").alias("t12"))
    bc = p.select(F.col("drug_1").alias("d2"), F.col("drug_2").alias("d3"), F.col("toxicity").alias("t23"))
    ac = p.select(F.col("drug_1").alias("d1"), F.col("drug_2").alias("d3"), F.col("toxicity").alias("t13"))
    out = ab.join(bc, "d2").join(ac, ["d1", "d3"])
    return out.select("d1", "d2", "d3", (F.col("t12") + F.col("t13") + F.col("t23")).alias("toxicity_raw"))


def triplet_scores(triplets: DataFrame, total_modules: Column | int, total_routes: Column | int = 1, weights: Mapping[str, float] = TRIPLET_WEIGHTS) -> DataFrame:
    """Module coverage, non-redundancy, escape closure and toxicity scaled by the worst triplet.

    ``triplets``: targets array (duplicates kept), modules array, routes array, toxicity_raw.
    """
    worst = triplets.agg(F.max("toxicity_raw").alias("m")).scalar()
    modules = total_modules if isinstance(total_modules, Column) else F.lit(total_modules)
    routes = total_routes if isinstance(total_routes, Column) else F.lit(total_routes)
    n = F.size("targets")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(part / whole)

    out = triplets.withColumns(
        {
            "module_coverage": share(F.size(F.array_distinct("modules")), modules),
            "non_redundancy": share(F.size(F.array_distinct("targets")), n),
            "escape_closure": share(F.size(F.array_distinct("routes")), routes),
            "toxicity": F.when(F.coalesce(worst, F.lit(0.0)) == 0, 0.0).otherwise(F.least(F.col("toxicity_raw") / worst, F.lit(1.0))),
        }
    )
    w = weights
    return out.withColumn(
        "triplet_score",
        F.lit(w["modules"]) * F.col("module_coverage") + F.lit(w["non_redundancy"]) * F.col("non_redundancy")
        + F.lit(w["escape"]) * F.col("escape_closure") - F.lit(w["toxicity"]) * F.col("toxicity"),
    )


def regimen_triplets(pair_table: DataFrame, drugs: DataFrame, targets: DataFrame, scores: DataFrame, community: DataFrame) -> DataFrame:
    """Candidate triplets with their distinct scored targets and modules."""
    rows = targets.join(entity_attributes(scores, community), "kinase_id", "inner")
    per_drug = rows.groupBy("drug").agg(F.collect_set("kinase_id").alias("k"), F.collect_set("community").alias("m"))
    out = triplets_from_pairs(pair_table, drugs)
    for i in ("1", "2", "3"):
        side = per_drug.select(F.col("drug").alias(f"d{i}"), F.col("k").alias(f"k{i}"), F.col("m").alias(f"m{i}"))
        out = out.join(side, f"d{i}", "left")
    empty = F.array().cast("array<string>")

    def union(prefix: str, none: Column) -> Column:
        return F.array_union(F.array_union(F.coalesce(f"{prefix}1", none), F.coalesce(f"{prefix}2", none)), F.coalesce(f"{prefix}3", none))

    out = out.withColumn("targets", union("k", empty)).withColumn("modules", union("m", F.array().cast("array<int>")))
    return out.where(F.size("targets") > 0).select("d1", "d2", "d3", "toxicity_raw", "targets", "modules", empty.alias("routes"))


def score_build_difference(a: DataFrame, b: DataFrame, reference: DataFrame, key: str, score: str) -> DataFrame:
    """Distance of two score builds to a reference build, and which is closer."""
    j = (
        reference.select(key, F.col(score).alias("reference_score"))
        .join(a.select(key, F.col(score).alias("score_a")), key)
        .join(b.select(key, F.col(score).alias("score_b")), key)
    )
    j = j.withColumn("diff_a", F.abs(F.col("score_a") - F.col("reference_score"))).withColumn("diff_b", F.abs(F.col("score_b") - F.col("reference_score")))
    return j.withColumn("closer", F.when(F.col("diff_a") < F.col("diff_b"), "a").when(F.col("diff_b") < F.col("diff_a"), "b").otherwise("tie"))
