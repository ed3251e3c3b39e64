"""Queries over the scoring operators: target scores, pair rankings, triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.functions.text import JUNK_PHRASES
from targetloom.operators import scoring as S
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, Inputs
from targetloom.session import cut_lineage

TERMS = ("centrality_norm", "essentiality_norm", "survival_norm", "druggability_norm")
_TERM_SQL = ", ".join(f"round({t}, 6) AS {t}" for t in TERMS)
_SCORE_SQL = "round(0.30 * centrality_norm + 0.25 * essentiality_norm + 0.25 * survival_norm + 0.20 * druggability_norm, 6) AS target_score"


@query("d01_target_score_parts", f"SELECT kinase_id, {_TERM_SQL}, {_SCORE_SQL} FROM part_terms")
def _(x: Inputs) -> DataFrame:
    return S.target_score(x.part_metrics).select("kinase_id", *[r6(t).alias(t) for t in TERMS], r6("target_score").alias("target_score"))


@query("d01_target_score_panel", f"SELECT kinase_id, {_TERM_SQL}, {_SCORE_SQL} FROM panel_terms")
def _(x: Inputs) -> DataFrame:
    return S.target_score(x.panel_metrics).select("kinase_id", *[r6(t).alias(t) for t in TERMS], r6("target_score").alias("target_score"))


@query(
    "c04_symmetric_edge_lookup",
    "SELECT k1, k2, round(xtalk, 6) AS first_network, round(xtalk2, 6) AS second_network FROM panel_pairs",
)
def _(x: Inputs) -> DataFrame:
    return x.panel_pairs.select("k1", "k2", r6("xtalk").alias("first_network"), r6("xtalk2").alias("second_network"))


@query(
    "c05_panel_pair_scores",
    "SELECT k1, k2, round(comp, 6) AS comp, round(0.35 * s1 + 0.35 * s2 + 0.20 * comp + 0.10 * xtalk, 6) AS pair_score FROM panel_pairs",
)
def _(x: Inputs) -> DataFrame:
    """Unordered pair enumeration with complementarity (H1) and the additive pair score (H2)."""
    score = S.pair_expression(S.PAIR_WEIGHTS, "s1", "s2", "comp", "xtalk")
    return x.panel_pairs.select("k1", "k2", r6("comp").alias("comp"), r6(score).alias("pair_score"))


@query(
    "c06_target_pair_expansion",
    """SELECT drug_1, drug_2, count(*) AS n_target_pairs, CAST(sum(CASE WHEN xtalk > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_linked,
              round(avg(0.35 * si + 0.35 * sj + 0.20 * comp + 0.10 * xtalk), 6) AS mean_score
       FROM target_rows GROUP BY drug_1, drug_2""",
)
def _(x: Inputs) -> DataFrame:
    score = S.pair_expression(S.PAIR_WEIGHTS, "si", "sj", "comp", "xtalk")
    return x.target_rows.groupBy("drug_1", "drug_2").agg(
        F.count(F.lit(1)).alias("n_target_pairs"), F.count_if(F.col("xtalk") > 0).alias("n_linked"), r6(F.avg(score)).alias("mean_score")
    )


@query(
    "d02_drug_score_simple",
    """SELECT drug, round(sum(coalesce(target_score, 0.0)), 6) AS drug_score
       FROM drug_targets LEFT JOIN panel_scores USING (kinase_id) GROUP BY drug""",
)
def _(x: Inputs) -> DataFrame:
    return S.drug_score_simple(x.drug_targets, x.panel_scores).select("drug", r6("drug_score").alias("drug_score"))


@query(
    "d03_drug_score_refined",
    """WITH tox AS (SELECT drug, count(*) / 1000 AS toxicity FROM reactions GROUP BY drug)
       SELECT d.drug, n_targets, round(weighted - 0.1 * greatest(n_targets - 1, 0) - coalesce(toxicity, 0.0) + 0.0, 6) AS drug_score
       FROM (SELECT drug, count(*) AS n_targets, sum(coalesce(target_score, 0.0) * potency * selectivity) AS weighted
             FROM drug_targets LEFT JOIN panel_scores USING (kinase_id) GROUP BY drug) d LEFT JOIN tox ON tox.drug = d.drug""",
)
def _(x: Inputs) -> DataFrame:
    tox = x.reactions.groupBy("drug").agg((F.count(F.lit(1)) / 1000).alias("toxicity"))
    return S.drug_score_refined(x.drug_targets, x.panel_scores, tox).select("drug", "n_targets", r6("drug_score").alias("drug_score"))


@query(
    "d06_best_target_pair",
    "SELECT drug_1, drug_2, ki, kj, round(base_score, 6) AS base_score FROM drug_pair_best",
)
def _(x: Inputs) -> DataFrame:
    return x.drug_pair_best.select("drug_1", "drug_2", "ki", "kj", r6("base_score").alias("base_score"))


@query(
    "d07_winner_frequency",
    "SELECT least(ki, kj) AS w1, greatest(ki, kj) AS w2, count(*) AS winner_frequency FROM drug_pair_best GROUP BY 1, 2",
)
def _(x: Inputs) -> DataFrame:
    return S.winner_frequency(x.drug_pair_best).select("w1", "w2", "winner_frequency").distinct()


@query(
    "d08_reaction_jaccard",
    "SELECT drug_1, drug_2, CAST(shared AS BIGINT) AS shared, round(toxicity, 6) AS toxicity FROM toxicity",
)
def _(x: Inputs) -> DataFrame:
    return x.toxicity.select("drug_1", "drug_2", "shared", r6("toxicity").alias("toxicity"))


_REPORTS_SQL = """SELECT DISTINCT l_orderkey AS report_id, p_name AS drug FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'"""


@query(
    "d09_co_report_ratio",
    f"""WITH r AS ({_REPORTS_SQL}), s AS (SELECT drug, count(*) AS n FROM r GROUP BY drug),
        co AS (SELECT a.drug AS x, b.drug AS y, count(*) AS n FROM r a JOIN r b ON a.report_id = b.report_id AND a.drug < b.drug GROUP BY 1, 2)
        SELECT a.drug AS drug_1, b.drug AS drug_2, CAST(coalesce(co.n, 0) AS BIGINT) AS co,
               round(coalesce(co.n, 0) / greatest(least(a.n, b.n), 1), 6) AS ratio
        FROM s a JOIN s b ON a.drug < b.drug LEFT JOIN co ON co.x = a.drug AND co.y = b.drug""",
)
def _(x: Inputs) -> DataFrame:
    reports = x.lineitem.where("l_returnflag = 'R'").join(x.part, F.col("l_partkey") == F.col("p_partkey"))
    reports = reports.select(F.col("l_orderkey").alias("report_id"), F.col("p_name").alias("drug"))
    return S.co_report_ratio(reports).select("drug_1", "drug_2", "co", r6("ratio").alias("ratio"))


@query(
    "d04_druggability_aggregates",
    """SELECT kinase_id, round(avg(interaction_score), 6) AS mean_score, count(DISTINCT lower(drug)) AS distinct_drugs
       FROM interactions GROUP BY kinase_id""",
)
def _(x: Inputs) -> DataFrame:
    return x.interactions.groupBy("kinase_id").agg(
        r6(F.avg("interaction_score")).alias("mean_score"), F.countDistinct(F.lower("drug")).alias("distinct_drugs")
    )


_JUNK = JUNK_PHRASES[0]
# every ninth part's drug name is a junk phrase, and each source lacks some of the panel
ROLE_SQL["landed_interactions"] = f"""
    SELECT p_brand AS kinase_id, CASE WHEN p_size % 9 = 4 THEN '{_JUNK}' ELSE p_name END AS drug, CAST(p_retailprice AS DOUBLE) AS interaction_score
    FROM part WHERE p_brand <> 'Brand#21'"""
ROLE_SQL["essentiality_table"] = """
    SELECT p_brand AS kinase_id, round(-avg(l_discount), 9) AS mean_depmap_score FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE CAST(substr(p_brand, 7) AS INTEGER) % 7 <> 3 GROUP BY p_brand"""
ROLE_SQL["survival_table"] = """
    SELECT p_brand AS kinase_id, round(0.5 + avg(p_size) / 50, 9) AS cox_hr, round(avg(p_size) / 51, 9) AS logrank_p
    FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 5 <> 1 GROUP BY p_brand"""
ROLE_SQL["centrality_table"] = """
    SELECT p_brand AS kinase_id, CAST(sum(l_quantity) AS DOUBLE) AS betweenness, CAST(count(*) AS DOUBLE) AS pagerank, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS degree
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(substr(p_brand, 7) AS INTEGER) % 11 <> 0 GROUP BY p_brand"""


@query(
    "c01_entity_assembly",
    f"""WITH panel AS (SELECT DISTINCT p_brand AS kinase_id FROM part),
        drugs AS (SELECT kinase_id, avg(interaction_score) AS m, count(DISTINCT drug) AS n FROM landed_interactions WHERE drug <> '{_JUNK}' GROUP BY kinase_id)
        SELECT panel.kinase_id, mean_depmap_score AS depmap_score, cox_hr, logrank_p, betweenness, pagerank, degree, round(m, 6) AS dgidb_score, CAST(n AS DOUBLE) AS dgidb_score_count
        FROM panel LEFT JOIN essentiality_table USING (kinase_id) LEFT JOIN survival_table USING (kinase_id) LEFT JOIN centrality_table USING (kinase_id)
        LEFT JOIN drugs USING (kinase_id)""",
)
def _(x: Inputs) -> DataFrame:
    panel = x.part.select(F.col("p_brand").alias("kinase_id"))
    out = S.assemble_entities(panel, x.essentiality_table, x.survival_table, x.centrality_table, x.landed_interactions)
    return out.withColumn("dgidb_score", r6("dgidb_score")).withColumn("dgidb_score_count", F.col("dgidb_score_count").cast("double"))


_BUILD_SQL = "round(0.30 * centrality_norm + 0.25 * essentiality_norm + 0.25 * survival_norm + 0.20 * {d}, 9)"


@query(
    "d05_score_build_check",
    """WITH i AS (SELECT kinase_id, avg(interaction_score) AS m, count(DISTINCT lower(drug)) AS n FROM interactions GROUP BY kinase_id),
       b AS (SELECT t.kinase_id, 0.30 * centrality_norm + 0.25 * essentiality_norm + 0.25 * survival_norm AS rest, druggability_norm,
                    (m - (SELECT min(m) FROM i)) / ((SELECT max(m) FROM i) - (SELECT min(m) FROM i)) AS da,
                    (n - (SELECT min(n) FROM i)) / ((SELECT max(n) FROM i) - (SELECT min(n) FROM i)) AS db
             FROM panel_terms t JOIN i USING (kinase_id)),
       d AS (SELECT kinase_id, abs(round(rest + 0.20 * da, 9) - round(rest + 0.20 * druggability_norm, 9)) AS diff_a,
                    abs(round(rest + 0.20 * db, 9) - round(rest + 0.20 * druggability_norm, 9)) AS diff_b FROM b)
       SELECT CASE WHEN diff_a < diff_b THEN 'a' WHEN diff_b < diff_a THEN 'b' ELSE 'tie' END AS closer, count(*) AS n,
              round(avg(diff_a), 6) AS mean_a, round(max(diff_a), 6) AS max_a, round(avg(diff_b), 6) AS mean_b, round(max(diff_b), 6) AS max_b
       FROM d GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    """Two ways to aggregate drug evidence, each compared with the reference build."""
    agg = x.interactions.groupBy("kinase_id").agg(F.avg("interaction_score").alias("m"), F.countDistinct(F.lower("drug")).alias("n"))
    agg = S.with_min_max(agg, {"m": F.col("m"), "n": F.col("n")}).select("kinase_id", F.col("m_unit").alias("a"), F.col("n_unit").alias("b"))
    base = x.panel_terms.join(agg, "kinase_id")
    w = S.TARGET_WEIGHTS

    def build(col: str) -> DataFrame:
        alt = base.drop("target_score").withColumn("druggability_norm", F.col(col))
        return alt.select("kinase_id", F.round(S.weighted_terms(w), 9).alias("target_score"))

    diff = S.score_build_difference(build("a"), build("b"), build("druggability_norm"), "kinase_id", "target_score")
    return diff.groupBy("closer").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("diff_a")).alias("mean_a"), r6(F.max("diff_a")).alias("max_a"),
        r6(F.avg("diff_b")).alias("mean_b"), r6(F.max("diff_b")).alias("max_b"),
    )


@query(
    "e01_rank_all_pairs",
    """SELECT b.drug_1, b.drug_2, round(base_score - 0.30 * coalesce(t.toxicity, 0.0), 6) AS drug_pair_score
       FROM drug_pair_best b LEFT JOIN toxicity t ON t.drug_1 = b.drug_1 AND t.drug_2 = b.drug_2""",
)
def _(x: Inputs) -> DataFrame:
    ranked = S.drug_pair_scores(x.drug_pair_best, x.toxicity)
    return ranked.select("drug_1", "drug_2", r6("drug_pair_score").alias("drug_pair_score")).orderBy(F.desc("drug_pair_score"), "drug_1", "drug_2")


@query(
    "h03_drug_pair_score_with_synergy",
    """WITH syn AS (SELECT drug_1, drug_2, 1 - toxicity AS synergy FROM toxicity WHERE shared > 0)
       SELECT b.drug_1, b.drug_2, round(base_score - 0.30 * coalesce(t.toxicity, 0.0) + 0.30 * coalesce(s.synergy, 0.0), 6) AS drug_pair_score
       FROM drug_pair_best b LEFT JOIN toxicity t ON t.drug_1 = b.drug_1 AND t.drug_2 = b.drug_2
       LEFT JOIN syn s ON s.drug_1 = b.drug_1 AND s.drug_2 = b.drug_2""",
)
def _(x: Inputs) -> DataFrame:
    synergy = x.toxicity.where("shared > 0").select("drug_1", "drug_2", (1 - F.col("toxicity")).alias("synergy"))
    out = S.drug_pair_scores(x.drug_pair_best, x.toxicity, synergy)
    return out.select("drug_1", "drug_2", r6("drug_pair_score").alias("drug_pair_score"))


@query(
    "e02_redundancy_penalised_pairs",
    """SELECT drug_1, drug_2, concat(w1, '|', w2) AS winner, CAST(winner_frequency AS BIGINT) AS winner_frequency,
              round(drug_pair_score, 6) AS drug_pair_score FROM drug_pair_ranked""",
)
def _(x: Inputs) -> DataFrame:
    """Flagship ranking: scan, aggregate, pair expansion, arg-max, winner frequency, toxicity."""
    return x.drug_pair_ranked.select(
        "drug_1", "drug_2", F.concat_ws("|", "w1", "w2").alias("winner"), "winner_frequency", r6("drug_pair_score").alias("drug_pair_score")
    ).orderBy(F.desc("drug_pair_score"), "drug_1", "drug_2")


@query(
    "d29_score_decomposition",
    """SELECT drug_1, drug_2, round(base_score, 6) AS base_score, round(penalty, 6) AS penalty, round(adjusted_base, 6) AS adjusted_base,
              round(toxicity, 6) AS toxicity, round(drug_pair_score, 6) AS final_score,
              CASE WHEN drug_pair_score >= 0 THEN 'not negative' WHEN adjusted_base = 0 THEN 'floored base and toxicity' ELSE 'toxicity' END AS cause
       FROM drug_pair_ranked""",
)
def _(x: Inputs) -> DataFrame:
    cause = F.when(F.col("drug_pair_score") >= 0, "not negative").when(F.col("adjusted_base") == 0, "floored base and toxicity").otherwise("toxicity")
    cols = ("base_score", "penalty", "adjusted_base", "toxicity")
    return x.drug_pair_ranked.select(
        "drug_1", "drug_2", *[r6(c).alias(c) for c in cols], r6("drug_pair_score").alias("final_score"), cause.alias("cause")
    )


@query(
    "d29_negative_share",
    """SELECT count(*) AS n_pairs, round(avg(CASE WHEN drug_pair_score < 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_negative,
              round(avg(CASE WHEN adjusted_base = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_floored FROM drug_pair_ranked""",
)
def _(x: Inputs) -> DataFrame:
    return x.drug_pair_ranked.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        r6(F.avg((F.col("drug_pair_score") < 0).cast("double")) * 100).alias("pct_negative"),
        r6(F.avg((F.col("adjusted_base") == 0).cast("double")) * 100).alias("pct_floored"),
    )


_MODELS_SQL = """models(model, d1, d2) AS (SELECT 'first_network', 0.10, 0.0 UNION ALL SELECT 'second_network', 0.0, 0.10 UNION ALL SELECT 'combined', 0.05, 0.05),
    dual AS (SELECT model, drug_1, drug_2, base_score, ki, kj FROM (
        SELECT *, row_number() OVER (PARTITION BY model, drug_1, drug_2 ORDER BY base_score DESC, ord_i, ord_j) AS rn
        FROM (SELECT *, 0.35 * si + 0.35 * sj + 0.20 * comp + CAST(d1 AS DOUBLE) * xtalk + CAST(d2 AS DOUBLE) * xtalk2 AS base_score FROM target_rows CROSS JOIN models) s) r WHERE rn = 1)"""


def dual_best(x: Inputs) -> DataFrame:
    """All three weight models in one pass: each target-pair row carries an array of model weights."""
    rows = S.target_pair_rows(x.drug_targets, x.panel_scores, x.community, x.edges, x.edges2)
    models = F.array(*[
        F.struct(F.lit(name).alias("model"), *[F.lit(float(v)).alias(k) for k, v in w.items()]) for name, w in S.NETWORK_MODELS.items()
    ])
    rows = rows.withColumn("m", F.explode(models)).withColumn("model", F.col("m.model"))
    weights = {k: F.col(f"m.{k}") for k in ("alpha", "beta", "gamma", "delta", "delta2")}
    return S.best_target_pairs(rows, S.pair_expression(weights, "si", "sj", "comp", "xtalk", "xtalk2"), by=["model"])


@query(
    "e03_dual_network_pairs",
    f"""WITH {_MODELS_SQL}
        SELECT model, d.drug_1, d.drug_2, round(base_score - 0.30 * coalesce(t.toxicity, 0.0), 6) AS drug_pair_score
        FROM dual d LEFT JOIN toxicity t ON t.drug_1 = d.drug_1 AND t.drug_2 = d.drug_2""",
)
def _(x: Inputs) -> DataFrame:
    out = S.drug_pair_scores(dual_best(x), x.toxicity)
    return out.select("model", "drug_1", "drug_2", r6("drug_pair_score").alias("drug_pair_score"))


@query(
    "e04_dual_network_penalised",
    f"""WITH {_MODELS_SQL}, f AS (SELECT model, least(ki, kj) AS w1, greatest(ki, kj) AS w2, count(*) AS n FROM dual GROUP BY 1, 2, 3)
        SELECT d.model, d.drug_1, d.drug_2, concat(w1, '|', w2) AS winner, n AS winner_frequency,
               round(greatest(base_score - 0.15 * greatest(n - 1, 0), 0.0) - 0.30 * coalesce(t.toxicity, 0.0), 6) AS drug_pair_score
        FROM dual d JOIN f ON f.model = d.model AND w1 = least(ki, kj) AND w2 = greatest(ki, kj)
        LEFT JOIN toxicity t ON t.drug_1 = d.drug_1 AND t.drug_2 = d.drug_2""",
)
def _(x: Inputs) -> DataFrame:
    out = S.redundancy_penalised(dual_best(x), x.toxicity, by=["model"])
    return out.select(
        "model", "drug_1", "drug_2", F.concat_ws("|", "w1", "w2").alias("winner"), "winner_frequency", r6("drug_pair_score").alias("drug_pair_score")
    )


@query(
    "e05_primary_target_pairs",
    """WITH pt AS (SELECT drug, kinase_id FROM (
           SELECT drug, kinase_id, row_number() OVER (PARTITION BY drug ORDER BY target_score DESC, ord) AS rn
           FROM drug_targets JOIN panel_scores USING (kinase_id)) q WHERE rn = 1)
       SELECT r.drug_1, r.drug_2, r.ki, r.kj,
              round(0.35 * si + 0.35 * sj + 0.20 * comp + 0.10 * xtalk - 0.30 * coalesce(t.toxicity, 0.0), 6) AS drug_pair_score
       FROM target_rows r JOIN pt a ON a.drug = r.drug_1 AND a.kinase_id = r.ki JOIN pt b ON b.drug = r.drug_2 AND b.kinase_id = r.kj
       LEFT JOIN toxicity t ON t.drug_1 = r.drug_1 AND t.drug_2 = r.drug_2""",
)
def _(x: Inputs) -> DataFrame:
    rows = S.target_pair_rows(S.primary_targets(x.drug_targets, x.panel_scores), x.panel_scores, x.community, x.edges)
    best = S.best_target_pairs(rows, S.pair_expression(S.PAIR_WEIGHTS, "si", "sj", "comp", "xtalk"))
    out = S.drug_pair_scores(best, x.toxicity)
    return out.select("drug_1", "drug_2", "ki", "kj", r6("drug_pair_score").alias("drug_pair_score"))


@query(
    "e06_top_drugs",
    """SELECT drug, round(max(target_score), 6) AS best_target_score FROM drug_targets JOIN panel_scores USING (kinase_id)
       GROUP BY drug ORDER BY max(target_score) DESC, drug LIMIT 60""",
)
def _(x: Inputs) -> DataFrame:
    return S.top_drugs(x.drug_targets, x.panel_scores, 60).select("drug", r6("best_target_score").alias("best_target_score"))


@query(
    "e07_triplet_scores",
    """WITH top30 AS (SELECT drug_1, drug_2 FROM drug_pair_ranked ORDER BY round(drug_pair_score, 9) DESC, drug_1, drug_2 LIMIT 30),
       ds AS (SELECT drug_1 AS drug FROM top30 UNION SELECT drug_2 FROM top30),
       tr AS (SELECT a.drug AS d1, b.drug AS d2, c.drug AS d3 FROM ds a JOIN ds b ON a.drug < b.drug JOIN ds c ON b.drug < c.drug),
       tg AS (SELECT d1, d2, d3, count(DISTINCT dt.kinase_id) AS n_t, count(DISTINCT c.community) AS n_m
              FROM tr JOIN drug_targets dt ON dt.drug IN (d1, d2, d3) JOIN panel_scores s ON s.kinase_id = dt.kinase_id
              LEFT JOIN community c ON c.kinase_id = dt.kinase_id GROUP BY d1, d2, d3),
       sc AS (SELECT tg.*, coalesce(x.toxicity, 0.0) + coalesce(y.toxicity, 0.0) + coalesce(z.toxicity, 0.0) AS tox FROM tg
              LEFT JOIN toxicity x ON x.drug_1 = d1 AND x.drug_2 = d2 LEFT JOIN toxicity y ON y.drug_1 = d1 AND y.drug_2 = d3
              LEFT JOIN toxicity z ON z.drug_1 = d2 AND z.drug_2 = d3)
       SELECT concat(d1, ' + ', d2, ' + ', d3) AS drugs, n_t AS n_targets,
              round(n_m / (SELECT count(DISTINCT community) FROM community), 6) AS module_coverage,
              round(0.30 * (n_m / (SELECT count(DISTINCT community) FROM community)) + 0.25 - 0.15 * (tox / (SELECT max(tox) FROM sc)), 6) AS triplet_score
       FROM sc""",
)
def _(x: Inputs) -> DataFrame:
    """Triplets of the drugs in the 30 best pairs (H4), scored (H5) and ranked (E7)."""
    # the ranking feeds four joins below: compute it once
    ranked = cut_lineage(x.drug_pair_ranked.select("drug_1", "drug_2", "toxicity", "drug_pair_score"))
    top = ranked.orderBy(F.desc(F.round("drug_pair_score", 9)), "drug_1", "drug_2").limit(30).select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    trip = S.regimen_triplets(ranked, top, x.drug_targets, x.panel_scores, x.community)
    modules = x.community.agg(F.countDistinct("community").alias("n")).scalar()
    out = S.triplet_scores(trip, modules)
    return out.select(
        F.concat_ws(" + ", "d1", "d2", "d3").alias("drugs"), F.size("targets").cast("long").alias("n_targets"),
        r6("module_coverage").alias("module_coverage"), r6("triplet_score").alias("triplet_score"),
    )
