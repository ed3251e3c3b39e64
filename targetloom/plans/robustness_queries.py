"""Queries over ranking statistics and the robustness suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import graph as G
from targetloom.operators import ranking as K
from targetloom.operators import robustness as B
from targetloom.operators import scoring as S
from targetloom.operators.permutation import GRID_SQL, KEYS_SQL, PLACE_SQL
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, SPARK_ROLES, Inputs
from targetloom.plans.scoring_queries import _MODELS_SQL, dual_best
from targetloom.session import cut_lineage

TRIALS, SEED, NULLS = 1000, 42, 1000
_PAIR = "round(0.35 * s1 + 0.35 * s2 + 0.20 * comp + 0.10 * {x}, 9)"
_U = "((CAST(concat('0x', substr(md5(concat_ws('|', '{seed}', {keys})), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

ROLE_SQL["pair_base"] = f"SELECT k1, k2, comp, xtalk, xtalk2, s1, s2, {_PAIR.format(x='xtalk')} AS score FROM panel_pairs"
ROLE_SQL["entity_base"] = """SELECT kinase_id, centrality_norm, essentiality_norm, survival_norm, druggability_norm,
    round(0.30 * centrality_norm + 0.25 * essentiality_norm + 0.25 * survival_norm + 0.20 * druggability_norm, 9) AS score FROM panel_terms"""
ROLE_SQL["pair_base2"] = f"SELECT k1, k2, comp, xtalk, xtalk2, s1, s2, {_PAIR.format(x='xtalk2')} AS score FROM panel_pairs"
SPARK_ROLES["pair_base2"] = lambda x: x.panel_pairs.withColumn("score", F.round(S.pair_expression(S.PAIR_WEIGHTS, "s1", "s2", "comp", "xtalk2"), 9))
SPARK_ROLES["pair_base"] = lambda x: x.panel_pairs.withColumn("score", F.round(S.pair_expression(S.PAIR_WEIGHTS, "s1", "s2", "comp", "xtalk"), 9))
SPARK_ROLES["entity_base"] = lambda x: x.panel_terms.withColumn("score", F.round("target_score", 9)).select(
    "kinase_id", "centrality_norm", "essentiality_norm", "survival_norm", "druggability_norm", "score"
)

_TARGET_TERMS = list(S.TARGET_WEIGHTS)
_PAIR_TERMS = list(S.PAIR_WEIGHTS)


def _entity_score() -> F.Column:
    return S.weighted_terms({t: F.col(f"w_{t}") for t in _TARGET_TERMS})


def _pair_score(cross: str = "xtalk") -> F.Column:
    return S.pair_expression({t: F.col(f"w_{t}") for t in _PAIR_TERMS}, "s1", "s2", "comp", cross)


_ENTITY_SQL = "round(w_centrality * centrality_norm + w_essentiality * essentiality_norm + w_survival * survival_norm + w_druggability * druggability_norm, 9)"
_PAIR_SQL = "round(w_alpha * s1 + w_beta * s2 + w_gamma * comp + w_delta * {x}, 9)"


def _weights_cte(scenarios: list[tuple[str, dict[str, float]]]) -> str:
    rows = ", ".join("('" + n + "', " + ", ".join(f"{v!r}::DOUBLE" for v in w.values()) + ")" for n, w in scenarios)
    cols = ", ".join(f"w_{k}" for k in scenarios[0][1])
    return f"scn AS (SELECT * FROM (VALUES {rows}) AS t(scenario, {cols}))"


def _one_at_a_time(weights: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    return [(f"{t}{f:+.2f}", K.normalised({**weights, t: weights[t] * (1 + f)})) for t in weights for f in (-0.25, 0.25)]


def _left_out(weights: dict[str, float], terms: list[str]) -> list[tuple[str, dict[str, float]]]:
    out = []
    for t in terms:
        rest = K.normalised({k: v for k, v in weights.items() if k != t})
        out.append((t, {k: rest.get(k, 0.0) for k in weights}))
    return out


def _compare_cte(base: str, keys: list[str], score: str, by: str) -> str:
    k = ", ".join(keys)
    return f"""sc AS (SELECT {by}, {k}, {score} AS score FROM {base}_rows),
        tr AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score DESC) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS rk,
                      row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {k}) AS ps FROM sc),
        br AS (SELECT {k}, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS brk,
                      row_number() OVER (ORDER BY score DESC, {k}) AS bps FROM {base})
        SELECT {by}, round(corr(rk, brk), 6) AS spearman_rho,
               round(CAST(sum(CASE WHEN ps <= 10 AND bps <= 10 THEN 1 ELSE 0 END) AS DOUBLE) / 10, 6) AS top10_overlap,
               round(CAST(sum(CASE WHEN ps <= 20 AND bps <= 20 THEN 1 ELSE 0 END) AS DOUBLE) / 20, 6) AS top20_overlap
        FROM tr JOIN br USING ({k}) GROUP BY {by}"""


def _rounded(df: DataFrame, by: str) -> DataFrame:
    return df.select(by, *[r6(c).alias(c) for c in ("spearman_rho", "top10_overlap", "top20_overlap")])


def _register_scenarios(name: str, base: str, keys: list[str], scenarios: list, array, score_sql: str, score, cross: str | None = None) -> None:
    rows = f"{base}_rows AS (SELECT b.*, scn.* FROM {base} b CROSS JOIN scn)"
    sql = f"WITH {_weights_cte(scenarios)}, {rows}, " + _compare_cte(base, keys, score_sql, "scenario")

    @query(name, sql)
    def run(x: Inputs) -> DataFrame:
        b = cut_lineage(x.view(base))
        trials = B.apply_scenarios(b.drop("score"), array(), score()).select("scenario", *keys, "score")
        return _rounded(K.compare_scenarios(b.select(*keys, "score"), trials, keys, ["scenario"]), "scenario")


_register_scenarios("i02_entity_weight_perturbation", "entity_base", ["kinase_id"], _one_at_a_time(S.TARGET_WEIGHTS),
                    lambda: B.perturbation_scenarios(S.TARGET_WEIGHTS), _ENTITY_SQL, _entity_score)
_register_scenarios("i02_pair_weight_perturbation", "pair_base", ["k1", "k2"], _one_at_a_time(S.PAIR_WEIGHTS),
                    lambda: B.perturbation_scenarios(S.PAIR_WEIGHTS), _PAIR_SQL.format(x="xtalk"), _pair_score)
_register_scenarios("i04_entity_ablation", "entity_base", ["kinase_id"], _left_out(S.TARGET_WEIGHTS, _TARGET_TERMS),
                    lambda: B.ablation_scenarios(S.TARGET_WEIGHTS), _ENTITY_SQL, _entity_score)
_register_scenarios("i04_pair_ablation", "pair_base", ["k1", "k2"], _left_out(S.PAIR_WEIGHTS, _PAIR_TERMS),
                    lambda: B.ablation_scenarios(S.PAIR_WEIGHTS), _PAIR_SQL.format(x="xtalk"), _pair_score)
_register_scenarios("i12_second_network_ablation", "pair_base2", ["k1", "k2"], _left_out(S.PAIR_WEIGHTS, ["gamma", "delta"]),
                    lambda: B.ablation_scenarios(S.PAIR_WEIGHTS, ["gamma", "delta"]), _PAIR_SQL.format(x="xtalk2"), lambda: _pair_score("xtalk2"))


def _dirichlet_cte(terms: list[str], seed: int = SEED) -> str:
    def g(t: str) -> str:
        logs = " + ".join("ln(" + _U.format(seed=seed, keys=f"CAST(trial AS VARCHAR), '{t}{i}'") + ")" for i in range(5))
        return f"-({logs}) AS g_{t}"

    total = " + ".join(f"g_{t}" for t in terms)
    return (
        f"gam AS (SELECT CAST(range AS INTEGER) AS trial, {', '.join(g(t).replace('CAST(trial', 'CAST(range') for t in terms)} FROM range({TRIALS})), "
        f"scn AS (SELECT trial, {', '.join(f'round(g_{t} / ({total}), 9) AS w_{t}' for t in terms)} FROM gam)"
    )


def _register_draws(name: str, base: str, keys: list[str], terms: list[str], score_sql: str, score, stability: str | None) -> None:
    rows = f"{base}_rows AS (SELECT b.*, scn.* FROM {base} b CROSS JOIN scn)"
    head = f"WITH {_dirichlet_cte(terms)}, {rows}, "

    def trials(x: Inputs, b: DataFrame) -> DataFrame:
        draws = B.dirichlet_weights(x.spark, terms, TRIALS, SEED)
        return B.score_trials(b.drop("score"), draws, score(), keys)

    @query(name, head + _compare_cte(base, keys, score_sql, "trial"))
    def run(x: Inputs) -> DataFrame:
        b = cut_lineage(x.view(base))
        return _rounded(K.compare_scenarios(b.select(*keys, "score"), trials(x, b), keys, ["trial"]), "trial")

    if stability:
        k = ", ".join(keys)
        join = " AND ".join(f"t.{c} = b.{c}" for c in keys)

        @query(
            stability,
            head + f"""sc AS (SELECT trial, {k}, {score_sql} AS score FROM {base}_rows),
            t AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score DESC, {k}) AS ps FROM sc)
            SELECT {', '.join(f'b.{c}' for c in keys)}, count(t.trial) AS times_in_top FROM {base} b LEFT JOIN t ON {join} AND ps <= 10 GROUP BY ALL""",
        )
        def stable(x: Inputs) -> DataFrame:
            b = cut_lineage(x.view(base))
            return K.times_in_top(trials(x, b), keys, ["trial"], 10, b)


_register_draws("i03_entity_weight_draws", "entity_base", ["kinase_id"], _TARGET_TERMS, _ENTITY_SQL, _entity_score, "d26_entity_stability")
_register_draws("i03_pair_weight_draws", "pair_base", ["k1", "k2"], _PAIR_TERMS, _PAIR_SQL.format(x="xtalk"), _pair_score, "i11_pair_stability")
_register_draws("i12_second_network_draws", "pair_base2", ["k1", "k2"], _PAIR_TERMS, _PAIR_SQL.format(x="xtalk2"), lambda: _pair_score("xtalk2"), None)


@query(
    "i01_normalised_weights",
    """WITH w AS (SELECT kinase_id, target_score AS w FROM panel_scores) SELECT kinase_id, round(w / (SELECT sum(w) FROM w), 6) AS weight FROM w""",
)
def _(x: Inputs) -> DataFrame:
    total = x.panel_scores.agg(F.sum("target_score").alias("t")).scalar()
    return x.panel_scores.select("kinase_id", r6(F.col("target_score") / total).alias("weight"))


def _pair_of(cross: str) -> F.Column:
    return F.round(S.pair_expression(S.PAIR_WEIGHTS, "s1", "s2", "comp", cross), 9)


_REPS = f"reps AS (SELECT CAST(range AS INTEGER) AS replicate, {KEYS_SQL.format(parts=f"'{SEED}', CAST(range AS VARCHAR)")} AS ks FROM range({NULLS}))"
_DOM = f"dom AS {GRID_SQL.format(base='base')}"
_NULL_A = f"""{_REPS}, base AS (SELECT kinase_id, target_score, row_number() OVER (ORDER BY kinase_id) - 1 AS place FROM panel_scores),
    {_DOM}, d AS (SELECT replicate, kinase_id, {PLACE_SQL} AS dst FROM base CROSS JOIN reps CROSS JOIN dom),
    perm AS (SELECT d.replicate, d.kinase_id, b.target_score FROM d JOIN base b ON b.place = d.dst),
    null_a AS (SELECT p.replicate, max(round(0.35 * p.target_score + 0.35 * q.target_score + 0.20 * comp + 0.10 * xtalk, 9)) AS null_score
               FROM panel_pairs JOIN perm p ON p.kinase_id = k1 JOIN perm q ON q.kinase_id = k2 AND q.replicate = p.replicate GROUP BY 1)"""
_NULL_B2 = """{reps}, base AS (SELECT {s} AS source, {t} AS target, {w} AS weight, row_number() OVER (ORDER BY {s}, {t}) - 1 AS place FROM {e}),
    {dom}, d AS (SELECT replicate, source, target, {dst} AS dst FROM base CROSS JOIN reps CROSS JOIN dom),
    perm AS (SELECT d.replicate, least(d.source, d.target) AS a, greatest(d.source, d.target) AS b, bb.weight FROM d JOIN base bb ON bb.place = d.dst),
    null_b AS (SELECT r.replicate, max(round(0.35 * s1 + 0.35 * s2 + 0.20 * comp + 0.10 * coalesce(perm.weight, 0.0), 9)) AS null_score
               FROM panel_pairs CROSS JOIN reps r LEFT JOIN perm ON perm.replicate = r.replicate AND a = k1 AND b = k2 GROUP BY 1)"""


def _null_b_sql(edges: str, s: str, t: str, w: str) -> str:
    return _NULL_B2.format(reps=_REPS, e=edges, s=s, t=t, w=w, dom=_DOM, dst=PLACE_SQL)


def _reps(x: Inputs) -> DataFrame:
    return B.trial_ids(x.spark, NULLS, "replicate")


def null_a(x: Inputs) -> DataFrame:
    perm = B.permuted_column(x.panel_scores, "target_score", ["kinase_id"], _reps(x), SEED)
    return B.best_pair_per_replicate(x.panel_pairs, perm, _pair_of("xtalk"))


def null_b_prime(x: Inputs, second: bool) -> DataFrame:
    edges = x.edges2.select(F.col("gene1").alias("source"), F.col("gene2").alias("target"), F.col("score").alias("weight")) if second else x.edges
    perm = B.permuted_column(edges, "weight", ["source", "target"], _reps(x), SEED)
    return B.best_pair_with_shuffled_edges(x.panel_pairs, perm, _pair_of("xtalk"))


def null_b(x: Inputs) -> DataFrame:
    edges = G.rewired(x.edges, _reps(x))
    return B.best_pair_with_rewired_edges(x.panel_pairs, edges, _pair_of("xtalk"))


@query("i05_null_shuffled_scores", f"WITH {_NULL_A} SELECT replicate, round(null_score, 6) AS null_score FROM null_a")
def _(x: Inputs) -> DataFrame:
    return null_a(x).select("replicate", r6("null_score").alias("null_score"))


@query("i07_null_shuffled_edges", f"WITH {_null_b_sql('edges', 'source', 'target', 'weight')} SELECT replicate, round(null_score, 6) AS null_score FROM null_b")
def _(x: Inputs) -> DataFrame:
    return null_b_prime(x, False).select("replicate", r6("null_score").alias("null_score"))


@query("i12_second_network_null", f"WITH {_null_b_sql('edges2', 'gene1', 'gene2', 'score')} SELECT replicate, round(null_score, 6) AS null_score FROM null_b")
def _(x: Inputs) -> DataFrame:
    return null_b_prime(x, True).select("replicate", r6("null_score").alias("null_score"))


_NULL_C = f"""{_REPS}, base AS (SELECT drug, ord, kinase_id, row_number() OVER (ORDER BY drug, ord, kinase_id) - 1 AS place FROM drug_targets),
    {_DOM}, d AS (SELECT replicate, drug, ord, {PLACE_SQL} AS dst FROM base CROSS JOIN reps CROSS JOIN dom),
    asg AS (SELECT DISTINCT d.replicate, d.drug, b.kinase_id FROM d JOIN base b ON b.place = d.dst),
    ps AS (SELECT a.kinase_id AS ki, b.kinase_id AS kj, round(0.35 * coalesce(sa.target_score, 0.0) + 0.35 * coalesce(sb.target_score, 0.0)
               + 0.20 * (CASE WHEN ca.community <> cb.community THEN 1.0 ELSE 0.0 END) + 0.10 * coalesce(e.w, 0.0), 9) AS score
           FROM (SELECT DISTINCT kinase_id FROM drug_targets) a CROSS JOIN (SELECT DISTINCT kinase_id FROM drug_targets) b
           LEFT JOIN panel_scores sa ON sa.kinase_id = a.kinase_id LEFT JOIN panel_scores sb ON sb.kinase_id = b.kinase_id
           LEFT JOIN community ca ON ca.kinase_id = a.kinase_id LEFT JOIN community cb ON cb.kinase_id = b.kinase_id
           LEFT JOIN edges_both e ON e.a = a.kinase_id AND e.b = b.kinase_id),
    null_c AS (SELECT p.replicate, max(score) AS null_score FROM asg p JOIN asg q ON q.replicate = p.replicate AND p.drug < q.drug
               JOIN ps ON ki = p.kinase_id AND kj = q.kinase_id GROUP BY 1)"""


def null_c(x: Inputs) -> DataFrame:
    perm = B.permuted_column(x.drug_targets.select("drug", "ord", "kinase_id", F.col("kinase_id").alias("held")), "held", ["drug", "ord", "kinase_id"], _reps(x), SEED)
    perm = perm.select("replicate", "drug", F.col("held").alias("kinase_id"))
    return B.best_drug_pair_per_replicate(perm.select("replicate", "drug", "kinase_id"), target_pair_scores(x))


def target_pair_scores(x: Inputs) -> DataFrame:
    """(k1 <= k2, score) of all entities that drugs hold, an entity with itself included."""
    ids = x.drug_targets.select("kinase_id").distinct()
    scores = ids.join(x.panel_scores, "kinase_id", "left").fillna(0.0, ["target_score"])
    pairs = S.entity_pairs(scores, x.community, x.edges).select("k1", "k2", _pair_of("xtalk").alias("score"))
    selfs = scores.select(F.col("kinase_id").alias("k1"), F.col("kinase_id").alias("k2"), F.round(0.35 * F.col("target_score") + 0.35 * F.col("target_score"), 9).alias("score"))
    return pairs.unionByName(selfs)


@query("i08_null_shuffled_targets", f"WITH {_NULL_C} SELECT replicate, round(null_score, 6) AS null_score FROM null_c")
def _(x: Inputs) -> DataFrame:
    return null_c(x).select("replicate", r6("null_score").alias("null_score"))


_EMP = """count(*) AS n, round(max(obs), 6) AS observed, round(avg(null_score), 6) AS null_mean, round(stddev_pop(null_score), 6) AS null_sd,
    round((max(obs) - avg(null_score)) / nullif(stddev_samp(null_score), 0), 6) AS z, round((sum(CASE WHEN null_score >= obs THEN 1 ELSE 0 END) + 1) / (count(*) + 1), 6) AS empirical_p"""


@query(
    "i09_null_summary",
    f"""WITH {_NULL_A}, o AS (SELECT max({_PAIR.format(x='xtalk')}) AS obs FROM panel_pairs),
        b2 AS (WITH {_null_b_sql('edges', 'source', 'target', 'weight')} SELECT * FROM null_b), c2 AS (WITH {_NULL_C} SELECT * FROM null_c),
        oc AS (WITH {_NULL_C} SELECT max(score) AS obs FROM drug_targets p JOIN drug_targets q ON p.drug < q.drug JOIN ps ON ki = p.kinase_id AND kj = q.kinase_id)
        SELECT 'shuffled scores' AS null_model, {_EMP} FROM null_a CROSS JOIN o UNION ALL SELECT 'shuffled edge weights', {_EMP} FROM b2 CROSS JOIN o
        UNION ALL SELECT 'shuffled targets', {_EMP} FROM c2 CROSS JOIN oc""",
)
def _(x: Inputs) -> DataFrame:
    """D25 empirical p and Z of the null models that SQL can draw as well; the rewired network is in the next query."""
    real = x.drug_targets.select(F.lit(0).alias("replicate"), "drug", "kinase_id")
    observed_c = B.best_drug_pair_per_replicate(real, target_pair_scores(x)).select("null_score").scalar()
    obs = x.pair_base.agg(F.max("score").alias("o")).scalar()
    parts = [("shuffled scores", null_a(x), obs), ("shuffled edge weights", null_b_prime(x, False), obs), ("shuffled targets", null_c(x), observed_c)]
    out = None
    for name, null, observed in parts:
        part = _empirical(null, observed, name)
        out = part if out is None else out.unionByName(part)
    return out


def _empirical(null: DataFrame, observed: F.Column, name: str) -> DataFrame:
    out = K.empirical_p_z(null, observed)
    return out.select(F.lit(name).alias("null_model"), "n", *[r6(c).alias(c) for c in ("observed", "null_mean", "null_sd", "z", "empirical_p")])


@query("i09_null_summary_rewired")
def _(x: Inputs) -> DataFrame:
    """Empirical p and Z against degree-preserving rewired networks (null B)."""
    obs = x.pair_base.agg(F.max("score").alias("o")).scalar()
    return _empirical(null_b(x), obs, "rewired network")


@query(
    "i10_panel_exclusion",
    f"""WITH keep AS (SELECT * FROM pair_base WHERE k1 NOT IN ('Brand#2', 'Brand#3') AND k2 NOT IN ('Brand#2', 'Brand#3')),
        r AS (SELECT k1, k2, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk, row_number() OVER (ORDER BY score DESC, k1, k2) AS ps FROM keep),
        b AS (SELECT k1, k2, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS brk, row_number() OVER (ORDER BY score DESC, k1, k2) AS bps FROM pair_base)
        SELECT round(corr(rk, brk), 6) AS spearman_rho, count(*) AS n_pairs, round(CAST(sum(CASE WHEN ps <= 20 AND bps <= 20 THEN 1 ELSE 0 END) AS DOUBLE) / 20, 6) AS top20_overlap FROM r JOIN b USING (k1, k2)""",
)
def _(x: Inputs) -> DataFrame:
    """Drop two entities, recompute, compare on the pairs left."""
    gone = ["Brand#2", "Brand#3"]
    scores = x.panel_scores.where(~F.col("kinase_id").isin(gone))
    kept = S.entity_pairs(scores, x.community, x.edges).withColumn("score", _pair_of("xtalk"))
    trial = kept.select(F.lit("excluded").alias("scenario"), "k1", "k2", "score")
    cmp = K.compare_scenarios(x.pair_base.select("k1", "k2", "score"), trial, ["k1", "k2"], ["scenario"], (20,))
    return cmp.select(r6("spearman_rho").alias("spearman_rho"), kept.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_pairs"), r6("top20_overlap").alias("top20_overlap"))


_DUAL_SCORED = f"""{_MODELS_SQL}, sc AS (SELECT model, d.drug_1, d.drug_2, ki, kj, round(base_score - 0.30 * coalesce(t.toxicity, 0.0), 9) AS score
    FROM dual d LEFT JOIN toxicity t ON t.drug_1 = d.drug_1 AND t.drug_2 = d.drug_2),
    rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score DESC) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r,
                  row_number() OVER (PARTITION BY model ORDER BY score DESC, drug_1, drug_2) AS ps FROM sc),
    a AS (SELECT * FROM rk WHERE model = 'first_network'), b AS (SELECT * FROM rk WHERE model = 'second_network'), c AS (SELECT * FROM rk WHERE model = 'combined')"""


def scored_models(x: Inputs) -> DataFrame:
    # every caller reads the three rankings several times
    scored = S.drug_pair_scores(dual_best(x), x.toxicity)
    return cut_lineage(scored.select("model", "drug_1", "drug_2", "ki", "kj", F.round("drug_pair_score", 9).alias("score")))


_PK = ["drug_1", "drug_2"]


@query(
    "c12_three_model_merge",
    f"WITH {_DUAL_SCORED} SELECT drug_1, drug_2, round(a.r, 6) AS rank_1, round(b.r, 6) AS rank_2, round(c.r, 6) AS rank_3 FROM a JOIN b USING (drug_1, drug_2) JOIN c USING (drug_1, drug_2)",
)
def _(x: Inputs) -> DataFrame:
    """Average-tie ranks (E8) of the three models, merged on the drug pair."""
    from targetloom.operators.prefix import average_ranks

    ranked = average_ranks(scored_models(x), "score", by=["model"], out="r", descending=True)
    models = list(S.NETWORK_MODELS)
    return ranked.groupBy(*_PK).agg(*[r6(F.max(F.when(F.col("model") == m, F.col("r")))).alias(f"rank_{i}") for i, m in enumerate(models, 1)])


@query(
    "e09_model_spearman",
    f"""WITH {_DUAL_SCORED} SELECT 'first vs second' AS compared, round(corr(a.r, b.r), 6) AS spearman_rho FROM a JOIN b USING (drug_1, drug_2)
        UNION ALL SELECT 'first vs combined', round(corr(a.r, c.r), 6) FROM a JOIN c USING (drug_1, drug_2)""",
)
def _(x: Inputs) -> DataFrame:
    from targetloom.operators.prefix import average_ranks

    r = average_ranks(scored_models(x), "score", by=["model"], out="r", descending=True)
    wide = r.groupBy(*_PK).agg(*[F.max(F.when(F.col("model") == m, F.col("r"))).alias(m) for m in S.NETWORK_MODELS])
    both = wide.agg(F.corr("first_network", "second_network").alias("a"), F.corr("first_network", "combined").alias("b"))
    return both.select(F.explode(F.array(
        F.struct(F.lit("first vs second").alias("compared"), r6("a").alias("spearman_rho")),
        F.struct(F.lit("first vs combined").alias("compared"), r6("b").alias("spearman_rho")),
    )).alias("r")).select("r.*")


@query(
    "e10_top_k_overlap",
    f"""WITH {_DUAL_SCORED}, n AS (SELECT count(*) AS n FROM a JOIN b USING (drug_1, drug_2) WHERE a.ps <= 20 AND b.ps <= 20)
        SELECT round(n / 20, 6) AS overlap, round(n / (40 - n), 6) AS jaccard FROM n""",
)
def _(x: Inputs) -> DataFrame:
    m = scored_models(x)
    out = K.top_k_overlap(m.where("model = 'first_network'"), m.where("model = 'second_network'"), "score", _PK, 20)
    return out.select(r6("overlap").alias("overlap"), r6("jaccard").alias("jaccard"))


@query(
    "e11_rank_shift",
    f"""WITH {_DUAL_SCORED}, s AS (SELECT abs(a.r - b.r) AS shift FROM a JOIN b USING (drug_1, drug_2))
        SELECT round(quantile_cont(shift, 0.5), 6) AS median_shift, round(avg(CASE WHEN shift > 50 THEN 1.0 ELSE 0.0 END), 6) AS share_moved, round(max(shift), 6) AS max_shift FROM s""",
)
def _(x: Inputs) -> DataFrame:
    m = scored_models(x)
    out = K.rank_shift(m.where("model = 'first_network'"), m.where("model = 'second_network'"), _PK, "score")
    return out.select(*[r6(c).alias(c) for c in ("median_shift", "share_moved", "max_shift")])


@query(
    "f04_top20_newcomers",
    f"WITH {_DUAL_SCORED} SELECT drug_1, drug_2 FROM b WHERE ps <= 20 EXCEPT SELECT drug_1, drug_2 FROM a WHERE ps <= 20",
)
def _(x: Inputs) -> DataFrame:
    m = scored_models(x)
    return K.newcomers(m.where("model = 'first_network'"), m.where("model = 'second_network'"), "score", _PK)


@query(
    "d27_winner_concentration",
    f"""WITH {_DUAL_SCORED}, e AS (SELECT model, ki AS k FROM sc UNION ALL SELECT model, kj FROM sc), n AS (SELECT model, k, count(*) AS n FROM e GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, k) AS ps FROM n)
        SELECT model, round(CAST(sum(CASE WHEN ps <= 1 THEN n ELSE 0 END) / sum(n) AS DOUBLE), 6) AS top1_share, round(CAST(sum(CASE WHEN ps <= 5 THEN n ELSE 0 END) / sum(n) AS DOUBLE), 6) AS top5_share FROM p GROUP BY model""",
)
def _(x: Inputs) -> DataFrame:
    out = K.winner_concentration(scored_models(x), ["model"])
    return out.select("model", r6("top1_share").alias("top1_share"), r6("top5_share").alias("top5_share"))


@query(
    "d28_score_distribution",
    f"""WITH {_DUAL_SCORED}, t AS (SELECT model, sum(c) AS tied FROM (SELECT model, score, count(*) AS c FROM rk WHERE ps <= 20 GROUP BY 1, 2) q WHERE c > 1 GROUP BY model)
        SELECT sc.model, count(*) AS n, count(DISTINCT score) AS distinct_scores, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(score), 6) AS mean_score,
               CAST(coalesce(max(tied), 0) AS BIGINT) AS tied_in_top FROM sc LEFT JOIN t ON t.model = sc.model GROUP BY sc.model""",
)
def _(x: Inputs) -> DataFrame:
    out = K.score_summary(scored_models(x), "score", ["model"], _PK)
    return out.select("model", "n", "distinct_scores", *[r6(c).alias(c) for c in ("max_score", "min_score", "mean_score")], "tied_in_top")


@query(
    "f02_edge_set_overlap",
    """WITH a AS (SELECT least(source, target) AS s, greatest(source, target) AS t FROM edges), b AS (SELECT least(gene1, gene2) AS s, greatest(gene1, gene2) AS t FROM edges2 WHERE score >= 0.7)
       SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (s, t)) AS shared,
              (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) u) AS union_size,
              round((SELECT count(*) FROM a JOIN b USING (s, t)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) u), 6) AS jaccard""",
)
def _(x: Inputs) -> DataFrame:
    a = x.edges.select(F.col("source").alias("s"), F.col("target").alias("t"))
    b = x.edges2.where("score >= 0.7").select(F.col("gene1").alias("s"), F.col("gene2").alias("t"))
    out = K.edge_set_overlap(a, b)
    return out.select("n_a", "n_b", "shared", "union_size", r6("jaccard").alias("jaccard"))


@query(
    "e12_focal_pair_ranks",
    """WITH me AS (SELECT source, target, weight FROM edges WHERE NOT EXISTS (SELECT 1 FROM edges2 g WHERE g.score >= 0.8 AND g.gene1 = edges.source AND g.gene2 = edges.target)
                   UNION ALL SELECT gene1, gene2, score FROM edges2 WHERE score >= 0.8),
            lk AS (SELECT a, b, min_by(w, p) AS w FROM (SELECT source AS a, target AS b, weight AS w, 0 AS p FROM me UNION ALL SELECT target, source, weight, 1 FROM me) q GROUP BY a, b),
            sc AS (SELECT drug_1, drug_2, max(0.35 * si + 0.35 * sj + 0.20 * comp + 0.10 * xtalk) AS s0, max(0.35 * si + 0.35 * sj + 0.20 * comp + 0.10 * coalesce(lk.w, 0.0)) AS s1
                   FROM target_rows LEFT JOIN lk ON lk.a = ki AND lk.b = kj GROUP BY 1, 2),
            r AS (SELECT sc.drug_1, sc.drug_2, round(s0 - 0.30 * coalesce(t.toxicity, 0.0), 9) AS s0, round(s1 - 0.30 * coalesce(t.toxicity, 0.0), 9) AS s1 FROM sc LEFT JOIN toxicity t ON t.drug_1 = sc.drug_1 AND t.drug_2 = sc.drug_2),
            p AS (SELECT *, row_number() OVER (ORDER BY s0 DESC, drug_1, drug_2) AS r0, row_number() OVER (ORDER BY s1 DESC, drug_1, drug_2) AS r1 FROM r)
       SELECT drug_1, drug_2, r0 AS rank_without, r1 AS rank_with, r0 - r1 AS rank_change FROM p WHERE (drug_1, drug_2) IN (('blue anvil', 'red bolt'), ('cold rod', 'old gear'), ('hot ring', 'small plate'))""",
)
def _(x: Inputs) -> DataFrame:
    """Rank of named pairs with and without the second network merged in; names match in either order."""
    extra = x.edges2.where("score >= 0.8").select(F.col("gene1").alias("source"), F.col("gene2").alias("target"), F.col("score").alias("weight"))
    focal = [("red bolt", "blue anvil"), ("cold rod", "old gear"), ("small plate", "hot ring")]
    expr = S.pair_expression(S.PAIR_WEIGHTS, "si", "sj", "comp", "xtalk")

    def ranked(edges: DataFrame) -> DataFrame:
        rows = S.target_pair_rows(x.drug_targets, x.panel_scores, x.community, edges)
        return S.drug_pair_scores(S.best_target_pairs(rows, expr), x.toxicity).select("drug_1", "drug_2", F.round("drug_pair_score", 9).alias("score"))

    def focal_rank(df: DataFrame, out: str) -> DataFrame:
        wanted = None
        for a, b in focal:
            hit = (F.col("drug_1") == min(a, b)) & (F.col("drug_2") == max(a, b))
            wanted = hit if wanted is None else wanted | hit
        f = df.where(wanted).select(F.struct("score", "drug_1", "drug_2").alias("f"))
        packed = f.agg(F.collect_list("f").alias("l")).scalar()
        rows = df.select("score", "drug_1", "drug_2", F.explode(packed).alias("f"))
        ahead = (F.col("score") > F.col("f.score")) | ((F.col("score") == F.col("f.score")) & (F.struct("drug_1", "drug_2") < F.struct("f.drug_1", "f.drug_2")))
        return rows.groupBy("f.drug_1", "f.drug_2").agg((F.count_if(ahead) + 1).alias(out))

    a, b = focal_rank(ranked(x.edges), "rank_without"), focal_rank(ranked(K.merged_edges(x.edges, extra)), "rank_with")
    return a.join(b, ["drug_1", "drug_2"]).withColumn("rank_change", F.col("rank_without") - F.col("rank_with"))
