"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import graph as G
from targetloom.operators import robustness as B
from targetloom.operators import scoring as S
from targetloom.plans.registry import query
from targetloom.plans.robustness_queries import NULLS, null_b
from targetloom.plans.roles import ROLE_SQL, Inputs

ROLE_SQL["signed_links"] = """SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS source, concat('p', CAST(l_partkey AS VARCHAR(20))) AS target,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"""
ROLE_SQL["evidence_rows"] = """SELECT p_brand AS source, concat('Brand#', CAST(1 + l_suppkey % 25 AS VARCHAR(20))) AS target,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount - 0.05 END AS e1, l_tax AS e2, l_extendedprice / 100 AS score FROM lineitem JOIN part ON l_partkey = p_partkey"""
_ENDS = "SELECT source AS v, weight FROM graph_edges UNION ALL SELECT target, weight FROM graph_edges"


@query(
    "g01_weighted_degree",
    f"SELECT v, count(*) AS n_neighbours, round(sum(weight), 6) AS degree FROM ({_ENDS}) e GROUP BY v",
)
def _(x: Inputs) -> DataFrame:
    return G.strength(x.graph_edges).select("v", "n_neighbours", r6("degree").alias("degree"))


def _rank_sql(rounds: int) -> str:
    steps = [f"""both_w AS (SELECT source AS u, target AS v, weight AS w FROM graph_edges UNION ALL SELECT target, source, weight FROM graph_edges),
        dg AS (SELECT u, sum(w) AS k FROM both_w GROUP BY u), nn AS (SELECT count(*) AS n FROM dg),
        r0 AS (SELECT u AS v, 1.0::DOUBLE / (SELECT n FROM nn) AS r FROM dg)"""]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT b.v, 0.15::DOUBLE / (SELECT n FROM nn) + 0.85::DOUBLE * sum(p.r * b.w / dg.k) AS r
            FROM both_w b JOIN dg ON dg.u = b.u JOIN r{i - 1} p ON p.v = b.u GROUP BY b.v)""")
    return "WITH " + ", ".join(steps) + f" SELECT v, round(r * 1000, 6) AS pagerank_milli FROM r{rounds}"


@query("g02_pagerank", _rank_sql(10))
def _(x: Inputs) -> DataFrame:
    return G.page_rank(x.graph_edges, rounds=10, tol=None).select("v", r6(F.col("pagerank") * 1000).alias("pagerank_milli"))


@query("g03_betweenness")
def _(x: Inputs) -> DataFrame:
    """Checked against graphs with known values in the tests."""
    return G.betweenness(x.panel_graph).select("v", r6("betweenness").alias("betweenness"))


@query("g04_louvain_communities")
def _(x: Inputs) -> DataFrame:
    return G.louvain(x.edges)


def _label_sql(role: str, rounds: int = 16) -> str:
    """Check text of components: ``rounds`` steps of the smallest label, enough while no component is wider than that."""
    steps = [f"""b AS MATERIALIZED (SELECT source AS u, target AS v FROM {role} UNION SELECT target, source FROM {role}),
        c0 AS MATERIALIZED (SELECT DISTINCT u AS v, u AS c FROM b)"""]
    for i in range(1, rounds + 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT o.v, least(o.c, min(n.c)) AS c FROM c{i - 1} o JOIN b ON b.u = o.v JOIN c{i - 1} n ON n.v = b.v GROUP BY o.v, o.c)")
    return "WITH " + ", ".join(steps) + f", r AS (SELECT v, c FROM c{rounds})"


@query("g05_connected_components", f"{_label_sql('graph_edges')} SELECT v, c AS component FROM r")
def _(x: Inputs) -> DataFrame:
    return G.connected_components(x.graph_edges)


@query(
    "d33_graph_summary",
    f"""{_label_sql('signed_links')}, n AS (SELECT count(*) AS n, count(DISTINCT c) AS k FROM r)
       SELECT (SELECT n FROM n) AS n_nodes, count(*) AS n_edges, round(2 * count(*) / (SELECT n FROM n), 6) AS mean_degree,
              round(2 * count(*) / ((SELECT n FROM n) * ((SELECT n FROM n) - 1)), 6) AS density, (SELECT k FROM n) AS n_components,
              CAST(sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN weight < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative FROM signed_links""",
)
def _(x: Inputs) -> DataFrame:
    out = G.graph_summary(x.signed_links)
    return out.select("n_nodes", "n_edges", r6("mean_degree").alias("mean_degree"), r6("density").alias("density"), "n_components", "n_positive", "n_negative")


@query("g06_rewired_degrees")
def _(x: Inputs) -> DataFrame:
    """Degree change per replicate; 0 everywhere is the invariant the tests assert."""
    reps = B.trial_ids(x.spark, NULLS, "replicate")
    out = G.rewired(x.edges, reps)
    ends = out.select("replicate", F.explode(F.array("source", "target")).alias("v")).groupBy("replicate", "v").agg(F.count(F.lit(1)).alias("k"))
    true = G.strength(x.edges).select("v", "n_neighbours")
    return ends.join(true, "v").groupBy("replicate").agg(F.sum(F.abs(F.col("k") - F.col("n_neighbours"))).alias("degree_change"), F.count(F.lit(1)).alias("n_vertices"))


@query("i06_null_rewired_network")
def _(x: Inputs) -> DataFrame:
    return null_b(x).select("replicate", r6("null_score").alias("null_score"))


_ADJ = """adj0 AS (SELECT least(source, target) AS s, greatest(source, target) AS t, max((coalesce(abs(e1), 0.0) + coalesce(abs(e2), 0.0)) / ((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT)) AS w
    FROM evidence_rows WHERE score >= 700 AND source <> target GROUP BY 1, 2), adj AS (SELECT s, t, w / (SELECT max(w) FROM adj0) AS w FROM adj0)"""


@query("g07_adjacency", f"WITH {_ADJ} SELECT s AS source, t AS target, round(w, 6) AS weight FROM adj")
def _(x: Inputs) -> DataFrame:
    return G.adjacency(x.evidence_rows, ["e1", "e2"], "score").select("source", "target", r6("weight").alias("weight"))


@query(
    "g08_normalised_adjacency",
    f"""WITH {_ADJ}, f AS (SELECT s AS u, t AS v, w FROM adj UNION ALL SELECT t, s, w FROM adj UNION ALL SELECT v, v, 1.0 FROM (SELECT s AS v FROM adj UNION SELECT t FROM adj) q),
        k AS (SELECT u, sum(w) AS k FROM f GROUP BY u) SELECT f.u, f.v, round(w / sqrt(a.k * b.k), 6) AS w FROM f JOIN k a ON a.u = f.u JOIN k b ON b.u = f.v""",
)
def _(x: Inputs) -> DataFrame:
    adj = G.adjacency(x.evidence_rows, ["e1", "e2"], "score")
    return G.normalised_adjacency(adj).select("u", "v", r6("w").alias("w"))


@query(
    "g09_robust_scaled_features",
    """WITH f AS (SELECT kinase_id, betweenness, chembl_count FROM part_metrics),
       q AS (SELECT quantile_cont(betweenness, 0.25) AS b1, quantile_cont(betweenness, 0.5) AS b2, quantile_cont(betweenness, 0.75) AS b3,
                    quantile_cont(chembl_count, 0.25) AS c1, quantile_cont(chembl_count, 0.5) AS c2, quantile_cont(chembl_count, 0.75) AS c3 FROM f)
       SELECT kinase_id, round(coalesce((betweenness - b2) / CASE WHEN b3 - b1 > 0 THEN b3 - b1 ELSE 1 END, 0.0), 6) AS betweenness,
              round(coalesce((chembl_count - c2) / CASE WHEN c3 - c1 > 0 THEN c3 - c1 ELSE 1 END, 0.0), 6) AS chembl_count FROM f CROSS JOIN q""",
)
def _(x: Inputs) -> DataFrame:
    out = G.robust_scaled(x.part_metrics.select("kinase_id", "betweenness", "chembl_count"), ["betweenness", "chembl_count"])
    return out.select("kinase_id", r6("betweenness").alias("betweenness"), r6("chembl_count").alias("chembl_count"))


@query(
    "a13_network_edges",
    """SELECT least(source, target) AS a, greatest(source, target) AS b, round(max(score), 6) AS weight FROM evidence_rows
       WHERE source IN (SELECT kinase_id FROM panel_scores) AND target IN (SELECT kinase_id FROM panel_scores) AND source <> target GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    panel = x.panel_scores.select(F.col("kinase_id").alias("gene"))
    out = G.restricted_edges(x.evidence_rows.select("source", "target", F.col("score").alias("weight")), panel)
    return out.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), r6("weight").alias("weight"))
