"""Queries over expression, proteomics and correlation networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import expression as X
from targetloom.operators import ranking as K
from targetloom.operators.factorise import nmf
from targetloom.operators.pairs import pearson_pairs
from targetloom.operators.prefix import exact_quantiles
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, Inputs
from targetloom.session import cut_lineage

ROLE_SQL["tests"] = "SELECT CAST(c_custkey AS BIGINT) AS test_id, round(pow(abs(c_acctbal) / 10000, 3), 5) AS p_value FROM customer"
ROLE_SQL["gene_pairs_r"] = """SELECT a.gene AS item_a, b.gene AS item_b, corr(a.value, b.value) AS pearson_r, count(*) AS n_samples
    FROM expression a JOIN expression b ON a.patient_id = b.patient_id AND a.gene < b.gene GROUP BY 1, 2"""
ROLE_SQL["markers"] = """SELECT p_brand AS gene, concat('set ', CAST(CAST(substr(p_brand, 7) AS INTEGER) % 4 AS VARCHAR(20))) AS marker_set FROM part GROUP BY p_brand"""


def _long(x: Inputs) -> DataFrame:
    return x.expression.select(F.col("patient_id").alias("sample"), "gene", "value")


def _pairs(x: Inputs) -> DataFrame:
    return pearson_pairs(_long(x), "sample", "gene", "value")


@query("k01_pairwise_correlation", "SELECT item_a, item_b, round(pearson_r, 6) AS pearson_r, n_samples FROM gene_pairs_r")
def _(x: Inputs) -> DataFrame:
    return _pairs(x).select("item_a", "item_b", r6("pearson_r").alias("pearson_r"), "n_samples")


@query("k01_correlation_p_and_q")
def _(x: Inputs) -> DataFrame:
    """p-values have no SQL twin; tests compare them with published values."""
    t = X.correlation_table(_long(x))
    return t.select("item_a", "item_b", r6("pearson_r").alias("pearson_r"), "n_samples", r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))


@query("k02_correlation_network")
def _(x: Inputs) -> DataFrame:
    """Redundant and compensatory pairs at the published thresholds, beside the pairs that do not reach them."""
    table = cut_lineage(X.correlation_table(_long(x)))
    net = X.correlation_network(table).select("item_a", "item_b", "relation")
    rows = table.join(net, ["item_a", "item_b"], "left").withColumn("relation", F.coalesce("relation", F.lit("below thresholds")))
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), r6(F.max(F.abs("pearson_r"))).alias("max_weight"))


@query(
    "c10_correlation_vs_network",
    """WITH e AS (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM edges)
       SELECT item_a, item_b, round(pearson_r, 6) AS pearson_r, e.s IS NOT NULL AS known_edge FROM gene_pairs_r LEFT JOIN e ON s = item_a AND t = item_b""",
)
def _(x: Inputs) -> DataFrame:
    return X.flag_edges(_pairs(x), x.edges).select("item_a", "item_b", r6("pearson_r").alias("pearson_r"), "known_edge")


@query(
    "e14_benjamini_hochberg",
    """WITH r AS (SELECT *, rank() OVER (ORDER BY p_value DESC) AS rd FROM tests), n AS (SELECT count(*) AS n FROM tests),
       q AS (SELECT test_id, p_value, least(1.0, min(p_value * n / (n - rd + 1)) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r CROSS JOIN n)
       SELECT test_id, round(q, 6) AS q_value FROM q""",
)
def _(x: Inputs) -> DataFrame:
    return K.benjamini_hochberg(x.tests).select("test_id", r6("q_value").alias("q_value"))


@query(
    "e15_naive_fdr",
    """WITH k AS (SELECT *, row_number() OVER (ORDER BY p_value, test_id) AS rn, count(*) OVER () AS m FROM tests WHERE p_value < 0.05)
       SELECT test_id, round(max(p_value * (m / rn)) OVER (ORDER BY rn), 6) AS fdr FROM k""",
)
def _(x: Inputs) -> DataFrame:
    return K.naive_fdr(x.tests).select("test_id", r6("fdr").alias("fdr"))


@query(
    "e16_top_correlations",
    """WITH u AS (SELECT *, row_number() OVER (ORDER BY round(pearson_r, 9) DESC, item_a, item_b) AS hi, row_number() OVER (ORDER BY round(pearson_r, 9), item_a, item_b) AS lo,
                         row_number() OVER (ORDER BY abs(round(pearson_r, 9)) DESC, item_a, item_b) AS ab FROM gene_pairs_r)
       SELECT 'positive' AS kind, item_a, item_b FROM u WHERE hi <= 15 UNION ALL SELECT 'negative', item_a, item_b FROM u WHERE lo <= 15
       UNION ALL SELECT 'absolute', item_a, item_b FROM u WHERE ab <= 15""",
)
def _(x: Inputs) -> DataFrame:
    p = _pairs(x).withColumn("pearson_r", F.round("pearson_r", 9))
    out = None
    for kind in ("positive", "negative", "absolute"):
        part = X.best_pairs(p, kind).select(F.lit(kind).alias("kind"), "item_a", "item_b")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "e16_cross_class_correlations",
    """SELECT item_a, item_b, a.gene_class AS class_a, b.gene_class AS class_b, round(pearson_r, 6) AS pearson_r FROM gene_pairs_r
       JOIN gene_class a ON a.gene = item_a JOIN gene_class b ON b.gene = item_b WHERE a.gene_class <> b.gene_class""",
)
def _(x: Inputs) -> DataFrame:
    return X.cross_class_pairs(_pairs(x), x.gene_class).select("item_a", "item_b", "class_a", "class_b", r6("pearson_r").alias("pearson_r"))


@query("e16_cross_class_highlights")
def _(x: Inputs) -> DataFrame:
    """Significance has no SQL twin; the filter and its fallback are tested on planted pairs."""
    top = X.cross_class_highlights(X.correlation_table(_long(x)), x.gene_class)
    return top.select("item_a", "item_b", "class_a", "class_b", r6("pearson_r").alias("pearson_r"), r6("p_value").alias("p_value"), "significant")


@query(
    "e17_pair_rank",
    """WITH e AS (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM edges),
       f AS (SELECT g.*, e.s IS NOT NULL AS k, (SELECT max(abs(pearson_r)) FROM gene_pairs_r WHERE item_a = 'Brand#1' AND item_b = 'Brand#7') AS x
             FROM gene_pairs_r g LEFT JOIN e ON s = item_a AND t = item_b)
       SELECT CAST(sum(CASE WHEN abs(pearson_r) > x + 1e-12 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rank_all,
              CAST(sum(CASE WHEN abs(pearson_r) > x + 1e-12 AND NOT k THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rank_unmatched, round(max(x), 6) AS abs_r FROM f""",
)
def _(x: Inputs) -> DataFrame:
    p = X.flag_edges(_pairs(x).withColumn("pearson_r", F.round("pearson_r", 12)), x.edges)
    return X.pair_rank(p, "Brand#1", "Brand#7").select("rank_all", "rank_unmatched", r6("abs_r").alias("abs_r"))


@query(
    "e13_most_variable_genes",
    "SELECT gene, round(var_samp(ln(1 + value)), 6) AS variance FROM expression GROUP BY gene ORDER BY var_samp(ln(1 + value)) DESC, gene LIMIT 10",
)
def _(x: Inputs) -> DataFrame:
    return X.most_variable_genes(_long(x), 10).select("gene", r6("variance").alias("variance"))


@query(
    "b13_median_split",
    """WITH m AS (SELECT gene, quantile_cont(value, 0.5) AS med FROM expression GROUP BY gene)
       SELECT gene, CASE WHEN value > med THEN 'high' ELSE 'low' END AS expression_group, count(*) AS n, round(max(med), 6) AS median FROM expression JOIN m USING (gene) GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    split = K.median_split(_long(x), "value", ["gene"])
    med = exact_quantiles(_long(x), "value", [0.5], ["gene"]).select("gene", r6("quantile").alias("median"))
    return split.groupBy("gene", "expression_group").agg(F.count(F.lit(1)).alias("n")).join(med, "gene")


@query(
    "e18_quantile_risk_groups",
    """WITH c AS (SELECT quantile_cont(purity, 1 / 3.0::DOUBLE) AS a, quantile_cont(purity, 2 / 3.0::DOUBLE) AS b FROM clinical)
       SELECT (CASE WHEN purity >= a THEN 1 ELSE 0 END) + (CASE WHEN purity >= b THEN 1 ELSE 0 END) AS risk_group, count(*) AS n, round(min(purity), 6) AS lowest FROM clinical CROSS JOIN c GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    return K.quantile_groups(x.clinical, "purity").groupBy("risk_group").agg(F.count(F.lit(1)).alias("n"), r6(F.min("purity")).alias("lowest"))


@query(
    "b14_gene_restriction",
    """SELECT gene, count(*) AS n FROM expression WHERE gene IN (SELECT gene FROM markers WHERE marker_set = 'set 1') OR gene IN (SELECT gene FROM gene_drugs) GROUP BY gene""",
)
def _(x: Inputs) -> DataFrame:
    wanted = x.markers.where("marker_set = 'set 1'").select("gene").unionByName(x.gene_drugs.select("gene")).distinct()
    return _long(x).join(wanted, "gene", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f03_gene_list_union",
    "SELECT gene FROM markers WHERE marker_set = 'set 1' UNION SELECT gene FROM gene_drugs",
)
def _(x: Inputs) -> DataFrame:
    return x.markers.where("marker_set = 'set 1'").select("gene").unionByName(x.gene_drugs.select("gene")).distinct()


@query(
    "c15_missing_genes",
    "SELECT DISTINCT gene FROM markers WHERE gene NOT IN (SELECT gene FROM gene_drugs)",
)
def _(x: Inputs) -> DataFrame:
    return x.markers.select("gene").distinct().join(x.gene_drugs.select("gene"), "gene", "left_anti")


def _lines(features: DataFrame, col: str) -> DataFrame:
    return features.select(F.col("cell_line_id").alias("sample"), F.col("kinase_id").alias("gene"), F.col(col).alias("value"))


@query(
    "b15_prepared_matrix",
    """WITH f AS (SELECT cell_line_id, kinase_id, CASE WHEN n_lines % 29 = 0 THEN NULL ELSE dependency_prob END AS v FROM line_features),
            q AS (SELECT kinase_id AS gene FROM f GROUP BY 1 HAVING count(v) = (SELECT count(DISTINCT cell_line_id) FROM f) AND var_samp(v) > 0)
       SELECT cell_line_id AS sample, kinase_id AS gene, round(ln(1 + v), 6) AS value FROM f WHERE kinase_id IN (SELECT gene FROM q)""",
)
def _(x: Inputs) -> DataFrame:
    n = x.line_features.agg(F.countDistinct("cell_line_id").alias("n")).scalar()
    long = _lines(x.line_features.withColumn("v", F.when(F.col("n_lines") % 29 != 0, F.col("dependency_prob"))), "v")
    return X.prepared_matrix(long, n).select("sample", "gene", r6("value").alias("value"))


@query(
    "b16_drop_sparse_genes",
    """SELECT kinase_id AS gene, count(log2_cn) AS n FROM line_features GROUP BY 1 HAVING 1 - count(log2_cn) / (SELECT count(DISTINCT cell_line_id) FROM line_features) <= 0.2""",
)
def _(x: Inputs) -> DataFrame:
    n = x.line_features.agg(F.countDistinct("cell_line_id").alias("n")).scalar()
    return X.drop_sparse_genes(_lines(x.line_features, "log2_cn"), n, 0.2).groupBy("gene").agg(F.count("value").alias("n"))


@query(
    "b17_sample_columns",
    "SELECT sample, count(*) AS n FROM proteome WHERE contains(sample, 'CPT') OR (contains(sample, 'BR') AND regexp_matches(sample, '[0-9]')) GROUP BY sample",
)
def _(x: Inputs) -> DataFrame:
    return x.proteome.where(X.is_sample_column("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d19_gene_statistics",
    """SELECT gene, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
              round((1 - count(*) / (SELECT count(DISTINCT patient_id) FROM expression)) * 100, 6) AS pct_missing FROM expression GROUP BY gene""",
)
def _(x: Inputs) -> DataFrame:
    n = x.expression.agg(F.countDistinct("patient_id").alias("n")).scalar()
    return X.gene_statistics(_long(x), n).select("gene", *[r6(c).alias(c) for c in ("mean", "std", "min_value", "max_value", "pct_missing")])


@query(
    "d19_overall_statistics",
    """SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median,
              round(avg(pow(value - m, 3)) / pow(max(s), 3), 6) AS skew, round(avg(pow(value - m, 4)) / pow(max(s), 4) - 3, 6) AS kurtosis
       FROM expression CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM expression) q""",
)
def _(x: Inputs) -> DataFrame:
    out = X.overall_statistics(_long(x))
    return out.select(*[r6(c).alias(c) for c in ("mean", "std", "median", "skew", "kurtosis")])


@query(
    "d20_batch_means",
    r"""SELECT regexp_extract(sample, '^(\d+)BR', 1) AS batch, round(avg(value), 6) AS mean_value, count(DISTINCT sample) AS n_samples FROM proteome
        WHERE regexp_extract(sample, '^(\d+)BR', 1) <> '' GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    return X.batch_means(x.proteome).select("batch", r6("mean_value").alias("mean_value"), "n_samples")


_SRC = """src AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS source, cell_line_id AS sample, kinase_id AS gene, log_tpm AS value
    FROM line_features JOIN nation ON n_name = cell_line_id WHERE log_tpm IS NOT NULL AND NOT (n_nationkey % 2 = 0 AND kinase_id = 'Brand#5'))"""


def _sources(x: Inputs) -> DataFrame:
    rows = x.line_features.join(x.nation, F.col("cell_line_id") == F.col("n_name")).where("log_tpm IS NOT NULL AND NOT (n_nationkey % 2 = 0 AND kinase_id = 'Brand#5')")
    return rows.select(F.when(F.col("n_nationkey") % 2 == 0, "first").otherwise("second").alias("source"), F.col("cell_line_id").alias("sample"),
                       F.col("kinase_id").alias("gene"), F.col("log_tpm").alias("value"))


@query(
    "d21_centred_pool",
    f"""WITH {_SRC}, m AS (SELECT source, gene, avg(value) AS m FROM src GROUP BY 1, 2), sh AS (SELECT gene FROM m GROUP BY gene HAVING count(*) = 2)
        SELECT src.source, sample, src.gene, round(value - m, 6) AS value FROM src JOIN m ON m.source = src.source AND m.gene = src.gene WHERE src.gene IN (SELECT gene FROM sh)""",
)
def _(x: Inputs) -> DataFrame:
    return X.centred_pool(_sources(x)).select("source", "sample", "gene", r6("value").alias("value"))


@query(
    "d22_source_counts",
    f"WITH {_SRC} SELECT source, count(DISTINCT sample) AS n_samples, count(DISTINCT gene) AS n_genes, count(*) AS n_values FROM src GROUP BY source",
)
def _(x: Inputs) -> DataFrame:
    return _sources(x).groupBy("source").agg(F.countDistinct("sample").alias("n_samples"), F.countDistinct("gene").alias("n_genes"), F.count(F.lit(1)).alias("n_values"))


@query(
    "d23_marker_enrichment",
    """WITH st AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS s FROM expression GROUP BY gene),
            z AS (SELECT subtype AS cluster, e.gene, avg((value - m) / s) AS z FROM expression e JOIN st ON st.gene = e.gene JOIN clinical c ON c.patient_id = e.patient_id GROUP BY 1, 2),
            o AS (SELECT cluster, marker_set, avg(z) AS score FROM z JOIN markers USING (gene) GROUP BY 1, 2)
       SELECT cluster, marker_set, round(score, 6) AS score, score = max(score) OVER (PARTITION BY cluster) AS best FROM o""",
)
def _(x: Inputs) -> DataFrame:
    clusters = x.clinical.select(F.col("patient_id").alias("sample"), F.col("subtype").alias("cluster"))
    return X.marker_enrichment(_long(x), clusters, x.markers).select("cluster", "marker_set", r6("score").alias("score"), "best")


@query("d24_cluster_sizes", "SELECT CAST(label AS INTEGER) AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _(x: Inputs) -> DataFrame:
    return x.embeddings.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k16_silhouette",
    """WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n
                  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
            s AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY 1)
       SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_points FROM s""",
)
def _(x: Inputs) -> DataFrame:
    v = x.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return X.silhouette(v).select(r6("silhouette").alias("silhouette"), "n_points")


@query(
    "k18_knn_imputation",
    """WITH ids AS (SELECT DISTINCT patient_id FROM expression), g AS (SELECT DISTINCT gene FROM expression), w AS (SELECT count(*) AS width FROM g),
            holes AS (SELECT i.patient_id, g.gene FROM ids i CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM expression e WHERE e.patient_id = i.patient_id AND e.gene = g.gene)),
            d AS (SELECT a.patient_id AS p, b.patient_id AS q, round(sum((a.value - b.value) * (a.value - b.value)) * max(width) / count(*), 9) AS d2
                  FROM expression a JOIN expression b ON a.gene = b.gene AND a.patient_id <> b.patient_id CROSS JOIN w GROUP BY 1, 2),
            c AS (SELECT h.patient_id, h.gene, e.value, row_number() OVER (PARTITION BY h.patient_id, h.gene ORDER BY d2, q) AS r
                  FROM holes h JOIN expression e ON e.gene = h.gene JOIN d ON d.p = h.patient_id AND d.q = e.patient_id),
            k AS (SELECT patient_id, gene, avg(value) AS v FROM c WHERE r <= 5 GROUP BY 1, 2)
       SELECT h.patient_id AS sample, h.gene, round(coalesce(k.v, (SELECT avg(value) FROM expression e WHERE e.gene = h.gene)), 6) AS value, k.v IS NOT NULL AS from_neighbours
       FROM holes h LEFT JOIN k ON k.patient_id = h.patient_id AND k.gene = h.gene""",
)
def _(x: Inputs) -> DataFrame:
    genes = [r["gene"] for r in x.gene_class.select("gene").distinct().orderBy("gene").collect()]
    return X.knn_impute(_long(x), genes).select("sample", "gene", r6("value").alias("value"), "from_neighbours")


@query(
    "k19_conditional_log_and_z",
    """WITH v AS (SELECT l_suppkey AS gene, l_orderkey, l_linenumber, l_extendedprice * l_discount AS value FROM lineitem),
            s AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*)::DOUBLE AS n, min(value) AS lo FROM v),
            k AS (SELECT avg(pow(value - m, 3)) / pow(max(s), 3) * sqrt(max(n) * (max(n) - 1)) / (max(n) - 2) AS skew FROM v CROSS JOIN s),
            t AS (SELECT gene, CASE WHEN abs(skew) > 1 THEN log2(CASE WHEN lo <= 0 THEN value + abs(lo) + 1e-6 ELSE value END) ELSE value END AS value FROM v CROSS JOIN s CROSS JOIN k),
            g AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS s FROM t GROUP BY gene)
       SELECT t.gene, count(*) AS n, round(max((value - m) / s), 6) AS max_z, round(min((value - m) / s), 6) AS min_z, round(max(m), 6) AS mean_value FROM t JOIN g ON g.gene = t.gene GROUP BY t.gene""",
)
def _(x: Inputs) -> DataFrame:
    v = x.lineitem.select(F.col("l_suppkey").alias("gene"), (F.col("l_extendedprice") * F.col("l_discount")).alias("value"))
    t = X.log2_if_skewed(v)
    z = X.z_scores(t)
    return z.groupBy("gene").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("z")).alias("max_z"), r6(F.min("z")).alias("min_z"), r6(F.avg("value")).alias("mean_value")
    )


@query("k15_nmf_clusters")
def _(x: Inputs) -> DataFrame:
    """Iterative; planted groups are checked in the tests."""
    v = x.embeddings.select(F.col("vec_id").cast("string").alias("sample"), F.posexplode("embedding").alias("i", "e"))
    long = v.select("sample", F.col("i").cast("string").alias("gene"), F.abs(F.col("e").cast("double")).alias("value"))
    w, _h, _loss = nmf(long, 4)
    return X.nmf_clusters(w, 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("k17_subtype_run")
def _(x: Inputs) -> DataFrame:
    """Iterative; a brand that a patient never bought has no row and counts as zero.  All three gene selections."""
    long = cut_lineage(_long(x))
    runs = [X.subtype_run(long, x.markers, mode, absent="zero")["enrichment"].withColumn("mode", F.lit(mode)) for mode in ("marker_only", "highly_variable", "all")]
    return reduce(DataFrame.unionByName, runs).select("mode", "cluster", "marker_set", r6("score").alias("score"), "best")
