"""Queries over landed-file parsers and input checks.

The text forms (delimited lines, JSON payloads, wide matrices) are spelled from the tables by Spark, then parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.numeric import r6
from targetloom.operators import quality as Q
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, Inputs
from targetloom.session import cut_lineage
from targetloom.sources import landed as A
from targetloom.sources import sinks

ROLE_SQL["star_rows"] = """SELECT concat('file_', CAST(o_orderkey % 997 AS VARCHAR(20)), '.tsv') AS file_name, CASE WHEN l_linenumber = 7 THEN 'N_unmapped' ELSE 'ENSG' END AS gene_id,
    p_brand AS gene_name, CASE WHEN l_quantity = 13 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)) END AS tpm_unstranded
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
_STAR = "sv AS (SELECT file_name, gene_name AS gene, max(TRY_CAST(tpm_unstranded AS DOUBLE)) AS value FROM star_rows WHERE gene_id NOT LIKE 'N\\_%' ESCAPE '\\' GROUP BY 1, 2)"
_SHEET = "sheet AS (SELECT DISTINCT concat('file_', CAST(o_orderkey % 997 AS VARCHAR), '.tsv') AS file_name, concat('case-', CAST(o_orderkey % 997 % 300 AS VARCHAR)) AS patient_id FROM orders WHERE o_orderkey % 997 <> 5)"


def _sheet(x: Inputs) -> DataFrame:
    k = F.col("o_orderkey") % 997
    raw = x.orders.where(k != 5).select(F.concat(F.lit("file_"), k.cast("string"), F.lit(".tsv")).alias("File Name"), F.concat(F.lit("case-"), (k % 300).cast("string")).alias("Case ID"))
    return A.sample_sheet(raw)


@query("a03_star_count_values", f"WITH {_STAR} SELECT file_name, gene, round(value, 6) AS value FROM sv")
def _(x: Inputs) -> DataFrame:
    return A.star_values(x.star_rows, "tpm_unstranded").select("file_name", "gene", r6("value").alias("value"))


@query(
    "a04_expression_matrix",
    f"WITH {_STAR}, {_SHEET} SELECT patient_id, gene, round(avg(value), 6) AS value FROM sv JOIN sheet USING (file_name) WHERE gene IN (SELECT gene FROM gene_drugs) GROUP BY 1, 2",
)
def _(x: Inputs) -> DataFrame:
    """A4 and A19: restricted to the genes, several files of a patient averaged."""
    out = A.expression_matrix(A.star_values(x.star_rows, "tpm_unstranded"), _sheet(x), x.gene_drugs)
    return out.select("patient_id", "gene", r6("value").alias("value"))


@query("a04_unmapped_files", f"WITH {_STAR}, {_SHEET} SELECT DISTINCT file_name FROM sv WHERE file_name NOT IN (SELECT file_name FROM sheet)")
def _(x: Inputs) -> DataFrame:
    return A.unmapped_files(A.star_values(x.star_rows, "tpm_unstranded"), _sheet(x))


@query(
    "a23_track_expression",
    f"WITH {_STAR}, need AS (SELECT gene FROM markers UNION SELECT gene FROM gene_drugs UNION SELECT 'Brand#99') SELECT gene FROM need WHERE gene NOT IN (SELECT gene FROM sv WHERE value IS NOT NULL)",
)
def _(x: Inputs) -> DataFrame:
    extra = x.region.limit(1).select(F.lit("Brand#99").alias("gene"))
    need = x.markers.select("gene").unionByName(x.gene_drugs.select("gene")).unionByName(extra).distinct()
    return A.genes_without_values(need, A.star_values(x.star_rows, "tpm_unstranded"))


@query("a21_mutations_with_gene_filter", "SELECT Hugo_Symbol AS gene, count(*) AS n FROM maf WHERE Hugo_Symbol IN (SELECT gene FROM gene_drugs) GROUP BY 1")
def _(x: Inputs) -> DataFrame:
    return x.maf.withColumnRenamed("Hugo_Symbol", "gene").join(x.gene_drugs.select("gene"), "gene", "left_semi").groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a06_maf_round_trip",
    "SELECT Variant_Classification, count(*) AS n, count(DISTINCT Tumor_Sample_Barcode) AS n_barcodes FROM maf GROUP BY 1",
)
def _(x: Inputs) -> DataFrame:
    """Written as delimited text files into the checkpoint folder and scanned back (A1, A6, F6)."""
    import uuid

    from targetloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(x.spark)
    path = f"{x.spark.sparkContext.getCheckpointDir()}/maf-{uuid.uuid4().hex}"
    sinks.write_table(x.maf.select("Hugo_Symbol", "Variant_Classification", "Tumor_Sample_Barcode"), path, "tsv")
    return A.read_maf(x.spark, path).groupBy("Variant_Classification").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Tumor_Sample_Barcode").alias("n_barcodes"))


@query(
    "a11_interaction_payload",
    """SELECT p_brand AS kinase_id, lower(p_name) AS drug, concat('c', CAST(p_partkey AS VARCHAR)) AS drug_concept_id, round(p_retailprice / 100, 6) AS interaction_score,
              CASE WHEN p_size % 2 = 0 THEN 'inhibitor,blocker' ELSE 'inhibitor' END AS interaction_types, concat('A', CAST(p_size AS VARCHAR)) AS sources FROM part""",
)
def _(x: Inputs) -> DataFrame:
    inhibitor = F.struct(F.lit("inhibitor").alias("type"))
    blocker = F.struct(F.lit("blocker").alias("type"))
    i = F.struct(
        F.struct(F.lower("p_name").alias("name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("conceptId")).alias("drug"),
        (F.col("p_retailprice") / 100).alias("interactionScore"), F.when(F.col("p_size") % 2 == 0, F.array(inhibitor, blocker)).otherwise(F.array(inhibitor)).alias("interactionTypes"),
        F.array(F.struct(F.concat(F.lit("A"), F.col("p_size").cast("string")).alias("fullName"))).alias("sources"),
    )
    node = F.struct(F.col("p_brand").alias("name"), F.array(i).alias("interactions"))
    payload = F.to_json(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("genes")).alias("data")))
    return A.parse_interaction_payload(x.part.select(payload.alias("payload"))).withColumn("interaction_score", r6("interaction_score"))


@query(
    "a12_activity_pages",
    """SELECT CAST(l_suppkey AS BIGINT) AS page, l_returnflag AS standard_type, count(*) AS n, round(sum(l_quantity), 6) AS total FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    a = F.struct(F.col("l_partkey").cast("string").alias("molecule_chembl_id"), F.col("l_returnflag").alias("standard_type"), F.col("l_quantity").cast("string").alias("standard_value"), F.lit("nM").alias("standard_units"))
    pages = x.lineitem.select(F.col("l_suppkey").alias("page"), F.to_json(F.struct(F.array(a).alias("activities"))).alias("payload"))
    rows = A.parse_activity_pages(pages, types=("R", "A"))
    return rows.groupBy("page", "standard_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("standard_value")).alias("total"))


@query(
    "a12_target_choice",
    """SELECT p_brand AS wanted, coalesce(min(CASE WHEN p_name LIKE '%ring' THEN p_partkey END), min(p_partkey)) AS target_id FROM part WHERE p_type <> 'PROMO' GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.part.select(
        F.col("p_brand").alias("wanted"), F.col("p_partkey").alias("target_id"), F.when(F.col("p_type") == "PROMO", "PROTEIN FAMILY").otherwise("SINGLE PROTEIN").alias("target_type"),
        F.when(F.col("p_name").endswith("ring"), F.lower("p_brand")).otherwise(F.col("p_name")).alias("pref_name"),
    )
    return A.choose_target(rows, "wanted")


@query("a14_reaction_counts", "SELECT user_id AS drug, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS report_count, count(*) AS n FROM events GROUP BY 1, 2")
def _(x: Inputs) -> DataFrame:
    r = F.struct(F.lit("k").alias("term"), F.get_json_object("props", "$.k").cast("long").alias("count"))
    rows = A.parse_reaction_counts(x.events.select(F.col("user_id").alias("drug"), F.to_json(F.struct(F.array(r).alias("results"))).alias("payload")))
    return rows.groupBy("drug", "report_count").agg(F.count(F.lit(1)).alias("n"))


def _wide(x: Inputs) -> DataFrame:
    names = [f"Brand#{i}" for i in range(1, 26)]
    wide = x.line_features.groupBy("cell_line_id").pivot("kinase_id", names).agg(F.first("log_tpm"))
    return wide.withColumnsRenamed({n: f"{n} ({i})" for i, n in enumerate(names)})


@query(
    "a15_tidy_matrix",
    """SELECT cell_line_id, kinase_id AS gene, round(log_tpm, 6) AS value, round(avg(log_tpm) OVER (PARTITION BY kinase_id), 6) AS mean_over_lines FROM line_features
       WHERE log_tpm IS NOT NULL AND cell_line_id <> 'NATION_3'""",
)
def _(x: Inputs) -> DataFrame:
    lines = x.nation.where("n_name <> 'NATION_3'").select(F.col("n_name").alias("cell_line_id"))
    out = A.tidy_matrix(_wide(x), "cell_line_id", lines=lines)
    return out.select("cell_line_id", "gene", r6("value").alias("value"), r6("mean_over_lines").alias("mean_over_lines"))


@query(
    "a16_pair_key_file",
    """WITH s AS (SELECT p_partkey, p_brand FROM part WHERE p_type = 'ECONOMY') SELECT a.p_brand AS gene1, b.p_brand AS gene2, count(*) AS n, round(sum(l_discount), 6) AS total
       FROM lineitem JOIN s a ON a.p_partkey = l_partkey JOIN s b ON b.p_partkey = l_suppkey GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    key = F.concat(F.lit("('E"), F.col("l_partkey").cast("string"), F.lit(".3', 'E"), F.col("l_suppkey").cast("string"), F.lit(".1')"))
    symbols = x.part.where("p_type = 'ECONOMY'").select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("gene"))
    rows = A.parse_pair_keys(x.lineitem.select(key.alias("key"), F.col("l_discount").alias("score")), symbols)
    return rows.groupBy("gene1", "gene2").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"))


@query(
    "a17_second_network",
    """SELECT upper(p_brand) AS gene1, concat('BRAND#', CAST(1 + p_size % 25 AS VARCHAR)) AS gene2, round(arg_max(p_retailprice, p_partkey), 6) AS score FROM part
       WHERE p_brand IN (SELECT gene FROM gene_drugs) AND concat('Brand#', CAST(1 + p_size % 25 AS VARCHAR)) IN (SELECT gene FROM gene_drugs) GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.part.select(F.concat(F.lit(" "), F.lower("p_brand")).alias("gene1"), F.concat(F.lit("brand#"), (1 + F.col("p_size") % 25).cast("string"), F.lit(" ")).alias("gene2"),
                         F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("ord"))
    return A.second_network(rows, x.gene_drugs).withColumn("score", r6("score"))


@query("a18_matrix_orientation", "SELECT 'PASS' AS level, 'orientation' AS check_name, CASE WHEN avg(CASE WHEN regexp_matches(p_brand, '^[A-Z][a-z]+#[0-9]+$') THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'genes in rows' ELSE 'genes in columns' END AS message FROM part")
def _(x: Inputs) -> DataFrame:
    return Q.matrix_orientation(x.part, "p_brand", "^[A-Z][a-z]+#[0-9]+$", "orientation")


# the matrix the right way round, its transpose, and one of zeros with numbered headers and half of the panel
ROLE_SQL["effect_cells"] = """SELECT 'upright' AS file, patient_id AS row_id, gene AS head, value / 100.0 AS value FROM expression
    UNION ALL SELECT 'turned', gene, patient_id, value FROM expression
    UNION ALL SELECT 'blank', patient_id, concat(gene, ' (17)'), value - value FROM expression WHERE gene < 'Brand#2'"""
_EFFECT_FILES = ("upright", "turned", "blank")


@query(
    "m06_gene_effect_checks",
    """WITH p AS (SELECT DISTINCT kinase_id AS gene FROM panel_scores), f AS (SELECT DISTINCT file FROM effect_cells),
            c AS (SELECT file, count(DISTINCT split_part(head, ' (', 1)) AS c FROM effect_cells WHERE split_part(head, ' (', 1) IN (SELECT gene FROM p) GROUP BY file),
            r AS (SELECT file, count(DISTINCT row_id) AS r FROM effect_cells WHERE row_id IN (SELECT gene FROM p) GROUP BY file),
            n AS (SELECT file, coalesce(c, 0) AS c, coalesce(r, 0) AS r, (SELECT count(*) FROM p) AS p FROM f LEFT JOIN c USING (file) LEFT JOIN r USING (file)),
            v AS (SELECT file, min(value) AS a, max(value) AS b FROM effect_cells GROUP BY file)
       SELECT CASE WHEN c = 0 THEN 'FAIL' WHEN c < p THEN 'WARN' ELSE 'PASS' END AS level, file || ' orientation' AS check_name,
              CASE WHEN c = 0 AND r > 0 THEN 'backwards: ' || r || ' panel genes in the rows, none in the columns' ELSE c || ' of ' || p || ' panel genes in the columns' END AS message FROM n
       UNION ALL SELECT CASE WHEN a = 0 AND b = 0 THEN 'FAIL' WHEN a < -10 OR b > 10 THEN 'WARN' ELSE 'PASS' END, file || ' values',
              CASE WHEN a = 0 AND b = 0 THEN 'all values are 0' WHEN a < -10 OR b > 10 THEN 'values too wide for gene effects' ELSE 'values fit gene effects' END FROM v""",
)
def _(x: Inputs) -> DataFrame:
    panel = cut_lineage(x.panel_scores.select(F.col("kinase_id").alias("gene")))
    cells = cut_lineage(x.effect_cells)  # each file reads them three times
    return Q.report([Q.gene_effect_checks(cells.where(F.col("file") == f).drop("file"), panel, f) for f in _EFFECT_FILES])


@query(
    "a26_combination_rows",
    """SELECT drug_row, drug_col, count(*) AS n, round(avg(synergy_bliss), 6) AS bliss, round(avg(synergy_zip), 6) AS zip FROM drugcomb
       WHERE synergy_bliss IS NOT NULL AND cell_line_name <> 'NATION_3' AND drug_row IN (SELECT kinase_id FROM panel_scores) AND drug_col IN (SELECT kinase_id FROM panel_scores) GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    """A26 filters and A27 null-metric rule."""
    lines = x.nation.where("n_name <> 'NATION_3'").select(F.col("n_name").alias("cell_line_name"))
    rows = A.combination_rows(x.drugcomb, lines, x.panel_scores.select(F.col("kinase_id").alias("drug")))
    return rows.groupBy("drug_row", "drug_col").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("bliss")).alias("bliss"), r6(F.avg("zip")).alias("zip"))


@query("a26_unresolved_drugs", "SELECT drug FROM (SELECT drug_row AS drug FROM drugcomb UNION SELECT drug_col FROM drugcomb) d WHERE drug NOT IN (SELECT kinase_id FROM panel_scores)")
def _(x: Inputs) -> DataFrame:
    return A.unresolved_drugs(x.drugcomb, x.panel_scores.select(F.col("kinase_id").alias("drug")))


@query("a28_pair_map_round_trip", "SELECT source, target, round(weight, 6) AS weight FROM edges")
def _(x: Inputs) -> DataFrame:
    """Edge export with 'a|b' keys, grouped by source, and back."""
    keyed = sinks.with_pair_key(x.edges.withColumn("g", F.col("source")), "source", "target")
    payload = keyed.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "weight")))).alias("payload"))
    return sinks.read_pair_map(payload).withColumn("weight", r6("weight"))


@query("a30_stamped_export", "SELECT kinase_id, round(target_score, 6) AS target_score, '0.1.0' AS pipeline_version, 'local' AS git_commit, '2024-01-01T00:00:00Z' AS generated_at FROM panel_scores")
def _(x: Inputs) -> DataFrame:
    return sinks.stamped(x.panel_scores.select("kinase_id", r6("target_score").alias("target_score")), "0.1.0", "local", "2024-01-01T00:00:00Z")


@query(
    "a24_file_inventory",
    """SELECT CASE WHEN regexp_matches(url, '\\?') THEN 'query pages' WHEN regexp_matches(url, '[0-9]$') THEN 'numbered' ELSE 'other' END AS kind, count(*) AS n_files FROM (
       SELECT regexp_extract(url, '([^/]*)$', 1) AS url FROM pages) p GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    return A.file_inventory(x.pages.select(F.col("url").alias("path")), {"query pages": r"\?", "numbered": "[0-9]$"}).select("kind", "n_files")


_REPORT_SQL = """SELECT CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS level, 'documents exist' AS check_name, concat(CAST(count(*) AS VARCHAR), ' rows') AS message FROM documents
    UNION ALL SELECT CASE WHEN sum(o) > 0 THEN 'FAIL' WHEN sum(b) > 0 THEN 'WARN' ELSE 'PASS' END, 'value range', concat(CAST(sum(o) AS VARCHAR), ' of ', CAST(count(*) AS VARCHAR), ' outside, ', CAST(sum(b) AS VARCHAR), ' not numeric')
        FROM (SELECT CASE WHEN v < 0 OR v > 450 THEN 1 ELSE 0 END AS o, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS b FROM (SELECT TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events) q) r
    UNION ALL SELECT CASE WHEN h = 0 THEN 'FAIL' WHEN h < n THEN 'WARN' ELSE 'PASS' END, 'label coverage', concat(CAST(h AS VARCHAR), ' of ', CAST(n AS VARCHAR), ' covered', CASE WHEN h > 0 AND h / n < 0.5 THEN ', below half' ELSE '' END)
        FROM (SELECT count(DISTINCT d.doc_id) AS n, count(DISTINCT l.doc_id) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) q
    UNION ALL SELECT CASE WHEN d > 0 THEN 'WARN' ELSE 'PASS' END, 'duplicate lines', concat(CAST(d AS VARCHAR), ' duplicated keys') FROM (SELECT count(*) AS d FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) g) q
    UNION ALL SELECT CASE WHEN max(weight) > 1.5 THEN 'FAIL' ELSE 'PASS' END, 'edge scale', CASE WHEN max(weight) > 1.5 THEN 'raw scale' ELSE 'scaled to 1' END FROM graph_edges
    UNION ALL SELECT CASE WHEN count(DISTINCT community) >= 2 THEN 'PASS' ELSE 'FAIL' END, 'communities', concat(CAST(count(DISTINCT community) AS VARCHAR), ' communities') FROM community
    UNION ALL SELECT CASE WHEN count(*) < 10 THEN 'FAIL' WHEN count(*) > count(DISTINCT s_name) OR sum(CASE WHEN regexp_matches(s_name, '[^A-Za-z0-9_\\- #()]') THEN 1 ELSE 0 END) > 0 THEN 'WARN' ELSE 'PASS' END, 'supplier list',
        concat(CAST(count(*) AS VARCHAR), ' entries, ', CAST(count(DISTINCT s_name) AS VARCHAR), ' distinct, ', CAST(sum(CASE WHEN regexp_matches(s_name, '[^A-Za-z0-9_\\- #()]') THEN 1 ELSE 0 END) AS VARCHAR), ' odd') FROM supplier
    UNION ALL SELECT CASE WHEN h = 0 THEN 'FAIL' WHEN h < n THEN 'WARN' ELSE 'PASS' END, 'reactions per drug', concat(CAST(h AS VARCHAR), ' of ', CAST(n AS VARCHAR), ' covered', CASE WHEN h > 0 AND h / n < 0.5 THEN ', below half' ELSE '' END)
        FROM (SELECT count(DISTINCT d.drug) AS n, count(DISTINCT r.drug) AS h FROM drug_targets d LEFT JOIN reactions r ON r.drug = d.drug) q
    UNION ALL SELECT 'PASS', 'gene drug map', '0 blank genes, 0 blank drugs'
    UNION ALL SELECT 'PASS', 'brand ids', CASE WHEN avg(CASE WHEN regexp_matches(p_brand, '^Brand#[0-9]+$') THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'genes in rows' ELSE 'genes in columns' END FROM part"""


@query("m12_input_report", _REPORT_SQL)
def _(x: Inputs) -> DataFrame:
    """M1, M3-M6, M8-M13 in one report."""
    mixed = x.events.select(F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return Q.report([
        Q.not_empty(x.documents, "documents exist"), Q.numeric_range(mixed, "value", 0, 450, "value range"), Q.coverage(x.documents, x.labels, "doc_id", "label coverage"),
        Q.duplicate_keys(x.lineitem, ["l_orderkey", "l_linenumber"], "duplicate lines"), Q.edge_scale(x.graph_edges, "weight", "edge scale"),
        Q.enough_communities(x.community, "community", "communities"), Q.list_hygiene(x.supplier, "s_name", "supplier list"),
        Q.coverage(x.drug_targets, x.reactions, "drug", "reactions per drug"), Q.gene_drug_schema(x.gene_drugs, "gene drug map"),
        Q.matrix_orientation(x.part, "p_brand", "^Brand#[0-9]+$", "brand ids"),
    ])
