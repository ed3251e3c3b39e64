"""Queries over cohort construction: barcodes, funnel, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.barcodes import FUNNEL_CLASSES, PROTEIN_ALTERING, is_primary_tumour, participant_id
from targetloom.functions.numeric import r6
from targetloom.operators import cohort as C
from targetloom.plans.registry import query
from targetloom.plans.roles import Inputs

_TUMOUR = "split_part({b}, '-', 4) LIKE '01%'"
_FUNNEL_LIST = ", ".join(f"'{c}'" for c in FUNNEL_CLASSES)
_PROTEIN_LIST = ", ".join(f"'{c}'" for c in PROTEIN_ALTERING)


@query(
    "b01_participant_and_tumour_flags",
    f"""SELECT barcode, substr(barcode, 1, 12) AS participant_id, {_TUMOUR.format(b='barcode')} AS is_tumour FROM subtypes""",
)
def _(x: Inputs) -> DataFrame:
    """B1 participant id and B2 primary-tumour predicate."""
    return x.subtypes.select("barcode", participant_id("barcode").alias("participant_id"), is_primary_tumour("barcode").alias("is_tumour"))


@query("b03_one_aliquot", "SELECT substr(barcode, 1, 12) AS participant_id, min(barcode) AS barcode FROM subtypes GROUP BY 1")
def _(x: Inputs) -> DataFrame:
    return C.one_aliquot_per_participant(x.subtypes).select("participant_id", "barcode")


@query(
    "b04_subtype_identification",
    "SELECT barcode FROM subtypes WHERE lower(subtype) LIKE '%basal%'",
)
def _(x: Inputs) -> DataFrame:
    return C.identify_subtype_negative(x.subtypes).select("barcode")


@query(
    "b04_receptor_identification",
    """SELECT c_custkey AS patient FROM customer JOIN (
           SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS er,
                  max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS pr,
                  max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS her2 FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
       WHERE er = 0 AND pr = 0 AND her2 = 0""",
)
def _(x: Inputs) -> DataFrame:
    def status(p: str) -> F.Column:
        return F.when(F.max((F.col("o_orderpriority") == p).cast("int")) == 0, "Negative").otherwise("Positive")

    flags = x.orders.groupBy("o_custkey").agg(
        status("1-URGENT").alias("er_status"), status("2-HIGH").alias("pr_status"), status("5-LOW").alias("her2_status")
    )
    rows = x.customer.join(flags, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("patient"), "er_status", "pr_status", "her2_status")
    return C.identify_subtype_negative(rows).select("patient")


@query(
    "b05_cohort_restriction",
    """WITH ids AS (SELECT patient_id FROM clinical WHERE subtype = 'BUILDING')
       SELECT (SELECT count(*) FROM ids) AS requested, count(DISTINCT patient_id) AS found, count(*) AS expression_rows,
              round(sum(value), 6) AS total FROM expression WHERE patient_id IN (SELECT patient_id FROM ids)""",
)
def _(x: Inputs) -> DataFrame:
    ids = x.clinical.where("subtype = 'BUILDING'").select("patient_id")
    kept = C.restrict_to(x.expression, ids, "patient_id")
    counts = C.restriction_counts(x.expression, ids, "patient_id")
    totals = kept.agg(F.count(F.lit(1)).alias("expression_rows"), r6(F.sum("value")).alias("total"))
    return totals.select(
        counts.select("requested").scalar().alias("requested"), counts.select("found").scalar().alias("found"), "expression_rows", "total"
    )


@query("b06_exact_label", "SELECT subtype, count(*) AS n FROM subtypes WHERE subtype = 'Basal' GROUP BY subtype")
def _(x: Inputs) -> DataFrame:
    return x.subtypes.where(F.col("subtype") == "Basal").groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


_STAGES = f"""typed AS (SELECT substr(barcode, 1, 12) AS pid, min_by(subtype, barcode) AS subtype FROM subtypes
                       WHERE {_TUMOUR.format(b='barcode')} GROUP BY 1),
    tum AS (SELECT substr(Tumor_Sample_Barcode, 1, 12) AS pid, Hugo_Symbol AS gene, Variant_Classification AS cls FROM maf
            WHERE {_TUMOUR.format(b='Tumor_Sample_Barcode')}),
    s1 AS (SELECT pid FROM typed WHERE subtype = 'Basal'),
    s2 AS (SELECT pid FROM s1 WHERE pid IN (SELECT pid FROM tum)),
    el AS (SELECT pid, gene, cls FROM tum WHERE cls IN ({_FUNNEL_LIST}) AND pid IN (SELECT pid FROM s2)
             AND gene IN (SELECT kinase_id FROM panel_scores)),
    s3 AS (SELECT pid FROM el WHERE gene IN (SELECT gene FROM gene_drugs) GROUP BY pid HAVING count(DISTINCT gene) >= 2)"""


def _funnel(x: Inputs) -> DataFrame:
    panel = x.panel_scores.select(F.col("kinase_id").alias("gene"))
    return C.cohort_funnel(x.subtypes, x.maf, panel, x.gene_drugs.select("gene"))


@query(
    "d11_funnel_counts",
    f"""WITH {_STAGES} SELECT 0 AS stage, count(*) AS n FROM typed UNION ALL SELECT 1, count(*) FROM s1
        UNION ALL SELECT 2, count(*) FROM s2 UNION ALL SELECT 3, count(*) FROM s3""",
)
def _(x: Inputs) -> DataFrame:
    return C.funnel_counts(_funnel(x))


@query(
    "a29_stage_audit",
    f"""WITH {_STAGES} SELECT 0 AS stage, pid AS participant_id FROM typed UNION ALL SELECT 1, pid FROM s1
        UNION ALL SELECT 2, pid FROM s2 UNION ALL SELECT 3, pid FROM s3""",
)
def _(x: Inputs) -> DataFrame:
    return _funnel(x)


@query(
    "f05_stage_subset_check",
    f"WITH {_STAGES} SELECT count(*) AS violations FROM s3 WHERE pid NOT IN (SELECT pid FROM s2)",
)
def _(x: Inputs) -> DataFrame:
    return C.subset_violations(_funnel(x), 3, 2).agg(F.count(F.lit(1)).alias("violations"))


@query(
    "f01_cohort_intersection",
    f"""WITH {_STAGES} SELECT pid AS participant_id FROM s1 INTERSECT SELECT pid FROM tum""",
)
def _(x: Inputs) -> DataFrame:
    audit = _funnel(x)
    tumour = x.maf.where(is_primary_tumour("Tumor_Sample_Barcode")).select(participant_id("Tumor_Sample_Barcode").alias("participant_id"))
    return C.participants_of(1, audit).intersect(tumour)


@query(
    "b07_eligible_mutations",
    f"WITH {_STAGES} SELECT pid AS participant_id, gene, cls AS class, count(*) AS n FROM el WHERE gene IN (SELECT gene FROM gene_drugs) GROUP BY 1, 2, 3",
)
def _(x: Inputs) -> DataFrame:
    panel = x.panel_scores.select(F.col("kinase_id").alias("gene"))
    tumour = x.maf.where(is_primary_tumour("Tumor_Sample_Barcode"))
    rows = C.eligible_mutations(tumour, C.participants_of(2, _funnel(x)), panel, mapped_genes=x.gene_drugs)
    return rows.groupBy("participant_id", "gene", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d10_genes_per_participant",
    f"WITH {_STAGES} SELECT pid AS participant_id, count(DISTINCT gene) AS n_genes FROM el GROUP BY pid HAVING count(DISTINCT gene) >= 2",
)
def _(x: Inputs) -> DataFrame:
    panel = x.panel_scores.select(F.col("kinase_id").alias("gene"))
    tumour = x.maf.where(is_primary_tumour("Tumor_Sample_Barcode"))
    rows = C.eligible_mutations(tumour, C.participants_of(2, _funnel(x)), panel)
    return C.genes_per_participant(rows).where("n_genes >= 2")


@query(
    "d12_gene_count_distribution",
    f"""WITH {_STAGES},
        md AS (SELECT pid, gene FROM el WHERE cls = 'Missense_Mutation' AND pid IN (SELECT pid FROM s2)),
        per AS (SELECT s2.pid, count(DISTINCT md.gene) AS n_all,
                       count(DISTINCT CASE WHEN md.gene IN (SELECT gene FROM gene_drugs) THEN md.gene END) AS n_mapped
                FROM s2 LEFT JOIN md ON md.pid = s2.pid GROUP BY s2.pid),
        long AS (SELECT 'all' AS gene_set, n_all AS n FROM per UNION ALL SELECT 'mapped', n_mapped FROM per)
        SELECT gene_set, CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN n = k THEN 1 ELSE 0 END) AS BIGINT) AS exactly,
               CAST(sum(CASE WHEN n >= k THEN 1 ELSE 0 END) AS BIGINT) AS at_least
        FROM long CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) ks GROUP BY gene_set, k""",
)
def _(x: Inputs) -> DataFrame:
    panel = x.panel_scores.select(F.col("kinase_id").alias("gene"))
    tumour = x.maf.where(is_primary_tumour("Tumor_Sample_Barcode"))
    ids = C.participants_of(2, _funnel(x))
    rows = C.eligible_mutations(tumour, ids, panel, classes=("Missense_Mutation",))
    return C.gene_count_distribution(ids, rows, x.gene_drugs.select("gene"))


@query(
    "d13_patient_gene_flags",
    """SELECT substr(Tumor_Sample_Barcode, 1, 12) AS patient, max(CASE WHEN Hugo_Symbol = 'Brand#1' THEN 1 ELSE 0 END) AS g1,
              max(CASE WHEN Hugo_Symbol = 'Brand#2' THEN 1 ELSE 0 END) AS g2, max(CASE WHEN Hugo_Symbol = 'Brand#3' THEN 1 ELSE 0 END) AS g3,
              count(DISTINCT Hugo_Symbol) AS n_genes FROM maf GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    flags = C.patient_gene_flags(x.maf.withColumn("patient", participant_id("Tumor_Sample_Barcode")), "patient", "Hugo_Symbol")
    wide = C.pivot_flags(flags, "patient", "Hugo_Symbol", ["Brand#1", "Brand#2", "Brand#3"])
    counts = flags.groupBy("patient").agg(F.count(F.lit(1)).alias("n_genes"))
    return wide.join(counts, "patient").select(
        "patient", F.col("`Brand#1`").alias("g1"), F.col("`Brand#2`").alias("g2"), F.col("`Brand#3`").alias("g3"), "n_genes"
    )


@query(
    "a07_panel_mutations",
    """SELECT DISTINCT substr(Tumor_Sample_Barcode, 1, 12) AS patient_barcode, Hugo_Symbol AS gene, Variant_Classification AS alteration_type
       FROM maf WHERE Hugo_Symbol IN (SELECT kinase_id FROM panel_scores)""",
)
def _(x: Inputs) -> DataFrame:
    return C.panel_mutations(x.maf, x.panel_scores.select(F.col("kinase_id").alias("gene")))


@query(
    "a08_altered_genes_per_patient",
    """WITH ids AS (SELECT DISTINCT concat('TCGA-', lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey AS VARCHAR), 4, '0')) AS patient FROM customer),
            g AS (SELECT DISTINCT substr(Tumor_Sample_Barcode, 1, 12) AS patient, Hugo_Symbol AS gene FROM maf WHERE Hugo_Symbol IN (SELECT gene FROM gene_drugs))
       SELECT ids.patient, string_agg(gene, ',' ORDER BY gene) AS genes FROM ids LEFT JOIN g ON g.patient = ids.patient GROUP BY ids.patient""",
)
def _(x: Inputs) -> DataFrame:
    n = F.col("c_custkey")
    ids = x.customer.select(F.concat(F.lit("TCGA-"), F.lpad((n % 97).cast("string"), 2, "0"), F.lit("-"), F.lpad(n.cast("string"), 4, "0")).alias("patient"))
    return C.altered_genes(x.maf, x.gene_drugs.select("gene"), ids).select("patient", F.array_join("genes", ",").alias("genes"))


@query(
    "b08_protein_altering_basal",
    f"""SELECT Hugo_Symbol AS gene, count(*) AS n FROM maf
        WHERE Variant_Classification IN ({_PROTEIN_LIST}) AND substr(Tumor_Sample_Barcode, 1, 12) IN (SELECT substr(barcode, 1, 12) FROM subtypes WHERE subtype = 'Basal')
        GROUP BY 1""",
)
def _(x: Inputs) -> DataFrame:
    basal = x.subtypes.where("subtype = 'Basal'").select(participant_id("barcode").alias("pid"))
    rows = x.maf.where(F.col("Variant_Classification").isin(*PROTEIN_ALTERING)).withColumn("pid", participant_id("Tumor_Sample_Barcode"))
    return C.restrict_to(rows, basal, "pid").groupBy(F.col("Hugo_Symbol").alias("gene")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_confirmed_lines",
    "SELECT n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%AM%' AND n_name LIKE '%1%'",
)
def _(x: Inputs) -> DataFrame:
    """Model annotation: lineage contains one text and subtype another."""
    ann = x.nation.join(x.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return ann.where(F.col("r_name").contains("AM") & F.col("n_name").contains("1")).select(F.col("n_name").alias("line"))


@query(
    "b10_panel_by_line_gap",
    """WITH have AS (SELECT DISTINCT kinase_id FROM line_features WHERE log_tpm IS NOT NULL AND n_lines % 3 = 0)
       SELECT kinase_id FROM panel_scores EXCEPT SELECT kinase_id FROM have""",
)
def _(x: Inputs) -> DataFrame:
    have = x.line_features.where("log_tpm IS NOT NULL AND n_lines % 3 = 0").select("kinase_id")
    return x.panel_scores.select("kinase_id").join(have, "kinase_id", "left_anti").distinct()


@query(
    "b12_time_event",
    """SELECT patient_id, CASE WHEN lower(vital_status) = 'dead' THEN 1 ELSE 0 END AS event,
              round(CASE WHEN lower(vital_status) = 'dead' THEN days_to_death ELSE days_to_last_follow_up END / 30.4375, 6) AS time FROM clinical""",
)
def _(x: Inputs) -> DataFrame:
    return C.survival_time_event(x.clinical).select("patient_id", "event", r6("time").alias("time"))


@query(
    "a20_clinical_ingest",
    """SELECT concat('P', CAST(c_custkey AS VARCHAR)) AS patient_id,
              CASE WHEN c_nationkey % 4 = 3 THEN 4.0 WHEN c_nationkey % 4 = 2 THEN 3.0 WHEN c_nationkey % 4 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS stage_numeric
       FROM customer""",
)
def _(x: Inputs) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("Stage IA", "stage iib", "Stage IIIC", "STAGE IV")])
    rows = x.customer.withColumn("stage", F.get(names, F.col("c_nationkey") % 4))
    return rows.select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("patient_id"), C.stage_ordinal("stage").alias("stage_numeric"))
