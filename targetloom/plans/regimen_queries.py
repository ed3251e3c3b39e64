"""Queries over regimens and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from targetloom.functions.barcodes import PROTEIN_ALTERING, is_primary_tumour, participant_id
from targetloom.functions.numeric import r6
from targetloom.operators import cohort as C
from targetloom.operators import regimen as R
from targetloom.operators import variants as V
from targetloom.plans.registry import query
from targetloom.plans.roles import ROLE_SQL, SPARK_ROLES, Inputs
from targetloom.session import cut_lineage

_PROTEIN_LIST = ", ".join(f"'{c}'" for c in PROTEIN_ALTERING)
ROLE_SQL.update(
    {
        "alterations": f"""
            SELECT substr(Tumor_Sample_Barcode, 1, 12) AS patient, Hugo_Symbol AS gene, Variant_Classification AS class,
                   file_ord * 100 + line_ord AS ord FROM maf
            WHERE Variant_Classification IN ({_PROTEIN_LIST}) AND split_part(Tumor_Sample_Barcode, '-', 4) LIKE '01%'
              AND substr(Tumor_Sample_Barcode, 1, 12) IN (SELECT substr(barcode, 1, 12) FROM subtypes WHERE subtype = 'Basal')""",
        "patient_genes": """
            SELECT patient, gene, min_by(class, struct_pack(a := ord, b := class)) AS class, count(DISTINCT class) > 1 AS conflict FROM alterations GROUP BY patient, gene""",
        "class_drugs": """
            SELECT * FROM (VALUES ('Brand#9', 'mutant', 'red ring'), ('Brand#9', 'mutant', 'blue rod'),
                                  ('Brand#9', 'deleted', 'red ring'), ('Brand#9', 'deleted', 'hot plate')) AS t(gene, class, drug)""",
        "gene_class": """
            SELECT p_brand AS gene, CASE CAST(substr(p_brand, 7) AS INTEGER) % 3 WHEN 0 THEN 'RTK' WHEN 1 THEN 'INTRA' ELSE 'other' END AS gene_class
            FROM part GROUP BY p_brand""",
        "drug_gene": "SELECT drug, min(gene) AS gene FROM gene_drugs GROUP BY drug",
        "drug_toxicity": """
            SELECT drug, concat('category ', CAST(s_nationkey % 5 AS VARCHAR(20))) AS category
            FROM reactions JOIN supplier ON reaction = concat('reaction ', CAST(s_suppkey AS VARCHAR(20)))
            GROUP BY 1, 2 HAVING count(*) % 4 = 0""",
        "known_synergy": "SELECT drug_1 AS drug_a, drug_2 AS drug_b, round(0.05 * (shared % 5 + 1), 2) AS boost FROM toxicity WHERE shared % 9 = 0",
        "drug_pool": "SELECT drug FROM gene_drugs UNION SELECT drug FROM class_drugs",
        "drug_pairs": """
            SELECT a.drug AS drug_a, b.drug AS drug_b,
                   CASE WHEN ga.gene IS NULL OR gb.gene IS NULL OR ga.gene = gb.gene THEN 0.0
                        ELSE least(least(coalesce(o.n, 0) * CAST(0.15 AS DOUBLE), 0.4)
                             + CASE WHEN (ca.gene_class = 'RTK' AND cb.gene_class = 'INTRA') OR (ca.gene_class = 'INTRA' AND cb.gene_class = 'RTK')
                                    THEN 0.25 ELSE 0.1 END + coalesce(k.boost, 0.0), 1.0) END AS synergy,
                   CAST(coalesce(t.n, 0) AS INTEGER) AS tox, CASE WHEN k.boost IS NULL THEN 0 ELSE 1 END AS known
            FROM drug_pool a JOIN drug_pool b ON a.drug < b.drug
            LEFT JOIN drug_gene ga ON ga.drug = a.drug LEFT JOIN drug_gene gb ON gb.drug = b.drug
            LEFT JOIN gene_class ca ON ca.gene = ga.gene LEFT JOIN gene_class cb ON cb.gene = gb.gene
            LEFT JOIN (SELECT p.gene AS g1, q.gene AS g2, count(*) AS n FROM gene_pathways p JOIN gene_pathways q ON p.pathway = q.pathway GROUP BY 1, 2) o
              ON o.g1 = ga.gene AND o.g2 = gb.gene
            LEFT JOIN (SELECT p.drug AS d1, q.drug AS d2, count(*) AS n FROM drug_toxicity p JOIN drug_toxicity q ON p.category = q.category GROUP BY 1, 2) t
              ON t.d1 = a.drug AND t.d2 = b.drug
            LEFT JOIN known_synergy k ON k.drug_a = a.drug AND k.drug_b = b.drug""",
        "patient_pools": """
            WITH m AS (SELECT patient, gene, CASE WHEN class IN ('Deep_Deletion', 'Homozygous_Deletion', 'Nonsense_Mutation', 'Frame_Shift_Del', 'Frame_Shift_Ins', 'Splice_Site')
                              THEN 'deleted' ELSE 'mutant' END AS mapped FROM patient_genes),
                 d AS (SELECT patient, m.gene, coalesce(c.drug, g.drug) AS drug FROM m
                       LEFT JOIN class_drugs c ON c.gene = m.gene AND c.class = m.mapped LEFT JOIN gene_drugs g ON g.gene = m.gene)
            SELECT patient, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes, list_sort(list(DISTINCT drug) FILTER (drug IS NOT NULL)) AS drugs,
                   string_agg(DISTINCT CASE WHEN drug IS NULL THEN gene END, ',' ORDER BY CASE WHEN drug IS NULL THEN gene END) AS no_entry
            FROM d GROUP BY patient HAVING count(DISTINCT CASE WHEN drug IS NOT NULL THEN gene END) >= 2""",
    }
)
SPARK_ROLES.update(
    {
        "patient_genes": lambda x: R.first_class(x.alterations),
        "drug_gene": lambda x: R.drug_to_gene(x.gene_drugs),
        "drug_pairs": lambda x: R.drug_pair_table(x.drug_pool, x.drug_gene, x.gene_pathways, x.gene_class, x.drug_toxicity, x.known_synergy),
        "patient_pools": lambda x: R.available_drugs(x.patient_genes, x.gene_drugs, x.class_drugs),
        "alterations": lambda x: C.restrict_to(
            x.maf.where(F.col("Variant_Classification").isin(*PROTEIN_ALTERING) & is_primary_tumour("Tumor_Sample_Barcode")).select(
                participant_id("Tumor_Sample_Barcode").alias("patient"), F.col("Hugo_Symbol").alias("gene"),
                F.col("Variant_Classification").alias("class"), (F.col("file_ord") * 100 + F.col("line_ord")).alias("ord"),
            ),
            x.subtypes.where("subtype = 'Basal'").select(participant_id("barcode").alias("patient")), "patient",
        ),
    }
)


@query(
    "h06_pair_synergy",
    "SELECT drug_a, drug_b, round(synergy, 6) AS synergy, CAST(tox AS BIGINT) AS tox, CAST(known AS BIGINT) AS known FROM drug_pairs",
)
def _(x: Inputs) -> DataFrame:
    """Pairwise synergy heuristic (H6) with toxicity-overlap counts (H7) and known-pair evidence (H8)."""
    return x.drug_pairs.select("drug_a", "drug_b", r6("synergy").alias("synergy"), F.col("tox").cast("long"), F.col("known").cast("long"))


@query(
    "h07_safety_screen",
    """SELECT a.drug AS drug_a, b.drug AS drug_b, coalesce(string_agg(x.category, ', ' ORDER BY x.category), 'none') AS toxicity_overlap
       FROM drug_pool a JOIN drug_pool b ON a.drug < b.drug
       LEFT JOIN (SELECT p.drug AS d1, q.drug AS d2, p.category FROM drug_toxicity p JOIN drug_toxicity q ON p.category = q.category) x
         ON x.d1 = a.drug AND x.d2 = b.drug GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    return R.safety_screen(x.drug_pairs.select("drug_a", "drug_b"), x.drug_toxicity).select("drug_a", "drug_b", "toxicity_overlap")


@query(
    "h10_class_drug_lists",
    """SELECT p.patient, p.gene, string_agg(c.drug, ',' ORDER BY c.drug) AS drugs FROM patient_genes p JOIN class_drugs c ON c.gene = p.gene
         AND c.class = CASE WHEN p.class IN ('Nonsense_Mutation', 'Frame_Shift_Del', 'Frame_Shift_Ins', 'Splice_Site') THEN 'deleted' ELSE 'mutant' END
       GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.patient_genes.withColumn("class", R.mapped_class()).join(x.class_drugs, ["gene", "class"])
    return rows.groupBy("patient", "gene").agg(F.array_join(F.array_sort(F.collect_set("drug")), ",").alias("drugs"))


@query(
    "h11_available_drugs",
    "SELECT patient, genes, array_to_string(drugs, ',') AS drugs, coalesce(no_entry, '') AS no_entry FROM patient_pools",
)
def _(x: Inputs) -> DataFrame:
    return x.patient_pools.select("patient", *[F.array_join(c, ",").alias(c) for c in ("genes", "drugs", "no_entry")])


@query("h11_first_alteration_class", "SELECT patient, gene, class, conflict FROM patient_genes")
def _(x: Inputs) -> DataFrame:
    return x.patient_genes.select("patient", "gene", "class", "conflict")


def _cards(x: Inputs) -> DataFrame:
    # used by every depth of the search
    return cut_lineage(R.drug_cards(x.drug_pool, x.drug_pairs, x.drug_gene))


BEAM_WIDTH, SEARCH_DEPTH = 50, 5


def _search_sql(depth: int) -> str:
    """Check text of the beam search: one block of common tables per number of drugs, up to ``depth``."""
    steps = [f"""both_pairs AS MATERIALIZED (SELECT drug_a AS a, drug_b AS b, synergy, tox, known FROM drug_pairs UNION ALL SELECT drug_b, drug_a, synergy, tox, known FROM drug_pairs),
    av AS MATERIALIZED (SELECT patient, unnest(drugs) AS drug, unnest(range(len(drugs))) AS pos FROM patient_pools),
    f1 AS MATERIALIZED (SELECT patient, drug AS m1, coalesce(gene, '-') AS x1, CAST(0 AS DOUBLE) AS syn, 0 AS tox, 0 AS known, pos + 1 AS np FROM av LEFT JOIN drug_gene USING (drug) WHERE pos < {BEAM_WIDTH})"""]
    for n in range(2, depth + 1):
        old = list(range(1, n))
        ms, xs = ", ".join(f"m{i}" for i in old), ", ".join(f"x{i}" for i in old)
        steps.append(f"""g{n} AS (SELECT f.patient, {ms}, {xs}, syn, tox, known, np AS place, av.drug AS m{n}, av.pos, array_to_string(list_sort([{ms}, av.drug]), ' + ') AS regimen
        FROM f{n - 1} f JOIN av ON av.patient = f.patient AND av.drug NOT IN ({ms})),
    u{n} AS MATERIALIZED (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY patient, regimen ORDER BY place, pos) = 1),
    a{n} AS MATERIALIZED (SELECT patient, regimen, sum(p.synergy) AS synergy, CAST(sum(p.tox) AS BIGINT) AS tox, CAST(sum(p.known) AS BIGINT) AS known
        FROM (SELECT patient, regimen, m{n} AS a, unnest([{ms}]) AS b FROM u{n}) q JOIN both_pairs p USING (a, b) GROUP BY patient, regimen),
    t{n} AS (SELECT u.patient, {ms}, u.m{n}, {xs}, coalesce(d.gene, '-') AS x{n}, u.regimen, place, pos, u.syn + a.synergy AS syn, u.tox + a.tox AS tox, u.known + a.known AS known
        FROM u{n} u JOIN a{n} a ON a.patient = u.patient AND a.regimen = u.regimen LEFT JOIN drug_gene d ON d.drug = u.m{n}),
    s{n} AS (SELECT *, round(syn / {n * (n - 1) // 2} + least(known * 0.3, 1.0) + {0.05 * (n - 2)} - tox * 0.2 - ({n} - len(list_distinct([{xs}, x{n}]))) * 0.3, 9) AS score FROM t{n}),
    f{n} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY score DESC, place, pos) AS np FROM s{n} QUALIFY np <= {BEAM_WIDTH})""")
    found = " UNION ALL ".join(f"SELECT patient, regimen, score, {n} AS size, np FROM f{n}" for n in range(2, depth + 1))
    steps.append(f"found AS ({found}),\n    ranked AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY score DESC, size, np) AS rk FROM found)")
    return ",\n    ".join(steps)


_INFO = _search_sql(SEARCH_DEPTH)


@query(
    "h09_beam_search",
    f"WITH {_INFO} SELECT patient, regimen, CAST(size AS INTEGER) AS size, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rk <= 10",
)
def _(x: Inputs) -> DataFrame:
    out = R.beam_search(x.patient_pools.select("patient", "drugs"), _cards(x), beam_width=BEAM_WIDTH, max_depth=SEARCH_DEPTH, top_k=10)
    return out.select("patient", "regimen", "size", "rank", r6("score").alias("score"))


_COHORT = f"""{_INFO},
    top AS (SELECT patient, max(score) AS ts FROM ranked WHERE rk <= 10 GROUP BY patient),
    tied AS (SELECT r.patient, ts, min_by(regimen, rk) AS top_regimen, count(*) AS n_tied_top, string_agg(regimen, ' | ' ORDER BY rk) AS tied_regimens
             FROM ranked r JOIN top USING (patient) WHERE rk <= 10 AND ts - score < 1e-9 GROUP BY r.patient, ts),
    res AS (SELECT p.patient, p.genes, CAST(len(p.drugs) AS BIGINT) AS n_available_drugs, top_regimen, round(ts, 6) AS top_score, n_tied_top, tied_regimens,
                   coalesce(no_entry, '') AS genes_with_no_drug_entry FROM patient_pools p LEFT JOIN tied t ON t.patient = p.patient)"""


def _cohort(x: Inputs) -> DataFrame:
    pools = cut_lineage(x.patient_pools)
    return R.cohort_regimens(pools, R.beam_search(pools.select("patient", "drugs"), _cards(x), beam_width=BEAM_WIDTH, max_depth=SEARCH_DEPTH, top_k=10))


@query("h12_cohort_regimens", f"WITH {_COHORT} SELECT * FROM res")
def _(x: Inputs) -> DataFrame:
    return _cohort(x)


@query("h12_cohort_regimens_depth5", f"WITH {_COHORT} SELECT * FROM res")
def _(x: Inputs) -> DataFrame:
    """Same search as ``h12_cohort_regimens``, which had stopped at three drugs when this name was given."""
    return _cohort(x)


@query(
    "h13_cohort_all_patients",
    f"""WITH {_COHORT} SELECT s.patient, top_regimen, top_score FROM (SELECT DISTINCT substr(barcode, 1, 12) AS patient FROM subtypes WHERE subtype = 'Basal') s
        LEFT JOIN res ON res.patient = s.patient""",
)
def _(x: Inputs) -> DataFrame:
    ids = x.subtypes.where("subtype = 'Basal'").select(participant_id("barcode").alias("patient"))
    return R.cohort_with_all_patients(ids, _cohort(x)).select("patient", "top_regimen", "top_score")


@query(
    "d14_regimen_frequency",
    f"""WITH {_COHORT} SELECT top_regimen, count(*) AS n_patients, round(count(*) * 100.0 / (SELECT count(*) FROM res), 1) AS pct
        FROM res WHERE top_regimen IS NOT NULL GROUP BY top_regimen""",
)
def _(x: Inputs) -> DataFrame:
    return C.regimen_frequency(cut_lineage(_cohort(x)))


@query(
    "d15_recurring_drugs",
    f"""WITH {_COHORT}, d AS (SELECT unnest(string_split(top_regimen, ' + ')) AS drug FROM res WHERE top_regimen IS NOT NULL)
        SELECT 'drug' AS kind, drug AS name, count(*) AS n FROM d GROUP BY drug
        UNION ALL SELECT 'pathway', pathway, count(*) FROM d JOIN drug_gene USING (drug) JOIN gene_pathways USING (gene) GROUP BY pathway""",
)
def _(x: Inputs) -> DataFrame:
    drugs = C.recurring_drugs(cut_lineage(_cohort(x)))
    paths = C.recurring_pathways(drugs, x.drug_gene, x.gene_pathways)
    return drugs.select(F.lit("drug").alias("kind"), F.col("drug").alias("name"), "n").unionByName(
        paths.select(F.lit("pathway").alias("kind"), F.col("pathway").alias("name"), "n")
    )


@query(
    "c11_regimen_diff",
    """WITH b AS (SELECT 'P' || o_custkey AS patient, string_agg(DISTINCT p_name, ' + ' ORDER BY p_name) AS reg, CAST(sum(l_quantity) AS DOUBLE) AS sc
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' AND l_discount >= 0.09 GROUP BY 1),
            a AS (SELECT 'P' || o_custkey AS patient, string_agg(DISTINCT p_name, ' + ' ORDER BY p_name) AS reg, CAST(sum(l_quantity) AS DOUBLE) AS sc
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' AND l_discount >= 0.08 GROUP BY 1),
            j AS (SELECT coalesce(a.patient, b.patient) AS patient, b.reg AS rb, a.reg AS ra, b.sc AS sb, a.sc AS sa,
                         list_sort(list_filter(coalesce(string_split(a.reg, ' + '), []), lambda v: NOT list_contains(coalesce(string_split(b.reg, ' + '), []), v))) AS added
                  FROM b FULL JOIN a ON a.patient = b.patient WHERE b.reg IS DISTINCT FROM a.reg OR b.sc IS DISTINCT FROM a.sc)
       SELECT patient, rb AS regimen_before, ra AS regimen_after, sb AS score_before, sa AS score_after, sa - sb AS score_delta,
              CASE WHEN len(added) > 0 THEN 'added: ' || array_to_string(added, ', ') ELSE 'same drugs, score changed' END AS reason FROM j""",
)
def _(x: Inputs) -> DataFrame:
    rows = x.lineitem.where("l_returnflag = 'R' AND l_discount >= 0.08").join(x.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(x.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("patient", F.concat(F.lit("P"), F.col("o_custkey").cast("string")))

    def regimens(low: float) -> DataFrame:
        return rows.where(F.col("l_discount") >= low).groupBy("patient").agg(
            F.array_join(F.array_sort(F.collect_set("p_name")), " + ").alias("top_regimen"), F.sum("l_quantity").alias("top_score")
        )

    return R.regimen_diff(regimens(0.09), regimens(0.08))


@query(
    "h16_patient_combinations",
    """WITH sides AS (SELECT g.gene, g.drug, c.gene_class FROM gene_drugs g JOIN gene_class c USING (gene)),
            ov AS (SELECT p.gene AS g1, q.gene AS g2, count(*) AS n FROM gene_pathways p JOIN gene_pathways q ON p.pathway = q.pathway GROUP BY 1, 2),
            tx AS (SELECT p.drug AS d1, q.drug AS d2, string_agg(p.category, ', ' ORDER BY p.category) AS cats FROM drug_toxicity p JOIN drug_toxicity q ON p.category = q.category GROUP BY 1, 2),
            rows AS (SELECT x.patient, a.gene AS ga, b.gene AS gb, a.drug AS da, b.drug AS db,
                            round(least(least(coalesce(ov.n, 0) * CAST(0.15 AS DOUBLE), 0.4) + CASE WHEN (a.gene_class = 'RTK' AND b.gene_class = 'INTRA') OR (a.gene_class = 'INTRA' AND b.gene_class = 'RTK') THEN 0.25 ELSE 0.1 END
                                  + coalesce(k.boost, 0.0), 1.0), 3) AS score, tx.cats
                     FROM patient_genes x JOIN patient_genes y ON x.patient = y.patient AND x.gene < y.gene
                     JOIN sides a ON a.gene = x.gene JOIN sides b ON b.gene = y.gene AND a.drug <> b.drug
                     LEFT JOIN ov ON g1 = a.gene AND g2 = b.gene LEFT JOIN tx ON d1 = a.drug AND d2 = b.drug
                     LEFT JOIN known_synergy k ON k.drug_a = least(a.drug, b.drug) AND k.drug_b = greatest(a.drug, b.drug)),
            u AS (SELECT *, row_number() OVER (PARTITION BY patient, da, db ORDER BY ga, gb) AS rn FROM rows),
            t AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY score DESC, da || ' + ' || db) AS rk FROM u WHERE rn = 1)
       SELECT patient, da || ' + ' || db AS combination, ga || '+' || gb AS genes, score, CAST(rk AS INTEGER) AS rank, coalesce(cats, 'none') AS toxicity_overlap,
              coalesce(rk = min(CASE WHEN cats IS NULL THEN rk END) OVER (PARTITION BY patient), false) AS recommended_first_pilot FROM t WHERE rk <= 15""",
)
def _(x: Inputs) -> DataFrame:
    out = R.patient_combinations(x.patient_genes, x.gene_drugs, x.gene_pathways, x.gene_class, x.drug_toxicity, x.known_synergy)
    return out.select("patient", "combination", F.concat("gene_a", F.lit("+"), "gene_b").alias("genes"), "score", "rank", "toxicity_overlap", "recommended_first_pilot")


@query(
    "d16_pathway_redundancy",
    """SELECT patient, pathway, count(*) AS n_genes, round(1 - 1 / (1 + 0.8 * (count(*) - 1)), 3) AS redundancy,
              round(1 / (1 + exp(-(count(*) - 1))), 3) AS legacy_redundancy
       FROM patient_genes JOIN gene_pathways USING (gene) GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    """D16 redundancy and D17 legacy sigmoid."""
    return V.pathway_redundancy(x.patient_genes, x.gene_pathways)


ROLE_SQL["resistance"] = """SELECT gene, concat('amplification of ', other) AS mechanism FROM (
    SELECT p_brand AS gene, concat('brand#', CAST(p_size % 25 + 1 AS VARCHAR(20))) AS other FROM part WHERE p_type = 'PROMO' GROUP BY 1, 2) q"""


@query(
    "h14_bypass_risk",
    """WITH near AS (SELECT DISTINCT a.gene AS g, b.gene AS o FROM gene_pathways a JOIN gene_pathways b ON a.pathway = b.pathway AND a.gene <> b.gene),
            nb AS (SELECT x.patient, x.gene, count(y.gene) AS n FROM patient_genes x LEFT JOIN near ON g = x.gene
                   LEFT JOIN patient_genes y ON y.patient = x.patient AND y.gene = o GROUP BY 1, 2),
            rh AS (SELECT x.patient, x.gene, count(DISTINCT mechanism) AS n FROM patient_genes x JOIN resistance r ON r.gene = x.gene
                   JOIN patient_genes y ON y.patient = x.patient AND contains(lower(mechanism), lower(y.gene)) GROUP BY 1, 2),
            s AS (SELECT nb.patient, nb.gene, nb.n AS nbp, coalesce(rh.n, 0) AS nres, least(1.0, round(0.15 * nb.n + 0.25 * coalesce(rh.n, 0), 3)) AS risk
                  FROM nb LEFT JOIN rh ON rh.patient = nb.patient AND rh.gene = nb.gene)
       SELECT patient, gene, CAST(nbp AS BIGINT) AS n_bypass, CAST(nres AS BIGINT) AS n_resistance, CAST(risk AS DOUBLE) AS bypass_risk,
              CASE WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS label FROM s""",
)
def _(x: Inputs) -> DataFrame:
    out = V.bypass_risk(x.patient_genes, x.gene_pathways, x.resistance)
    return out.select(
        "patient", "gene", F.size("bypass_genes").cast("long").alias("n_bypass"), F.col("n_resistance_hits").cast("long").alias("n_resistance"),
        "bypass_risk", F.split("recommendation", " ")[0].alias("label"),
    )


@query(
    "h15_combination_suggestions",
    """WITH rel AS (SELECT p_brand AS gene, CASE WHEN sum(p_size) % 3 = 0 THEN 3 WHEN sum(p_size) % 3 = 1 THEN 2 ELSE 1 END AS lv FROM part GROUP BY p_brand),
            inh AS (SELECT kinase_id AS gene, drug, row_number() OVER (PARTITION BY kinase_id ORDER BY ord, drug) AS o, length(drug) % 2 = 0 AS approved FROM drug_targets),
            pick AS (SELECT gene, CASE WHEN bool_or(approved) THEN array_to_string(list_slice(list(drug ORDER BY o) FILTER (approved), 1, 2), ',')
                                       ELSE array_to_string(list_slice(list(drug ORDER BY o), 1, 2), ',') END AS ds FROM inh GROUP BY gene),
            prs AS (SELECT a.gene AS g1, b.gene AS g2, min_by(a.pathway, (length(a.pathway), a.pathway)) AS pw FROM gene_pathways a JOIN gene_pathways b ON a.pathway = b.pathway AND a.gene < b.gene GROUP BY 1, 2)
       SELECT x.patient, g1 AS gene_1, g2 AS gene_2, pw AS shared_pathway, p1.ds AS suggested_drugs_1, p2.ds AS suggested_drugs_2,
              CASE WHEN r1.lv + r2.lv >= 5 THEN 'strong' WHEN r1.lv + r2.lv >= 3 THEN 'moderate' ELSE 'limited' END AS evidence_strength
       FROM patient_genes x JOIN patient_genes y ON x.patient = y.patient AND x.gene < y.gene JOIN prs ON g1 = x.gene AND g2 = y.gene
       JOIN rel r1 ON r1.gene = g1 JOIN rel r2 ON r2.gene = g2 LEFT JOIN pick p1 ON p1.gene = g1 LEFT JOIN pick p2 ON p2.gene = g2""",
)
def _(x: Inputs) -> DataFrame:
    left = F.sum("p_size") % 3
    rel = x.part.groupBy(F.col("p_brand").alias("gene")).agg(F.when(left == 0, "high").when(left == 1, "moderate").otherwise("low").alias("tnbc_relevance"))
    inh = x.drug_targets.select(F.col("kinase_id").alias("gene"), "drug", "ord", (F.length("drug") % 2 == 0).alias("approved"))
    return V.combination_suggestions(x.patient_genes, x.gene_pathways.withColumn("ord", F.length("pathway")), rel, inh)


_VCF_SQL = """vcf AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, CAST(l_linenumber AS VARCHAR) AS chrom, CAST(l_extendedprice * 100 AS BIGINT) AS pos,
        CASE WHEN l_discount < 0.05 THEN p_brand END AS tag,
        CASE l_returnflag WHEN 'R' THEN 'stop_gained' WHEN 'A' THEN 'missense_variant' ELSE 'other_effect' END AS effect,
        CAST(l_quantity AS INTEGER) AS depth, l_tax AS af FROM lineitem JOIN part ON l_partkey = p_partkey),
    loci AS (SELECT CAST(1 + p_partkey % 7 AS VARCHAR) AS chrom, CAST(p_retailprice * 100 AS BIGINT) * 20 AS s, CAST(p_retailprice * 100 AS BIGINT) * 20 + 30000 AS e,
        p_brand AS gene, p_partkey AS ord FROM part WHERE p_type = 'PROMO'),
    near AS (SELECT p.chrom, p.pos, min_by(gene, ord) AS g FROM (SELECT DISTINCT chrom, pos FROM vcf) p JOIN loci ON loci.chrom = p.chrom AND p.pos >= s AND p.pos <= e GROUP BY 1, 2),
    hit AS (SELECT vcf.*, g FROM vcf LEFT JOIN near ON near.chrom = vcf.chrom AND near.pos = vcf.pos)"""


def _vcf(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """VCF text lines and a locus table spelled from the tables."""
    effect = F.when(F.col("l_returnflag") == "R", "stop_gained").when(F.col("l_returnflag") == "A", "missense_variant").otherwise("other_effect")
    lines = x.lineitem.join(x.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("file"),
        F.concat_ws(
            "\t", F.col("l_linenumber").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.lit("."), F.lit("A"), F.lit("G"),
            F.lit("50"), F.lit("PASS"),
            F.concat_ws(
                ";", F.when(F.col("l_discount") < 0.05, F.concat(F.lit("GENE="), "p_brand")), F.concat(F.lit("EFFECT="), effect),
                F.concat(F.lit("DP="), F.col("l_quantity").cast("int").cast("string")), F.concat(F.lit("AF="), F.col("l_tax").cast("string")), F.lit("SOMATIC"),
            ),
        ).alias("value"),
    )
    price = F.round(F.col("p_retailprice") * 100).cast("long") * 20
    loci = x.part.where("p_type = 'PROMO'").select(
        (1 + F.col("p_partkey") % 7).cast("string").alias("chrom"), price.alias("start"), (price + 30000).alias("end"), F.col("p_brand").alias("gene"), F.col("p_partkey").alias("ord")
    )
    return lines, loci


@query(
    "a09_vcf_variants",
    f"""WITH {_VCF_SQL} SELECT effect, coalesce(tag, g, 'UNKNOWN') AS gene, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depth, round(avg(af), 6) AS mean_af,
        bool_or(coalesce(tag, g, 'UNKNOWN') IN (SELECT kinase_id FROM panel_scores)) AS is_kinase,
        max(CASE effect WHEN 'stop_gained' THEN 1.0 WHEN 'missense_variant' THEN 0.7 ELSE 0.0 END)::DOUBLE AS severity FROM hit GROUP BY 1, 2""",
)
def _(x: Inputs) -> DataFrame:
    """A9 record parse, A10/C14 interval join, C13 kinase flag, L13 severity."""
    lines, loci = _vcf(x)
    v = V.parse_vcf(lines, x.panel_scores.select(F.col("kinase_id").alias("gene")), loci, 50_000)
    return v.groupBy("effect", "gene").agg(
        F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"), r6(F.avg("allele_freq")).alias("mean_af"),
        F.bool_or("is_kinase").alias("is_kinase"), F.max("severity").alias("severity"),
    )


@query(
    "d18_variant_summary",
    f"""WITH {_VCF_SQL}, v AS (SELECT file, coalesce(tag, g, 'UNKNOWN') AS gene, effect FROM hit)
        SELECT file, count(*) AS total_variants, CAST(count(*) FILTER (gene IN (SELECT kinase_id FROM panel_scores)) AS BIGINT) AS kinase_variants,
               count(DISTINCT CASE WHEN gene IN (SELECT kinase_id FROM panel_scores) THEN gene END) AS n_genes,
               CAST(count(*) FILTER (gene IN (SELECT kinase_id FROM panel_scores) AND effect <> 'other_effect') AS BIGINT) AS n_high_severity FROM v GROUP BY file""",
)
def _(x: Inputs) -> DataFrame:
    lines, loci = _vcf(x)
    return V.variant_summary(V.parse_vcf(lines, x.panel_scores.select(F.col("kinase_id").alias("gene")), loci, 50_000))


@query(
    "b19_variant_thresholds",
    f"""WITH {_VCF_SQL} SELECT effect, count(*) AS n FROM hit WHERE af >= 0.05 AND depth >= 20 GROUP BY effect""",
)
def _(x: Inputs) -> DataFrame:
    lines, loci = _vcf(x)
    v = V.parse_vcf(lines, x.panel_scores.select(F.col("kinase_id").alias("gene")), loci, 50_000)
    return v.where("allele_freq >= 0.05 AND depth >= 20 AND severity >= 0").groupBy("effect").agg(F.count(F.lit(1)).alias("n"))
