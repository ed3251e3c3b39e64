from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.operators import ranking as K
from targetloom.operators import regimen as R
from targetloom.operators import scoring as S
from targetloom.operators import variants as V
from targetloom.operators.pairs import pearson_pairs, unordered_pairs
from targetloom.sources.knowledge import knowledge_tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_missing_value_rules(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, -1.0, 2.0, 0.01, 3.0), ("b", 0.0, 0.0, None, None, 0.5, None), ("c", 5.0, 4.0, -0.2, 0.5, 0.2, 1.0)],
        "kinase_id string, betweenness double, degree double, depmap_score double, cox_hr double, logrank_p double, dgidb_score double",
    )
    out = {r["kinase_id"]: r for r in S.target_score(df).collect()}
    b = out["b"]
    assert (b["centrality_norm"], b["essentiality_norm"], b["survival_norm"], b["druggability_norm"]) == (0.5, 0.5, 0.5, 0.0)
    assert b["target_score"] == pytest.approx(0.3 * 0.5 + 0.25 * 0.5 + 0.25 * 0.5)
    assert out["a"]["survival_norm"] == 1.0 and out["c"]["survival_norm"] == 0.0
    with pytest.raises(ValueError):
        S.target_score(df.drop("cox_hr"))


def test_unordered_pairs_are_complete(spark):
    df = spark.range(23).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for blocks in (1, 3, 8):
        got = rows(unordered_pairs(df, "k", blocks), "k_1", "k_2")
        names = sorted(r[0] for r in df.collect())
        assert got == list(itertools.combinations(names, 2))


def test_three_drugs_sharing_one_winner(spark):
    best = spark.createDataFrame(
        [("a", "b", 0.6, "X", "Y"), ("a", "c", 0.6, "Y", "X"), ("b", "c", 0.6, "X", "Y"), ("a", "d", 0.4, "X", "Z")],
        "drug_1 string, drug_2 string, base_score double, ki string, kj string",
    )
    out = {(r["drug_1"], r["drug_2"]): r for r in S.redundancy_penalised(best, None, penalty_weight=0.05).collect()}
    assert out["a", "b"]["winner_frequency"] == 3 and out["a", "b"]["penalty"] == pytest.approx(0.10)
    assert out["a", "b"]["drug_pair_score"] == pytest.approx(0.5)
    assert out["a", "d"]["drug_pair_score"] == pytest.approx(0.4)


def test_correlation_blocks_agree(spark):
    rng = np.random.default_rng(0)
    data = [(f"s{i}", f"g{j}", float(rng.normal())) for i in range(40) for j in range(7) if rng.random() > 0.2]
    long = spark.createDataFrame(data, "sample string, gene string, value double")
    one = rows(pearson_pairs(long, "sample", "gene", "value").withColumn("r", F.round("pearson_r", 9)), "item_a", "item_b", "r", "n_samples")
    many = rows(pearson_pairs(long, "sample", "gene", "value", blocks=3).withColumn("r", F.round("pearson_r", 9)), "item_a", "item_b", "r", "n_samples")
    assert one == many and len(one) == 21


def _regimens(spark, patients, class_of):
    k = knowledge_tables(spark)
    data = [(p, g, class_of, i) for p, gs in patients.items() for i, g in enumerate(gs.split(","))]
    alterations = spark.createDataFrame(data, "patient string, gene string, class string, ord int")
    pools = R.available_drugs(R.first_class(alterations), k["gene_drugs"], k["class_drugs"])
    drugs = k["gene_drugs"].select("drug").unionByName(k["class_drugs"].select("drug")).distinct()
    owner = R.drug_to_gene(k["gene_drugs"], "gene_ord")
    pairs = R.drug_pair_table(drugs, owner, k["gene_pathways"], k["gene_class"], k["drug_toxicity"], k["known_synergy"])
    ranked = R.beam_search(pools.select("patient", "drugs"), R.cut_lineage(R.drug_cards(drugs, pairs, owner)))
    return {r["patient"]: r for r in R.cohort_regimens(pools, ranked).collect()}


def test_published_regimens(spark):
    patients = {
        "AO-A128": "EGFR,EPHB3,ERBB2,FGR,FLT1,MATK,MERTK,MUSK,PTEN,TP53,TYK2",
        "A1-A0SO": "AR,BRCA1,EPHB3,LYN,TP53",
        "A2-A04P": "BRCA2,ERBB3,PIK3CA,TP53",
        "A2-A0T0": "ALK,BRCA2,PDGFRA,PTK2,SYK",
        "A7-A13E": "JAK1,TP53",
        "one-gene": "TP53",
    }
    out = _regimens(spark, patients, "Missense_Mutation")
    a = out["AO-A128"]
    assert (a["top_regimen"], a["top_score"], a["n_tied_top"], a["n_available_drugs"]) == ("afatinib + alpelisib + trastuzumab", 0.45, 2, 15)
    assert a["tied_regimens"].endswith("afatinib + capivasertib + trastuzumab")
    b = out["A1-A0SO"]
    assert (b["top_regimen"], b["top_score"], b["n_tied_top"], b["n_available_drugs"]) == ("adavosertib + bicalutamide", 0.1, 6, 6)
    assert (out["A2-A04P"]["top_regimen"], out["A2-A04P"]["top_score"]) == ("alpelisib + olaparib", 0.7)
    assert (out["A2-A0T0"]["top_score"], out["A2-A0T0"]["n_tied_top"], out["A2-A0T0"]["genes_with_no_drug_entry"]) == (0.2, 2, "PTK2")
    assert "one-gene" not in out
    assert _regimens(spark, {"A7-A13E": "JAK1,TP53"}, "Nonsense_Mutation")["A7-A13E"]["n_available_drugs"] == 4


def test_diff_names_the_drug_and_keeps_columns(spark):
    before = spark.createDataFrame([("p", "a + b", 0.1), ("q", "a + c", 0.2), ("r", None, None)], "patient string, top_regimen string, top_score double")
    after = spark.createDataFrame([("p", "a + d", 0.4), ("q", "a + c", 0.2), ("r", None, None)], "patient string, top_regimen string, top_score double")
    out = R.regimen_diff(before, after).collect()
    assert len(out) == 1 and out[0]["score_delta"] == pytest.approx(0.3) and out[0]["reason"] == "added: d; removed: b"
    assert R.regimen_diff(before, before).count() == 0 and "reason" in R.regimen_diff(before, before).columns


VCF = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	S
7	55249071	rs1	A	G	PASS	PASS	DP=150;AF=0.45;GENE=EGFR;EFFECT=missense_variant	GT	0/1
7	55100000	.	C	T	PASS	PASS	DP=20;SOMATIC	GT	0/1
1	5	.	C	T	PASS	PASS	AF=0.62;EFFECT=stop_gained	GT	0/1
short	line"""


def test_vcf_records_and_interval_lookup(spark):
    lines = spark.createDataFrame([("f", v) for v in VCF.split("\n")], "file string, value string")
    loci = spark.createDataFrame([("7", 55_000_000, 55_300_000, "EGFR", 1)], "chrom string, start long, end long, gene string, ord int")
    known = spark.createDataFrame([("EGFR",)], "gene string")
    v = {r["pos"]: r for r in V.parse_vcf(lines, known, loci).collect()}
    assert len(v) == 3
    assert v[55249071]["severity"] == 0.7 and v[55249071]["is_kinase"]
    assert v[55100000]["gene"] == "EGFR" and v[55100000]["effect"] == "unknown" and v[55100000]["depth"] == 20 and v[55100000]["allele_freq"] == 0.0
    assert v[5]["gene"] == "UNKNOWN" and v[5]["severity"] == 1.0 and not v[5]["is_kinase"]


def test_redundancy_values(spark):
    affected = spark.createDataFrame([("p", f"g{i}") for i in range(9)], "patient string, gene string")
    gp = spark.createDataFrame([(f"g{i}", "big") for i in range(9)] + [("g0", "two"), ("g1", "two"), ("g2", "one")], "gene string, pathway string")
    out = {r["pathway"]: r["redundancy"] for r in V.pathway_redundancy(affected, gp).collect()}
    assert out == {"big": 0.865, "two": 0.444, "one": 0.0}


def test_empirical_p_and_quantile_groups(spark):
    null = spark.createDataFrame([(float(v),) for v in range(99)], "null_score double")
    r = K.empirical_p_z(null, 97.0).first()
    assert r["empirical_p"] == pytest.approx(3 / 100) and r["z"] == pytest.approx((97 - 49) / np.std(range(99), ddof=1))
    g = K.quantile_groups(null, "null_score").groupBy("risk_group").count().collect()
    assert sorted(x["count"] for x in g) == [33, 33, 33]
