from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from targetloom.functions import text as T
from targetloom.operators import learning as L
from targetloom.operators import literature as Lit
from targetloom.operators import quality as Q
from targetloom.sources import landed as A
from targetloom.sources import sinks


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("ERLOTINIB HYDROCHLORIDE", "erlotinib"), ("drug (sodium)", "drug"), ("brentuximab vedotin", "brentuximab vedotin"), ("sunitinib s-malate", "sunitinib"),
])
def test_drug_names(spark, raw, want):
    assert one(spark, raw, T.normalised_drug_name) == want


@pytest.mark.parametrize("raw,want", [
    ("afatinib", True), ("inhibitor", False), ("nvp-bhg712", False), ("5-fluorouracil", True), ("compound 12 [PMID 1]", False), ("CHEMBL123", False), ("thing inhibitor 3", False), ("", False),
])
def test_real_drug_rules(spark, raw, want):
    assert one(spark, raw, T.looks_like_drug) is want


def test_candidates_and_context(spark):
    text = "Gene therapy by celgene. Olaparib and eprenetapopt were given; élapatinib too. Cells were resistant to olaparib. A combination of olaparib was synergistic."
    assert one(spark, text, T.candidate_drugs) == ["eprenetapopt"] or "olaparib" in one(spark, text, T.candidate_drugs)
    df = spark.createDataFrame([(text, "olaparib"), (text, "eprenetapopt"), ("It shows resistance to x1drug but is promising x1drug.", "x1drug")], "t string, d string")
    got = [r[0] for r in df.select(T.mention_context("t", "d")).collect()]
    assert got == ["cautionary", "unclear", "cautionary"]


def test_merge_keeps_only_confirmed(spark):
    pool = spark.createDataFrame([("G", "a")], "gene string, drug string")
    found = spark.createDataFrame(
        [("G", "b", "1", True, "supportive"), ("G", "b", "2", True, "unclear"), ("G", "c", "3", False, "supportive"), ("G", "a", "4", True, "supportive")],
        "gene string, candidate_drug string, pmid string, confirmed boolean, mention_context string",
    )
    out = {r["drug"]: r["pmids"] for r in Lit.merge_candidates(pool, found).collect()}
    assert out == {"a": [], "b": ["1", "2"]}
    strict = {r["drug"]: r["pmids"] for r in Lit.merge_candidates(pool, found, True).collect()}
    assert strict["b"] == ["1"]


def test_gzip_maf_and_star_files(spark, tmp_path):
    folder = tmp_path / "maf"
    folder.mkdir()
    head = "#version 2.4\nHugo_Symbol\tVariant_Classification\tTumor_Sample_Barcode\n"
    with gzip.open(folder / "a.maf.gz", "wt") as fh:
        fh.write(head + "EGFR\tMissense_Mutation\tTCGA-AA-0001-01A\nTP53\tSilent\tTCGA-AA-0002-01A\n")
    assert A.read_maf(spark, str(folder)).count() == 2
    star = tmp_path / "star" / "sub"
    star.mkdir(parents=True)
    (star / "x.tsv").write_text("# comment\ngene_id\tgene_name\ttpm_unstranded\nN_unmapped\t\t9\nE1\tEGFR\t1.5\nE2\tEGFR\t2.5\nE3\tSRC\tbad\n")
    got = {r["gene"]: r["value"] for r in A.read_star_counts(spark, str(tmp_path / "star")).collect()}
    assert got == {"EGFR": 2.5, "SRC": None}
    (tmp_path / "genes.txt").write_text("EGFR\n\n  SRC \n")
    assert sorted(r["gene"] for r in A.read_gene_list(spark, str(tmp_path / "genes.txt")).collect()) == ["EGFR", "SRC"]
    kinds = {r["kind"]: r["n_files"] for r in A.file_inventory(A.list_files(spark, str(tmp_path)), {"maf": r"\.maf", "counts": r"\.tsv$"}).collect()}
    assert kinds == {"maf": 1, "counts": 1, "other": 1}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "p"), (1, "q")], "stage int, participant_id string")
    sinks.write_stage_audit(df, str(tmp_path / "audit"))
    assert sorted(os.listdir(tmp_path / "audit"))[-2:] == ["stage=0", "stage=1"]
    for fmt in ("csv", "tsv", "json"):
        sinks.write_table(df, str(tmp_path / fmt), fmt)
    assert A.read_table(spark, str(tmp_path / "csv")).count() == 2


def test_alias_resolution_and_schemas(spark):
    df = spark.createDataFrame([(1, 2)], "Node1 int, combined_score int")
    assert Q.resolve_columns(df, {"source": ["protein1", "node1"], "score": ["combined_score"]}).columns == ["source", "score"]
    with pytest.raises(ValueError):
        Q.resolve_columns(df, {"x": ["nope"]})
    assert Q.accepted_schema(df, {"a": ["z"], "b": ["Node1"]}) == "b"


def test_splits_are_disjoint(spark):
    df = spark.range(500).select((F.col("id") % 23).cast("string").alias("drug_row"), (F.col("id") % 19).cast("string").alias("drug_col"))
    out = L.unseen_drug_split(df, val=0.2, test=0.2)
    seen = {}
    for r in out.select("split", F.explode(F.array("drug_row", "drug_col")).alias("d")).distinct().collect():
        assert seen.setdefault(r["d"], r["split"]) == r["split"]
    folds = L.balanced_group_folds(df, "drug_row", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5, 6, 6, 6]


def test_row_split_has_exact_counts_and_empty_splits_are_refused(spark):
    df = spark.range(1003).select((F.col("id") * 7 - 50).alias("key"))
    counts = {r["split"]: r["count"] for r in L.row_split(df, "key", 0.15, 0.2).groupBy("split").count().collect()}
    assert counts == {"test": 201, "val": 150, "train": 652}
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "p string, q string")
    with pytest.raises(ValueError, match="no rows"):
        L.unseen_both_split(pairs, "p", "q", 0.3, 0.3)
    rows = spark.createDataFrame([(f"d{i % 9}", "test" if i % 3 else "train") for i in range(60)], "drug string, split string")
    test = {r.drug for r in rows.where("split = 'test'").collect()}
    assert {r.drug for r in L.candidate_sample(rows, ["drug"], 50).collect()} == test and L.candidate_sample(rows, ["drug"], 2).count() == 2


def test_patient_ids_as_barcode_fragments(spark):
    from targetloom.operators.cohort import altered_genes_by_fragment

    maf = spark.createDataFrame([("G1", "TCGA-AA-0001-01A"), ("G2", "TCGA-AA-0001-01A"), ("G1", "TCGA-AB-0002-01A")], "Hugo_Symbol string, Tumor_Sample_Barcode string")
    panel = spark.createDataFrame([("G1",), ("G2",)], "gene string")
    ids = spark.createDataFrame([("AA-0001",), ("TCGA-AB-0002",), ("ZZ-9",)], "patient string")
    got = {r["patient"]: r["genes"] for r in altered_genes_by_fragment(maf, panel, ids).collect()}
    assert got == {"AA-0001": ["G1", "G2"], "TCGA-AB-0002": ["G1"]}
