"""Cohort choices on clashing barcodes, logarithms at zero."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from targetloom.functions.numeric import log_of
from targetloom.operators import cohort as C


def test_one_aliquot_of_equal_barcodes(spark):
    rows = [("TCGA-01-1234-01A", "LumA"), ("TCGA-01-1234-01A", "Basal"), ("TCGA-01-1234-01A", "Basal"), ("TCGA-01-1234-11A", "Her2"), ("TCGA-02-0002-01A", "LumB")]
    got = C.one_aliquot_per_participant(spark.createDataFrame(rows, "barcode string, subtype string")).collect()
    assert sorted(tuple(r) for r in got) == [("TCGA-01-1234", "TCGA-01-1234-01A", "Basal"), ("TCGA-02-0002", "TCGA-02-0002-01A", "LumB")]


def test_funnel_counts_a_clashing_participant_once(spark):
    subtypes = spark.createDataFrame([("TCGA-01-1234-01A", "Basal"), ("TCGA-01-1234-01A", "LumA"), ("TCGA-01-1234-01A", "Basal")], "barcode string, subtype string")
    maf = spark.createDataFrame([("TCGA-01-1234-01A", "g", "Silent")], "Tumor_Sample_Barcode string, Hugo_Symbol string, Variant_Classification string")
    panel = spark.createDataFrame([("g",)], "gene string")
    audit = C.cohort_funnel(subtypes, maf, panel, None)
    assert sorted(tuple(r) for r in audit.collect()) == [(0, "TCGA-01-1234"), (1, "TCGA-01-1234"), (2, "TCGA-01-1234")]


def test_logarithm_of_zero_is_minus_infinity(spark):
    v = F.col("v")
    rows = spark.createDataFrame([(0.0,), (8.0,), (None,)], "v double").select(log_of(F.log2(v), v)).collect()
    assert [r[0] for r in rows] == [-math.inf, 3.0, None]
