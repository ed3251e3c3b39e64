"""Rows that several parts of a query read are computed once."""

from __future__ import annotations

import os

import pytest

from targetloom.plans import load_all
from targetloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
@pytest.mark.parametrize("name", ["k04_logrank_all_genes", "m06_gene_effect_checks"])
def test_result_reads_no_large_table(spark, name):
    load_all()
    out = QUERIES[name](spark, SF)
    assert out.count() > 0
    assert "l_quantity" not in out._jdf.queryExecution().optimizedPlan().toString()
