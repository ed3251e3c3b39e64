"""Every registered query against its SQL check on the smallest folder."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()
FAST = [
    "d01_target_score_parts", "c05_panel_pair_scores", "e02_redundancy_penalised_pairs", "d11_funnel_counts", "h12_cohort_regimens", "a09_vcf_variants", "i03_entity_weight_draws",
    "e14_benjamini_hochberg", "b13_median_split", "k03_kaplan_meier", "k10_concordance", "g05_connected_components", "k21_identity_baseline", "l06_discovery", "m12_input_report",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
@pytest.mark.parametrize("name", FAST if not os.environ.get("ALL_QUERIES") else list(CHECKS))
def test_query_equals_check(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck(SF).execute(CHECKS[name]).df()) is None


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry.queries())
