"""Null models are registered at the published number of replicates."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
@pytest.mark.parametrize("name", ["i05_null_shuffled_scores", "i07_null_shuffled_edges", "i12_second_network_null", "i06_null_rewired_network", "g06_rewired_degrees"])
def test_null_model_has_all_replicates(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert sorted(r.replicate for r in rows) == list(range(1000))
    if name == "g06_rewired_degrees":
        assert {r.degree_change for r in rows} == {0}
