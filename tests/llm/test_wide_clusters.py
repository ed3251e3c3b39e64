"""Clusters that chance tokens chain together: parted before sets are copied for verification."""

import random

import numpy as np
import pytest

from targetloom.llm import prefix_orders
from tests.llm import brute


def test_no_linked_pair_is_denied():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, int(k), dtype=np.int64).astype(np.uint64)) for k in (1, 2, 7, 40, 500, 70_000)]
    sets += [np.append(s[: max(1, len(s) * 9 // 10)], s[:1] + np.uint64(i)) for i, s in enumerate(sets)] + [sets[-1][:66_000]]
    counts = np.stack([np.frombuffer(prefix_orders.bucket_counts(s), "<u2") for s in sets])
    n = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    for percent in (50, 80, 85, 100):
        may = prefix_orders.may_link(n[a], counts[a], n[b], counts[b], percent)
        shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
        assert may[100 * shared >= percent * (n[a] + n[b] - shared)].all()
        assert not may.all()


@pytest.mark.parametrize("rows_at_once", [8, 1 << 14])
def test_chained_sets_are_not_held_against_each_other(spark, monkeypatch, rows_at_once):
    """Each text shares half of itself with the next one; a few are near copies, more of one than a block holds."""
    rng = random.Random(8)
    parts = [brute.prose(rng, 40) for _ in range(41)]
    rows = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(40)]
    rows += [(100 + i, rows[7][1] + f" x{i}") for i in range(9)] + [(200, rows[20][1] + " end")]
    copied, units = [], prefix_orders._units
    monkeypatch.setattr(prefix_orders, "_units", lambda r, percent: (copied.append(r.count()), units(r, percent))[1])
    monkeypatch.setattr(prefix_orders, "LIST_ROWS", rows_at_once)
    got = prefix_orders.near_components(brute.documents(spark, rows), block=4).collect()
    assert brute.same_rows(got, brute.near_components(rows))
    assert len({r.component_id for r in got}) == 40
    assert sum(copied) < 4 * len(rows)


def test_second_round_goes_by_pieces(spark, monkeypatch):
    """What the first block leaves is held against all, ``ROUND_BLOCKS`` blocks of it at a time."""
    rng = random.Random(5)
    base = brute.prose(rng, 30).split()
    # a ring of small steps: neighbours are near, others are not, and every token is in many texts
    rows = [(i, " ".join([w if (j - i) % 30 > 14 else f"{w}{(i + 15 - j) // 30}" for j, w in enumerate(base)])) for i in range(60)]
    sizes, units = [], prefix_orders._units
    monkeypatch.setattr(prefix_orders, "_units", lambda r, percent: (sizes.append(r.count()), units(r, percent))[1])
    got = prefix_orders.near_components(brute.documents(spark, rows), percent=60, block=4).collect()
    rounds, most = len(sizes), max(sizes)
    monkeypatch.setattr(prefix_orders, "ROUND_BLOCKS", 1000)
    sizes.clear()
    again = prefix_orders.near_components(brute.documents(spark, rows), percent=60, block=4).collect()
    assert brute.same_rows(got, brute.near_components(rows, 60)) and brute.same_rows(again, brute.near_components(rows, 60))
    assert len(sizes) == 2 and rounds > 2 and most < max(sizes)


def test_near_stage_copies_no_chained_sets(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    parts = [brute.prose(rng, 40) for _ in range(701)]
    rows = [(i, f"{parts[i]} {parts[i + 1]}") for i in range(700)]  # one chain, above a block of 512
    copied, units = [], prefix_orders._units
    monkeypatch.setattr(prefix_orders, "_units", lambda r, percent: (copied.append(r.count()), units(r, percent))[1])
    kept = dict(pipeline.STAGES)["near"](spark, brute.documents(spark, rows + [(900, rows[3][1] + " end")]), "")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(700))
    assert sum(copied) < 100
