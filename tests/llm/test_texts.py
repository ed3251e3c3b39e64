"""Exact, near and substring deduplication against brute force, on awkward small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.llm import anchors, components, content_sort, debruijn, prefix_orders, suffix_arrays
from tests.llm import brute


@pytest.mark.parametrize("parts", ["2", "7"])
def test_exact_groups(spark, parts):
    rows = brute.awkward(3) + [(i, "hot\ttext") for i in range(1000, 1200)]  # salted: above a quarter of a range's share
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = content_sort.exact_groups(brute.documents(spark, rows, clashing=True)).collect()
        kept = content_sort.drop_exact(brute.documents(spark, rows, clashing=True))
        assert kept.columns == brute.documents(spark, rows, clashing=True).columns
        kept = kept.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(brute.normal(t), []).append(i)
    want = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            want.append((i, low, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    assert brute.same_rows(got, want)
    assert sorted(brute.normal(r.text) for r in kept) == sorted(groups)


@pytest.mark.parametrize("block", [512, 5])
def test_near_components(spark, block):
    rows = brute.awkward(4, near=40)
    got = prefix_orders.near_components(brute.documents(spark, rows, clashing=True), block=block).collect()
    assert brute.same_rows(got, brute.near_components(rows))


def test_near_chain_and_hot_passage(spark):
    """A chain whose ends are far apart, and a passage that makes up half of many unrelated texts."""
    rng = random.Random(8)
    chain = [brute.prose(rng, 200).split()]
    for _ in range(30):
        words = list(chain[-1])
        at = rng.randrange(len(words))
        words[at : at + 5] = [f"new{rng.randint(0, 10**6)}" for _ in range(5)]
        chain.append(words)
    passage = brute.prose(rng, 60)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)] + [(500 + i, brute.prose(rng, 50) + " " + passage) for i in range(60)]
    got = prefix_orders.near_components(brute.documents(spark, rows), block=4).collect()
    assert brute.same_rows(got, brute.near_components(rows))


def test_drop_near_keeps_one(spark):
    rows = brute.awkward(5)
    docs = brute.documents(spark, rows, clashing=True)
    kept = prefix_orders.drop_near(docs, percent=80, size=5)
    assert kept.columns == docs.columns
    groups, sets = brute.near_groups(rows, 80, 5)
    lone = [i for (i, _), s in zip(rows, sets) if not s]
    ids = [r.doc_id for r in kept.collect()]
    low: dict[int, list] = {}
    for g, s, (i, _) in zip(groups, sets, rows):
        if s:
            low.setdefault(g, []).append(i)
    want = lone + [min((i for i in m if i is not None), default=None) for m in low.values()]
    assert sorted(set(map(str, ids))) == sorted(set(map(str, want)))


def test_drop_near_without_usable_identifiers(spark):
    """Unrelated texts with no identifier or with the same one: each component keeps one text, compared as texts."""
    rng = random.Random(14)
    rows = [(i, brute.prose(rng, 120)) for i in [None] * 12 + [7] * 12]
    for i, text in rows[:6] + rows[12:18]:
        words = text.split()
        words[60] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(None, rows[0][1]), (9, rows[1][1]), (None, None), (None, ""), rows[20], (50, "twice the same row here"), (50, "twice the same row here")]
    kept = [r.text for r in prefix_orders.drop_near(brute.documents(spark, rows, clashing=True), percent=80, size=5).collect()]
    groups, sets = brute.near_groups(rows, 80, 5)
    of_text = {t: g for g, s, (_, t) in zip(groups, sets, rows) if s}
    assert sorted(of_text[t] for t in kept if t) == sorted(set(of_text.values()))
    assert sorted(map(repr, (t for t in kept if not t))) == ["''", "None"]


def test_texts_of_one_identifier_with_equal_short_hashes(spark):
    """Two texts without an identifier whose 32-bit hashes are equal: neither takes the other's cuts or place."""
    short = "".join(f"lft{i:04d} " for i in range(60)) + "00084756"
    long = "".join(f"rgt{i:04d} " for i in range(200)) + "00171936"
    assert spark.range(1).select(F.hash(F.lit(short)) == F.hash(F.lit(long))).first()[0]
    rows = [(None, short), (None, long), (1, " ".join(long.split()[100:160])), (2, " ".join(short.split()[:20])), (3, long + " more")]
    docs = brute.documents(spark, rows)
    assert brute.same_rows(debruijn.drop_passages(docs, 12, 3, measure_only=True).collect(), brute.cut_words(rows, 12))
    assert brute.same_rows(suffix_arrays.drop_repeats(docs, 60, 9).collect(), brute.cut_bytes(rows, 60))
    assert sorted(r.text for r in prefix_orders.drop_near(docs).collect()) == sorted(t for _, t in rows if t != long)


@pytest.mark.parametrize("window,k", [(35, 9), (6, 2)])
def test_passages(spark, window, k):
    rows = brute.awkward(6)
    got = debruijn.drop_passages(brute.documents(spark, rows, clashing=True), window, k, measure_only=True).collect()
    assert brute.same_rows(got, brute.cut_words(rows, window))


def test_passages_as_documents(spark):
    rows = brute.awkward(7)
    docs = brute.documents(spark, rows, clashing=True)
    got = debruijn.drop_passages(docs)
    assert got.columns == docs.columns
    texts = sorted(hashlib.sha256(b" ".join(brute.words(r.text))).hexdigest() for r in got.collect())
    assert texts == sorted(r[3] for r in brute.cut_words(rows, 35))
    assert {r.text for r in got.where("doc_id = 6").collect()} == {t for i, t in rows if i == 6}


def test_branching_passages(spark):
    """Passages whose middles are shared by different pairs, so that no path covers the crossing windows."""
    rng = random.Random(9)
    a, b, c = (brute.prose(rng, 20) for _ in range(3))
    rows = [(1, f"{a} {b}"), (2, f"{b} {c}"), (3, f"{a} {b} {c}"), (4, f"{c} {a}"), (5, f"{a} {a} {a}")]
    for window, k in ((12, 3), (25, 5), (35, 9)):
        got = debruijn.drop_passages(brute.documents(spark, rows), window, k, measure_only=True).collect()
        assert brute.same_rows(got, brute.cut_words(rows, window))


@pytest.mark.parametrize("window,k,zones", [(200, 32, 2000), (40, 8, 2), (12, 4, 3)])
def test_repeats(spark, window, k, zones):
    rows = [r for r in brute.awkward(10) if r[0] != 6] + [(700, "ab" * 300), (701, "é" * 150)]
    got = suffix_arrays.drop_repeats(brute.documents(spark, rows, clashing=True), window, k, zones).collect()
    assert brute.same_rows(got, brute.cut_bytes(rows, window))


def test_sites_of_texts_of_any_length():
    """A text of more than 2**24 tokens has the sites that its end has by itself, and pieces change no place."""
    n, tail = (1 << 24) + 5000, 20_000
    runs = np.arange(n, dtype=np.uint64) % np.uint64(9973)
    whole = anchors.find_sites(runs, np.array([0, n]), 40, 9)
    end = anchors.find_sites(runs[-tail:], np.array([0, tail]), 40, 9)
    inside = whole.low > n - tail + 40
    assert whole.high[-1] == n - 40 and (np.diff(whole.low) == (whole.high - whole.low + 1)[:-1]).all()
    for a, b in ((whole.at, end.at), (whole.low, end.low), (whole.high, end.high)):
        assert (a[inside] - (n - tail) == b[-inside.sum() :]).all()
    some = runs[:3000]
    for piece in (1, 7, 1000):
        assert (anchors.smallest_places(some, 32, piece) == anchors.smallest_places(some, 32)).all()


def test_suffix_array_and_common_prefixes():
    rng = random.Random(11)
    for _ in range(60):
        zones = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        window = rng.choice([2, 5, 9])
        size = np.array([max(0, len(z) - window + 1) for z in zones])
        zone, start, group, _ = suffix_arrays.equal_windows(zones, size, window)
        texts = [zones[z][s : s + window] for z, s in zip(zone, start)]
        assert len(texts) == size.sum() and all(len(t) == window for t in texts)
        assert len(set(zip(group.tolist(), texts))) == len(set(texts)) == len(set(group.tolist()))


def test_component_labels(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(350)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = dict(components.component_labels(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect())
    ends, low = components.smallest_labels(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert got == dict(zip(ends.tolist(), low.tolist()))
    assert got[300] == 0 and got[5000] == 5000


def test_empty_tables(spark):
    docs = brute.documents(spark, [], clashing=True)
    assert content_sort.exact_groups(docs).count() == content_sort.drop_exact(docs).count() == 0
    assert prefix_orders.near_components(docs).count() == prefix_orders.drop_near(docs).count() == 0
    assert debruijn.drop_passages(docs, measure_only=True).count() == debruijn.drop_passages(docs).count() == 0
    assert suffix_arrays.drop_repeats(docs).count() == 0
    assert components.component_labels(spark.createDataFrame([], "u long, v long")).count() == 0


def test_only_blank_texts(spark):
    docs = brute.documents(spark, [(1, None), (2, ""), (3, " ")])
    assert brute.same_rows(prefix_orders.near_components(docs).collect(), [(1, 0, 1), (2, 0, 2), (3, 0, 3)])
    assert debruijn.drop_passages(docs, measure_only=True).agg(F.sum("n_removed")).first()[0] == 0
    assert suffix_arrays.drop_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0
