"""Vectors against brute force; the weak-label model on planted labellers and held-out labels; the pipeline's stages."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from targetloom.llm import grid_order, weak_labels
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    x = [c + rng.normal(scale=s, size=12) for c in centres for s in (0.1, 0.25, 0.4) for _ in range(12)]
    rows = [(i, [float(v) for v in np.float32(u)]) for i, u in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [2 * v for v in rows[3][1]]), (2001, None), (2002, []), (2003, [0.0] * 12), (2004, [float("nan")] * 12)]
    rows += [(2005, [None] + [1.0] * 11), (2006, [float("inf")] + [1.0] * 11), (2007, [1.0, 2.0]), (2008, [1.0, 2.01]), (2009, [-1.0, -2.0]), (None, rows[0][1]), (None, [3.0] * 3)]
    rows += [(1000, rows[0][1])]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, `key` string, dim int")
    got = grid_order.near_vectors(table, block=block).collect()
    unit = []
    for _, v in rows:
        good = v and None not in v and np.isfinite(np.float32(v)).all() and any(v)
        unit.append(np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if good else None)
    link = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95] for i, a in enumerate(unit)]
    want = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in link[todo.pop()] if j not in seen and not seen.add(j)]
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((name, len(link[i]), low, name == low))
    assert brute.same_rows(got, want)
    assert grid_order.near_vectors(table.where("false"), block=block).count() == 0


def test_accuracies_of_planted_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(200_000) < 0.8
    right, voting = np.array([0.95, 0.9, 0.99, 0.85]), np.array([0.9, 0.7, 0.5, 1.0])
    votes = np.where(rng.random((len(truth), 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) > voting] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, tables, good = weak_labels.fit_accuracies(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    assert np.abs(tables[1][:, 1] - right).max() < 0.02 and np.abs(tables[0][:, 0] - right).max() < 0.03
    guess = dict(zip(map(tuple, patterns.tolist()), good > 0.5))
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_scores_of_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, brute.prose(rng, 80)) for i in range(60)] + [(100 + i, "&&& *** " * 60) for i in range(12)] + [(200, None), (200, ""), (None, " \n"), (201, "word " * 40_000)]
    docs = brute.documents(spark, rows, clashing=True)
    got = weak_labels.score_quality(docs)
    assert [c for c in got.columns if c not in ("posterior", "score", "keep")] == [c for c in docs.columns if c not in ("score", "keep")]
    kept = {r.doc_id for r in got.where("keep").collect()}
    assert kept == set(range(60))
    assert {r.score for r in got.where("text is null or trim(text) in ('', '\\n')").collect()} == {0.0}
    assert weak_labels.score_quality(brute.documents(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
def test_held_out_labels(spark):
    """The labels are never shown to the model: all of them are held out."""
    scored = weak_labels.op1_weak_labels(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (scored.keep[scored.quality == 1]).mean() > 0.99
    assert (~scored.keep[scored.quality == 0]).mean() > 0.95


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in brute.awkward(9) if r[0] is not None] + [(400 + i, "&&& *** " * 60) for i in range(8)]
    docs = brute.documents(spark, rows)
    stages = dict(pipeline.STAGES)
    good = stages["quality"](spark, docs, "")
    assert good.columns == docs.columns
    assert not {r.doc_id for r in good.collect()} & {0, 1, 2, *range(400, 408)}
    once = stages["exact"](spark, docs, "")
    assert sorted(brute.normal(r.text) for r in once.collect()) == sorted({brute.normal(t) for _, t in rows})
    rows = [(r.doc_id, r.text) for r in once.collect()]
    near = stages["near"](spark, once, "")
    groups, sets = brute.near_groups(rows, 80, 5)
    want = {i for (i, _), s in zip(rows, sets) if not s} | {min(i for g2, s2, (i, _) in zip(groups, sets, rows) if g2 == g and s2) for g, s in zip(groups, sets) if s}
    assert {r.doc_id for r in near.collect()} == want
    cut = stages["passages"](spark, near, "")
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.where("text is not null").collect())
    tokens = {r.doc_id: len(brute.words(r.text)) for r in cut.collect()}
    left = {i: n - gone for i, n, gone, _ in brute.cut_words([(r.doc_id, r.text) for r in near.collect()], 35)}
    assert tokens == left
    assert {r.doc_id for r in stages["packed"](spark, cut, "").collect()} == set(tokens)


def test_quality_stage_gives_clashing_columns_back(spark):
    """Columns named as the classifier's own, null and repeated identifiers, an empty table and one without n_chars."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    rows = [*brute.awkward(11), *[(700 + i, "&&& *** " * 60) for i in range(4)]]
    plain = brute.documents(spark, rows)
    names = ("keep", "score", "posterior", "_scored", "column_3", "slots")
    clashing = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.md5("text"), F.lit("none"))).alias(c) for c in names])
    want = sorted((str(r.doc_id), r.text) for r in stages["quality"](spark, plain, "").collect())
    got = stages["quality"](spark, clashing, "")
    assert got.columns == clashing.columns and got.dtypes == clashing.dtypes
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want and want
    assert got.where(" or ".join(f"`{c}` <> concat('{c} of ', md5(text))" for c in names)).isEmpty()
    assert stages["quality"](spark, clashing.where("false"), "").count() == 0
    assert stages["passages"](spark, plain.drop("n_chars").where("doc_id < 12"), "").columns == [c for c in plain.columns if c != "n_chars"]
