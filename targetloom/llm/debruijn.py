"""Repeated long passages by De Bruijn compaction.

Anchors of the documents' windows are the nodes; the token k-mer from one anchor to the end of the next is the edge
between them.  A node that is met at least twice and whose occurrences all go on along the same edge does not branch
there.  A Spark join brings each node's branching to its occurrences, and per document neighbouring nonbranching nodes
compact into paths: every window inside the path around a repeated node occurs wherever that node does.  Windows that
reach over a branching are read again at their source coordinates and verified by a 128-bit hash of their tokens.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from targetloom.llm import anchors
from targetloom.llm.registry import query, table
from targetloom.llm.wordgrid import prefix_hash, signed, span_hash, words_of
from targetloom.session import cut_lineage

WINDOW = 35
ANCHOR = 9


def _sites(docs: DataFrame, window: int, k: int, nodes_only: bool) -> DataFrame:
    """Sites of all documents: node hash, and unless ``nodes_only`` its edges, place and windows."""

    def work(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        words = words_of(texts)
        one, two = (prefix_hash(words.hashes(lane), lane) for lane in (0, 1))
        n = len(words.start)
        place = np.arange(n)
        runs = span_hash(one, place, np.minimum(place + k, n), 0)
        s = anchors.find_sites(runs, words.first, window, k)
        out = {"row": s.text, "h": signed(runs[s.at])}
        if not nodes_only:
            edge = signed(span_hash(two, s.at[:-1], s.at[1:] + k, 1)) if len(s.at) else np.zeros(0, dtype=np.int64)
            apart = np.diff(s.text) != 0
            base = words.first[s.text]
            out["e_prev"] = pa.array(np.append(0, edge)[: len(s.at)], mask=np.append(True, apart)[: len(s.at)])
            out["e_next"] = pa.array(np.append(edge, 0)[: len(s.at)], mask=np.append(apart, True)[: len(s.at)])
            out |= {c: (x - base).astype(np.int32) for c, x in (("at", s.at), ("low", s.low), ("high", s.high))}
        return out

    if nodes_only:
        return anchors.over_texts(docs, "h long", work, carry=())
    return anchors.over_texts(docs, "h long, e_prev long, e_next long, at int, low int, high int", work, carry=("th",))


def removable_spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(th, a, b) of the documents that hold a window met elsewhere: word spans [a, b) to remove.

    ``docs`` comes from ``anchors.keyed``; th alone names its rows here, which keeps the shuffles small.
    """
    met = _sites(docs, window, k, nodes_only=True).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    sites = cut_lineage(_sites(docs, window, k, nodes_only=False).join(met, "h", "left_semi"))
    all_of = F.count(F.lit(1))
    nodes = sites.groupBy("h").agg(
        ((F.min("e_prev") == F.max("e_prev")) & (F.count("e_prev") == all_of)).alias("one_before"),
        ((F.min("e_next") == F.max("e_next")) & (F.count("e_next") == all_of)).alias("one_after"),
    )
    # the path around a node: back to the last node with several predecessors, on to the next with several successors
    order = Window.partitionBy("th").orderBy("at")
    back = F.max(F.when(~F.coalesce("one_before", F.lit(False)), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    on = F.min(F.when(~F.coalesce("one_after", F.lit(False)), F.col("at"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    paths = sites.join(nodes, "h").select("th", "at", "low", "high", back.alias("path_start"), (on + k).alias("path_stop"))
    sure = F.struct(F.greatest("low", "path_start").alias("a"), F.least("high", F.col("path_stop") - window).alias("b"))
    judged = cut_lineage(paths.withColumn("sure", sure).select("th", "low", "high", F.when(F.col("sure.a") <= F.col("sure.b"), F.col("sure")).alias("sure")))
    certain = judged.where("sure is not null").select("th", F.col("sure.a").alias("a"), (F.col("sure.b") + window).alias("b"))
    parts = F.when(F.col("sure").isNull(), F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")))).otherwise(
        F.array(F.struct(F.col("low").alias("a"), (F.col("sure.a") - 1).alias("b")), F.struct((F.col("sure.b") + 1).alias("a"), F.col("high").alias("b")))
    )
    open_parts = judged.select("th", F.explode(parts).alias("p")).where("p.a <= p.b")
    asked = open_parts.select("th", F.col("p.a").alias("a"), (F.col("p.b") + 1).alias("b"))

    def verify(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        words = words_of(texts)
        one, two = (prefix_hash(words.hashes(lane), lane) for lane in (0, 1))
        row, start = [], []
        for i, spans in enumerate(anchors.ranges_of(batch.column("spans"), first, len(texts))):
            at = np.unique(np.concatenate([np.arange(a, b) for a, b in spans.tolist()]))
            row.append(np.full(len(at), i))
            start.append(at + words.first[i])
        row, at = np.concatenate(row), np.concatenate(start)
        return {"row": row, "w1": signed(span_hash(one, at, at + window, 0)), "w2": signed(span_hash(two, at, at + window, 1)), "a": (at - words.first[row]).astype(np.int32)}

    windows = cut_lineage(anchors.over_texts(_with_spans(docs, asked, "inner"), "w1 long, w2 long, a int", verify, carry=("th",)))
    # rows that share identifier and text are one row here; each of them counts, so theirs are met elsewhere
    met_again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    verified = windows.join(met_again, ["w1", "w2"], "left_semi").select("th", "a", (F.col("a") + window).alias("b"))
    return certain.unionByName(verified)


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Documents with their spans as one flat array; a document has no more of them than tokens."""
    listed = spans.groupBy("th").agg(F.flatten(F.collect_set(F.array("a", "b"))).alias("spans"))
    listed = listed.select(F.col("th").alias("s_th"), "spans")
    return docs.join(listed, F.col("th") == F.col("s_th"), how).drop("s_th")


def drop_passages(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", measure_only: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` cut to the words that no repeated window covers, joined by one space.

    Removed is every word in a window of ``window`` words (no ASCII white space inside words, case kept) whose words
    also start anywhere else, the same document included.  Rows without such a window keep their text as it is.  A null
    or empty text and one of fewer words stay as they are; rows repeated in full are copies of each other; an empty
    table gives none.  With ``measure_only`` the result is (doc_id, n_words, n_removed, kept_sha256) instead, the digest
    that of the kept words joined by one space.
    """
    rows = anchors.keyed(docs, id_col, text_col) if measure_only else docs.withColumns({"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select(
        F.col(id_col).alias("doc_id"), anchors.row_digest(F.col(id_col), F.col(text_col)).alias("th"), F.col(text_col).alias("text"), "_row"
    )
    spans = removable_spans(rows.select("th", "text"), window, k)
    marked = _with_spans(rows, spans, "left")

    def cut(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        spans = anchors.ranges_of(batch.column("spans"), first, len(texts))
        n_words, n_removed, kept = [], [], []
        for text, own in zip(texts, spans):
            words = text.split()
            gone = anchors.covered(len(words), own) if len(own) else np.zeros(len(words), dtype=bool)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            rest = b" ".join(words if not len(own) else [words[i] for i in np.flatnonzero(~gone).tolist()])
            kept.append(hashlib.sha256(rest).hexdigest() if measure_only else rest.decode() if len(own) else None)
        out = {"row": np.arange(len(texts)), "n_words": np.array(n_words, dtype=np.int64), "n_removed": np.array(n_removed, dtype=np.int64), "kept": pa.array(kept, pa.string())}
        return out

    if measure_only:
        return anchors.over_texts(marked, "n_words long, n_removed long, kept string", cut, carry=("doc_id",)).withColumnRenamed("kept", "kept_sha256")
    done = anchors.over_texts(marked, "kept string", cut, carry=("_row",))
    columns = [F.coalesce("kept", F.col("_row").getField(c)).alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns)


@query("op5_debruijn")
def op5_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_passages(table(spark, sf_dir, "documents"), measure_only=True)
