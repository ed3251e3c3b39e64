"""Packing token sequences: first-fit decreasing with a tournament tree, inside randomised groups of documents.

A document is cut into full sequences and one remainder.  Full sequences need no partner; remainders are packed inside
groups of about ``group_docs`` documents drawn by a hash of where the row was read, so a group is a bounded random
sample whatever the sources look like, and no text or token id is shuffled - only one small row per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.byte_pairs import encoder
from targetloom.llm.registry import query, table

LENGTH = 2048
GROUP_DOCS = 4096


class CapacityTree:
    """Tournament tree over bins in opening order: a node holds the largest free capacity below it."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def first_with(self, need: int) -> int:
        """Index of the first bin with ``need`` free; there is one for each leaf that is still empty."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        return node - self.size

    def take(self, index: int, need: int) -> int:
        """Use ``need`` of a bin and return what was free before."""
        best, node = self.best, index + self.size
        free = best[node]
        best[node] = free - need
        node //= 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            top = left if left > right else right
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are taken longest first, ties in the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree = CapacityTree(max(1, len(lengths)), capacity)
    sizes = lengths.tolist()
    for i in order.tolist():
        at = tree.first_with(sizes[i])
        offsets[i] = capacity - tree.take(at, sizes[i])
        bins[i] = at
    return bins, offsets


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``doc_tokens`` counts the end id, so a null or empty text is one piece of one id.  A sequence that is not full is
    padded up to ``length`` by whoever writes it.  Repeated and null identifiers are documents of their own; an empty
    table gives no rows; other columns are not read.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            n_tokens, crcs = [], []
            for ids in encoder(vocabulary).encode(batch["text"].tolist()):
                ids += end
                n_tokens.append(len(ids) // 4)
                crcs.append(np.array([zlib.crc32(ids[i : i + 4 * length]) for i in range(0, len(ids), 4 * length)], dtype=np.int64))
            places = np.arange(row, row + len(batch))
            row += len(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "part": np.int64(part), "place": places, "doc_tokens": n_tokens, "crcs": crcs})

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "place"])
        tokens = rows["doc_tokens"].to_numpy()
        pieces = -(-tokens // length)
        doc = np.repeat(np.arange(len(rows)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(tokens[doc] - start, length)
        bins, offsets = first_fit_decreasing(size, length)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy()[doc], "start": start, "length": size, "ids_crc32": np.concatenate(rows["crcs"].to_list()), "doc_tokens": tokens[doc],
            "sequence_id": (int(key[0]) << 32) + bins, "offset": offsets,
        })

    counted = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        cut, "doc_id string, part long, place long, doc_tokens long, crcs array<bigint>"
    )
    grouped = counted.withColumn("grp", F.pmod(F.xxhash64("part", "place"), F.lit(groups)))
    packed = grouped.groupBy("grp").applyInPandas(
        pack, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))  # a string on the way: pandas has no null integers


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
