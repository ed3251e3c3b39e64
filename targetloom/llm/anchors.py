"""Anchors: positions that every copy of a long window shares, and the rows around documents' repeats.

The anchor of a window of ``window`` tokens is the smallest-hashing run of ``k`` tokens in it (the first of equals).
Equal windows have equal anchors at equal places, so only documents' anchors - a few hundredths of their tokens - have
to meet in a shuffle.  A *site* is one anchor of a document with the run of windows that it is the anchor of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from targetloom.llm.wordgrid import chunks, mix

_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22


@dataclass
class Sites:
    """Per site: text index, anchor position, first and last window start (positions count tokens of all texts)."""

    text: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def find_sites(runs: np.ndarray, first: np.ndarray, window: int, k: int) -> Sites:
    """``runs`` hashes the ``k`` tokens from each position; text i has the positions first[i] to first[i + 1]."""
    n = int(first[-1])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    smallest = smallest_places(runs[:n], window - k + 1)
    start = np.flatnonzero(np.arange(n) + window <= first[1:][text])
    at = smallest[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    edge = np.flatnonzero(new)
    return Sites(text[start[edge]], at[edge], start[edge], start[np.append(edge[1:], len(start)) - 1] if len(start) else start)


def smallest_places(runs: np.ndarray, width: int, piece: int = _PIECE) -> np.ndarray:
    """Place of the smallest-hashing of the ``width`` runs from each place on, the first of equals.

    Places are packed below the hash, in 24 bits: longer texts go by pieces that overlap by ``width`` - 1 runs.
    """
    n = len(runs)
    if piece + width - 1 > int(_PLACE):
        raise ValueError(f"a window of more than {int(_PLACE) - piece} tokens")
    out = np.empty(n, dtype=np.int64)
    for low in range(0, n, piece):
        some = runs[low : low + piece + width - 1]
        best = (mix(some) & ~_PLACE) | np.arange(len(some), dtype=np.uint64)
        span = 1
        while span < width:  # smallest of `width` neighbours, by doubling
            step = min(span, width - span)
            best[:-step] = np.minimum(best[:-step], best[step:])
            span += step
        out[low : low + piece] = (best[:piece] & _PLACE).astype(np.int64) + low
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): th tells rows apart, also those that share an identifier; rows equal in both are handled as one."""
    return docs.select(F.col(id_col).alias("doc_id"), row_digest(F.col(id_col), F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def row_digest(name: Column, text: Column) -> Column:
    """128 bits that stand for a text and its identifier; null counts as the empty text.

    The identifier only parts copies of one text, which may as well be handled as one: 64 bits of it are enough.
    """
    return F.unhex(F.md5(F.concat(F.coalesce(text, F.lit("")), F.hex(F.xxhash64(name))).cast("binary")))


def over_texts(docs: DataFrame, schema: str, work: Callable[[list[bytes], int, pa.RecordBatch], dict], carry: tuple[str, ...] = ("doc_id", "th")) -> DataFrame:
    """Run ``work`` on chunks of texts; it returns columns by name, ``row`` among them as the index of each row's text.

    The ``carry`` columns of that text come first in the result, whatever their types.
    """
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, some in chunks(texts):
                out = work(some, first, batch)
                rows = pa.array(out["row"] + first)
                columns = [batch.column(c).take(rows) for c in carry]
                columns += [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[c] for c in names)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    return docs.mapInArrow(run, ", ".join(x for x in (kept, schema) if x))


def ranges_of(column: pa.Array, first: int, count: int) -> list[np.ndarray]:
    """Rows of an array<array<int>>-like column (flat pairs) as arrays of (start, stop); null is none."""
    out = []
    for i in range(first, first + count):
        value = column[i].as_py()
        out.append(np.array(value if value else [], dtype=np.int64).reshape(-1, 2))
    return out


def covered(length: int, spans: np.ndarray) -> np.ndarray:
    """Flags of the positions in any of the half-open ``spans``."""
    steps = np.zeros(length + 1, dtype=np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0
