"""Token-id files in patched frame-of-reference blocks.

Documents are range-partitioned by identifier, each task encodes its range in order and writes one shard.  A shard is
cut into blocks of ``block_ids`` ids.  A block stores its minimum, packs the differences at the width that a percentile
of them needs, and keeps the higher bits of the rest in an exception list.  The footer indexes where each block starts
and how many ids each document has, so a reader fetches any block alone.

Shard layout (little-endian): blocks | footer | footer length (8 bytes) | magic (8 bytes).
Block: minimum u4, ids u4, exceptions u4, width u1, exception width u1, 2 zero bytes, packed low bits, exception
positions u4 each, packed high bits.
Footer: block count u4, document count u4, block starts u8 each, ids per document u4 each, null-identifier flags u1
each, document ids i8 each.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.byte_pairs import encoder
from targetloom.llm.registry import query, table
from targetloom.session import cut_lineage, ensure_checkpoint_dir

MAGIC = b"PFORIDS1"
BLOCK_IDS = 8192
PERCENTILE = 90.0
HEAD = struct.Struct("<IIIBBxx")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """``values`` at ``width`` <= 32 bits each, lowest bit first."""
    if width == 0 or not len(values):
        return b""
    if width % 8 == 0 and width != 24:
        return values.astype(f"<u{width // 8}").tobytes()
    rows = np.zeros((-(-len(values) // 8), 8), dtype="<u8")  # eight values fill ``width`` bytes
    rows.reshape(-1)[: len(values)] = values
    words = np.zeros((len(rows), 4), dtype="<u8")
    for i in range(8):
        word, bit = divmod(i * width, 64)
        words[:, word] |= rows[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - bit)
    return words.view(np.uint8)[:, :width].tobytes()[: packed_size(len(values), width)]


def unpack_bits(raw: bytes, count: int, width: int) -> np.ndarray:
    """``count`` values of ``width`` <= 32 bits."""
    if width == 0 or not count:
        return np.zeros(count, dtype=np.uint64)
    if width % 8 == 0 and width != 24:
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=count).astype(np.uint64)
    padded = np.frombuffer(raw[: packed_size(count, width)] + bytes(8), dtype=np.uint8).astype(np.uint64)
    bit = np.arange(count) * width
    byte = bit >> 3
    out = padded[byte]
    for i in range(1, (width + 14) // 8):  # the further bytes that a value may reach into
        out |= padded[byte + i] << np.uint64(8 * i)
    return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def packed_size(count: int, width: int) -> int:
    return (count * width + 7) // 8


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at least one id (uint32)."""
    low = int(ids.min())
    diff = ids.astype(np.uint64) - np.uint64(low)
    place = max(0, math.ceil(len(diff) * percentile / 100) - 1)
    width = int(np.partition(diff, place)[place]).bit_length()
    high = diff >> np.uint64(width)
    at = np.flatnonzero(high)
    high_width = int(high.max()).bit_length()
    body = pack_bits(diff & np.uint64((1 << width) - 1), width)
    return HEAD.pack(low, len(ids), len(at), width, high_width) + body + at.astype("<u4").tobytes() + pack_bits(high[at], high_width)


def decode_block(raw: bytes) -> np.ndarray:
    low, count, odd, width, high_width = HEAD.unpack_from(raw)
    at = HEAD.size + packed_size(count, width)
    diff = unpack_bits(raw[HEAD.size : at], count, width)
    where = np.frombuffer(raw, dtype="<u4", count=odd, offset=at)
    diff[where] |= unpack_bits(raw[at + 4 * odd :], odd, high_width) << np.uint64(width)
    return (diff + np.uint64(low)).astype("<u4")


class ShardWriter:
    """Writes blocks as ids arrive; holds one block and the footer, never the shard."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> None:
        self.out, self.block_ids, self.percentile = out, block_ids, percentile
        self.waiting: list[np.ndarray] = []
        self.held = self.at = self.total = 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.waiting)
            full = len(ids) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(ids[i : i + self.block_ids])
            self.waiting, self.held = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        raw = encode_block(ids, self.percentile)
        self.starts.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        footer = struct.pack("<II", len(self.starts), len(self.docs)) + np.array(self.starts, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes()
        footer += bytes(d is None for d in self.docs) + np.array([d or 0 for d in self.docs], "<i8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()


def read_shard(file, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document in order, one block in memory at a time."""
    file.seek(size - 16)
    length, magic = struct.unpack("<Q8s", file.read(16))
    if magic != MAGIC:
        raise ValueError("no token-id shard")
    file.seek(size - 16 - length)
    footer = file.read(length)
    blocks, docs = struct.unpack_from("<II", footer)
    starts = np.frombuffer(footer, "<u8", blocks, 8)
    at = 8 + 8 * blocks
    counts = np.frombuffer(footer, "<u4", docs, at)
    nulls = footer[at + 4 * docs : at + 5 * docs]
    names = np.frombuffer(footer, "<i8", docs, at + 5 * docs)
    ends = [*starts[1:].tolist(), size - 16 - length]
    block, held = 0, np.zeros(0, dtype="<u4")
    for i in range(docs):
        need, have = int(counts[i]), [held]
        n = len(held)
        while n < need:
            file.seek(int(starts[block]))
            have.append(decode_block(file.read(int(ends[block] - starts[block]))))
            n += len(have[-1])
            block += 1
        ids = np.concatenate(have) if len(have) > 1 else held
        yield (None if nulls[i] else int(names[i])), ids[:need]
        held = ids[need:]


def shared_files(path: str):
    """(pyarrow file system, path in it) of a folder named with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards below ``folder`` (shared by all executors); returns (shard, path, bytes, n_docs, n_ids) once written.

    Shards hold documents in ascending identifier order, null identifiers first; shard numbers follow the same order.
    A null or empty text is the end id alone.  A repeated task overwrites nothing: it writes a file of its own, and the
    returned table names the files of the tasks that counted.  An empty table gives no shard.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, writer = TaskContext.get().partitionId(), None
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            if writer is None and len(batch):
                files, base = shared_files(folder)
                files.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.pfor"
                writer = ShardWriter(files.open_output_stream(f"{base}/{name}", compression=None))
            for doc_id, ids in zip(batch["doc_id"].tolist(), encoder(vocabulary).encode(batch["text"].tolist())):
                writer.add(None if doc_id is None else int(doc_id), np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            size = files.get_file_info(f"{base}/{name}").size
            yield pd.DataFrame({"shard": [shard], "path": [name], "bytes": [size], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return cut_lineage(
        ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, "shard int, path string, bytes long, n_docs long, n_ids long")
    )


def read_token_files(shards: DataFrame, folder: str, per_document) -> DataFrame:
    """Read the shards of ``write_token_files`` back: one task per shard, ``per_document`` makes (schema, row) of them.

    Rows start with doc_id and start (ids of all documents before); ``per_document`` is (names and types, function of a
    document's ids giving their values).
    """
    extra_schema, values = per_document
    names = [c.split()[0] for c in extra_schema.split(",")]
    # one row per shard: the running total is a small table, whatever the shards hold
    before, starts = 0, []
    for row in shards.orderBy("shard").toLocalIterator():
        starts.append((row.path, row.bytes, before))
        before += row.n_ids
    spark = shards.sparkSession
    if not starts:
        return spark.createDataFrame([], f"doc_id long, start long, {extra_schema}")
    placed = spark.createDataFrame(starts, "path string, bytes long, start long").repartition(len(starts), "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in batch[["path", "bytes", "start"]].itertuples(index=False):
                files, base = shared_files(folder)
                rows: list[tuple] = []
                with files.open_input_file(f"{base}/{path}") as file:
                    for doc_id, ids in read_shard(file, int(size)):
                        rows.append((None if doc_id is None else str(doc_id), start, *values(ids)))
                        start += len(ids)
                        if len(rows) == 20_000:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", *names])
                            rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", *names])

    return placed.mapInPandas(read, f"doc_id string, start long, {extra_schema}").withColumn("doc_id", F.col("doc_id").cast("long"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token_ids/{uuid.uuid4().hex}"
    shards = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(shards, folder, ("n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes()))))
