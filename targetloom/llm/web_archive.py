"""WARC files: writing records with revisits, and reading them back by boundary-chain verification.

A reader that starts in the middle of a file cannot tell a record from bytes of a payload that look like one.  Each
task therefore reports every candidate in its byte range with the offset where that candidate's successor would start,
already followed to the first offset outside the range.  Pointer jumping from offset 0 of each file then doubles the
distance per round and keeps the candidates that are reached; look-alikes inside payloads are not.  Records are read
from the reached entry of each range.

Files are plain ``.warc`` or ``.warc.gz`` with one gzip member per record; offsets are those of the file's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.registry import query, table
from targetloom.llm.token_files import shared_files
from targetloom.session import cut_lineage, ensure_checkpoint_dir

PLAIN, PACKED = b"WARC/1.", b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
HEAD_BYTES = 64 << 10  # headers of a record are read in steps of this size
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)
ID = re.compile(r"<urn:page:(-?\d+)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One response or revisit; a revisit keeps the HTTP head, whose length is that of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, packed: bool = True, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns (path, bytes, records) once written.

    Of equal payloads of ``min_bytes`` or more the row with the smallest page_id is a response and the others revisit
    it; rows that repeat this page_id are responses too.  Null html is the empty payload; a null page_id sorts last and
    is written as ``none``; a null url has no header; other columns are not read.  A repeated task writes a file of its
    own, and the returned table names the files of the tasks that counted.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "key")
    firsts = keys.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = (
        keys.join(firsts, "key").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("r_page"), F.col("key").alias("r_key"), "refers_to").distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("key") == F.col("r_key"))
    marked = rows.join(revisits, same, "left").select(
        F.col("page_id").cast("string"), "url", "html", F.col("r_key").isNotNull().alias("again"), F.col("refers_to").cast("string")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, count, size = None, 0, 0
        for batch in batches:
            if out is None and len(batch):
                files, base = shared_files(folder)
                files.create_dir(base, recursive=True)
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc{'.gz' if packed else ''}"
                out = files.open_output_stream(f"{base}/{name}", compression=None)
            for page_id, url, html, again, first in batch.itertuples(index=False, name=None):
                page_id, first = None if page_id is None else int(page_id), None if first is None else int(first)
                raw = record("revisit" if again else "response", page_id, url, date, html.encode(), first)
                raw = member(raw) if packed else raw
                out.write(raw)
                size += len(raw)
                count += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [count]})

    return cut_lineage(marked.mapInPandas(write, "path string, bytes long, records long"))


class ArchiveFile:
    """Random access to the records of one file."""

    def __init__(self, folder: str, path: str, size: int) -> None:
        files, base = shared_files(folder)
        self.file, self.size, self.packed = files.open_input_file(f"{base}/{path}"), size, path.endswith(".gz")

    def __enter__(self) -> ArchiveFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(count, self.size - at)))

    def candidates(self, start: int, stop: int) -> Iterator[int]:
        """Offsets in [start, stop) where the magic of a record stands."""
        magic = PACKED if self.packed else PLAIN
        for match in re.finditer(re.escape(magic), self.read(start, stop - start + len(magic) - 1)):
            yield start + match.start()

    def successor(self, at: int) -> int:
        """Where the record after a candidate would start, or -1 where the candidate cannot be a record."""
        if self.packed:
            return self._unpack(at, keep=False)[1]
        head = self._plain_head(at)
        found = LENGTH.search(head) if head else None
        stop = at + len(head) + int(found[1]) + 4 if found else -1
        return stop if stop <= self.size else -1

    def record(self, at: int) -> tuple[bytes, int]:
        """The record at a reached offset and the offset after it."""
        if self.packed:
            return self._unpack(at, keep=True)
        stop = self.successor(at)
        return self.read(at, stop - at), stop

    def _plain_head(self, at: int) -> bytes | None:
        head = b""
        while b"\r\n\r\n" not in head:
            more = self.read(at + len(head), HEAD_BYTES)
            if not more or len(head) >= 16 * HEAD_BYTES:
                return None
            head += more
        return head[: head.index(b"\r\n\r\n") + 4]

    def _unpack(self, at: int, keep: bool) -> tuple[bytes, int]:
        unpacker, out, pos, first = zlib.decompressobj(31), [], at, True
        try:
            while not unpacker.eof:
                raw = self.read(pos, HEAD_BYTES)
                if not raw:
                    return b"", -1
                pos += len(raw)
                text = unpacker.decompress(raw)
                if first and text:
                    first = False
                    if not text.startswith(PLAIN[: len(text)]):
                        return b"", -1
                if keep:
                    out.append(text)
        except zlib.error:
            return b"", -1
        return b"".join(out), -1 if first else pos - len(unpacker.unused_data)


def reached_entries(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, entry, stop): for each byte range in which a record starts, the first record's offset.

    ``archives`` is (path, bytes).  Runs one job per doubling, so as many as the logarithm of ranges per file.
    """
    spark = archives.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    n_ranges = ranges.count()
    tasks = max(1, min(n_ranges, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in batch[["path", "bytes", "start"]].itertuples(index=False):
                stop = min(start + range_bytes, size)
                with ArchiveFile(folder, path, size) as file:
                    after = {at: file.successor(at) for at in file.candidates(start, stop)}
                leaves: dict[int, int] = {}
                for at in sorted(after, reverse=True):  # successors lie further on, so theirs are known
                    goal = after[at]
                    leaves[at] = goal if goal < 0 or goal >= stop else leaves.get(goal, -1)
                yield pd.DataFrame({"path": path, "at": list(leaves), "leap": list(leaves.values())})

    leaps = cut_lineage(ranges.repartition(tasks, "path", "start").mapInPandas(scan, "path string, at long, leap long"))
    reached = cut_lineage(leaps.where("at = 0").select("path", "at"))
    known = reached.count()
    while known:
        jumped = reached.join(leaps.where("leap >= 0"), ["path", "at"]).select("path", F.col("leap").alias("at"))
        real = leaps.select("path", "at")  # an offset that no task saw as a candidate is the end of a file, or damage
        reached = cut_lineage(reached.union(jumped.join(real, ["path", "at"], "left_semi")).distinct())
        count = reached.count()
        if count == known:
            break
        known = count
        onward = leaps.select("path", F.col("at").alias("leap"), F.col("leap").alias("further"))
        leaps = cut_lineage(leaps.join(onward, ["path", "leap"], "left").select("path", "at", F.coalesce("further", "leap").alias("leap")))
    stop = F.least((F.floor(F.col("at") / range_bytes) + 1) * range_bytes, F.col("bytes"))
    return reached.join(archives.select("path", "bytes"), "path").select("path", "bytes", F.col("at").alias("entry"), stop.cast("long").alias("stop"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per response or revisit: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload].

    Length and digest are those of the full payload; a revisit takes them from its head and has a null payload.  A file
    that is damaged gives the records before the damage.  No archive gives no rows.
    """
    entries = reached_entries(archives, folder, range_bytes)
    tasks = max(1, min(entries.count(), 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, at, stop in batch[["path", "bytes", "entry", "stop"]].itertuples(index=False):
                rows, held = [], 0
                with ArchiveFile(folder, path, size) as file:
                    while 0 <= at < stop:
                        raw, at = file.record(at)
                        row = _parsed(raw, with_payload)
                        if row is not None:
                            rows.append(row)
                            held += len(raw) if with_payload else 256
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    out = entries.repartition(tasks, "path", "entry").mapInPandas(read, schema)
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def _parsed(raw: bytes, with_payload: bool) -> tuple | None:
    """A response or revisit as a row; the digest of a response is computed anew and must agree with its head."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(LENGTH.search(http + b"\r\n")[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, first = ID.fullmatch(fields["WARC-Record-ID"]), ID.fullmatch(fields.get("WARC-Refers-To", ""))
    row = (page[1] if page else None, fields.get("WARC-Target-URI"), kind, first[1] if first else None, size, named)
    return (*row, payload if kind == "response" else None) if with_payload else row


@query("op4_web_archive")
def op4_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/archives/{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
