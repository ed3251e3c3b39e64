"""Repeated byte strings by sharded suffix arrays.

Anchors first tell which windows can have a copy at all, and windows whose whole neighbourhood is met twice need no
sorting.  The rest is text around an anchor that is shared while the neighbourhood differs (a *zone*).  Zones are dealt
to shards by anchor; a shard builds its suffix array by Larsson-Sadakane refinement and the common prefixes by Kasai's
rule, both in numpy, and neighbours with a common prefix of a window are repeats.  An anchor with more zones than a
shard takes is dealt over several shards; their sorted windows are then merged per key range by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm import anchors
from targetloom.llm.registry import query, table
from targetloom.llm.wordgrid import _BYTE_VALUES, byte_grid, prefix_hash, signed, span_hash
from targetloom.session import cut_lineage

WINDOW = 200
ANCHOR = 32
SHARD_ZONES = 8000


def suffix_array(codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) of ``codes`` (bytes); ``left`` counts what is left of each zone.

    Suffixes end at their zone's end; of equal ones the later comes first.  Larsson-Sadakane: the known order doubles per
    round, and only suffixes that still share a group are sorted again, by the group of what follows.
    """
    n = len(codes)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):  # seven symbols of nine bits at once; 0 is the end of the zone
        key <<= np.uint64(9)
        key[: max(0, n - i)] += np.where(left[: max(0, n - i)] > i, codes[i:].astype(np.uint64) + np.uint64(1), np.uint64(0))
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    places, keys, done = np.arange(n), key[order], 7
    while True:
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = keys[1:] != keys[:-1]
        rank[order[places]] = np.maximum.accumulate(np.where(fresh, places, 0))
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(places)))
        places = places[np.repeat(sizes > 1, sizes)]
        if not len(places):
            return order, rank
        some = order[places]
        following = np.where(left[some] > done, n + rank[np.minimum(some + done, n - 1)], n - 1 - some)
        keys = rank[some] * (2 * n) + following
        again = np.argsort(keys)
        order[places], keys = some[again], keys[again]
        done *= 2


def common_prefixes(codes: np.ndarray, left: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix (by its place in the text) and the one before it in order.

    Kasai's rule: the next suffix shares at least one symbol less than this one did.  All zones go on in step.
    """
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    before = np.where(rank > 0, order[np.maximum(rank - 1, 0)], -1)
    at, shared = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    while len(at):
        other = before[at]
        shared[other < 0] = 0
        most = np.where(other < 0, 0, np.minimum(left[at], left[np.maximum(other, 0)]))
        live = np.flatnonzero(shared < most)
        while len(live):
            same = codes[at[live] + shared[live]] == codes[other[live] + shared[live]]
            live = live[same]
            shared[live] += 1
            live = live[shared[live] < most[live]]
        out[at] = shared
        on = left[at] > 1
        at, shared = at[on] + 1, np.maximum(shared[on] - 1, 0)
    return out


def equal_windows(zones: list[bytes], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard in suffix order: (zone, start in it, group, place in the text); equal windows share a group."""
    size = np.array([len(z) for z in zones])
    starts = np.cumsum(size) - size
    codes = np.frombuffer(b"".join(zones), dtype=np.uint8)
    left = np.repeat(starts + size, size) - np.arange(len(codes))
    order, rank = suffix_array(codes, left)
    prefix = common_prefixes(codes, left, order, rank, starts)
    zone_of = np.repeat(np.arange(len(zones)), size)
    new = prefix[order] < window
    group = np.cumsum(new)
    real = (order - starts[zone_of[order]]) < windows[zone_of[order]]
    at = order[real]
    return zone_of[at], at - starts[zone_of[at]], group[real], at


def _sites(docs: DataFrame, window: int, k: int, nodes_only: bool) -> DataFrame:
    """Sites of all documents: anchor hash, and unless ``nodes_only`` the hash of the zone around, place and windows."""

    def work(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        raw, start = byte_grid(texts)
        one = prefix_hash(_BYTE_VALUES[0][raw], 0)
        n = len(raw)
        place = np.arange(n)
        runs = span_hash(one, place, np.minimum(place + k, n), 0)
        # the grid has a space after each text, which belongs to no window
        s = anchors.find_sites(runs, start, window + 1, k + 1)
        out = {"row": s.text, "h": signed(runs[s.at])}
        if not nodes_only:
            two = prefix_hash(_BYTE_VALUES[1][raw], 1)
            lead = (s.at - s.low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out["z"] = signed(span_hash(two, s.low, s.high + window, 1) ^ lead)
            out |= {c: (x - start[s.text]).astype(np.int32) for c, x in (("low", s.low), ("high", s.high))}
        return out

    if nodes_only:
        return anchors.over_texts(docs, "h long", work, carry=())
    return anchors.over_texts(docs, "h long, z long, low int, high int", work)


def removable_spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, shard_zones: int = SHARD_ZONES) -> DataFrame:
    """(doc_id, th, a, b): byte spans [a, b) of the windows met elsewhere; ``docs`` comes from ``anchors.keyed``."""
    met = _sites(docs, window, k, nodes_only=True).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    sites = cut_lineage(_sites(docs, window, k, nodes_only=False).join(met, "h", "left_semi"))
    zones = cut_lineage(sites.groupBy("h", "z").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "low", "high")).alias("rep")))
    settled = zones.where("n > 1").select("h", "z")
    certain = sites.join(settled, ["h", "z"], "left_semi").select("doc_id", "th", F.col("low").alias("a"), (F.col("high") + window).alias("b"))
    # zones that are met once, and those that could hold a copy of their windows
    open_nodes = zones.groupBy("h").agg(F.count(F.lit(1)).alias("zones"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).where("zones > 1 and single > 0")
    shards = F.ceil(F.col("zones") / shard_zones).cast("int")
    dealt = zones.join(open_nodes.select("h", shards.alias("shards")), "h").select(
        "h", F.pmod(F.xxhash64("z"), F.col("shards")).cast("int").alias("salt"), "shards", (F.col("n") > 1).alias("settled"), "rep.doc_id", "rep.th", "rep.low", "rep.high"
    )
    asked = dealt.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "salt", "shards", "settled", "low", "high")).alias("zones"))
    asked = asked.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "zones")
    one_each = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))).drop("s_id", "s_th")

    def fetch(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("row", "h", "salt", "shards", "settled", "low", "windows", "zone")}
        for i, text in enumerate(texts):
            for z in batch.column("zones")[first + i].as_py():
                out["row"].append(i)
                for c in ("h", "salt", "shards", "settled", "low"):
                    out[c].append(z[c])
                out["windows"].append(z["high"] - z["low"] + 1)
                out["zone"].append(text[z["low"] : z["high"] + window])
        return out | {"row": np.array(out["row"], dtype=np.int64), "h": pa.array(out["h"], pa.int64())} | {c: pa.array(out[c], pa.int32()) for c in ("salt", "shards", "low", "windows")}

    texts = anchors.over_texts(one_each, "h long, salt int, shards int, settled boolean, low int, windows int, zone binary", fetch)
    # rows that repeat identifier and text would each bring the zone: it was met once, so the document has one row
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # large shards: the steps over zones cost the same for many
    shards_rows = texts.repartition(tasks, "h", "salt").sortWithinPartitions("h", "salt")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sorted_shards = cut_lineage(shards_rows.mapInArrow(
        _shard_sorter(window, shard_zones), f"doc_id {id_type}, th binary, a int, b int, h long, part int, keys binary, places array<struct<doc_id:{id_type},th:binary,a:int>>"
    ))
    inside = sorted_shards.where("part is null").select("doc_id", "th", "a", "b")
    merged = sorted_shards.where("part is not null").groupBy("h", "part").applyInArrow(_merge_shards, f"doc_id {id_type}, th binary, a int")
    return certain.unionByName(inside).unionByName(merged.withColumn("b", F.col("a") + window))


def _shard_sorter(window: int, shard_zones: int):
    """Rows of zones, ordered by shard, to repeats found inside a shard and sorted windows of split anchors."""

    def flush(held: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        zone, start, group, _ = equal_windows([r["zone"] for r in held], np.array([r["windows"] for r in held]), window)
        settled = np.array([r["settled"] for r in held])
        split = np.array([r["shards"] for r in held]) > 1
        known = np.bincount(group, weights=settled[zone]) > 0
        repeat = ((np.bincount(group) > 1) | known)[group]

        def place(i: int) -> dict:
            r = held[zone[i]]
            return {"doc_id": r["doc_id"], "th": r["th"], "a": r["low"] + int(start[i])}

        gone = np.flatnonzero(repeat & ~settled[zone])  # windows of one zone that follow each other make one span
        gone = gone[np.lexsort((start[gone], zone[gone]))]
        heads = np.flatnonzero(np.append(True, (np.diff(zone[gone]) != 0) | (np.diff(start[gone]) != 1))[: len(gone)])
        lasts = np.append(heads[1:], len(gone))[: len(heads)] - 1
        rows = [place(i) | {"b": held[zone[i]]["low"] + int(start[j]) + window} for i, j in zip(gone[heads].tolist(), gone[lasts].tolist())]
        # anchors dealt over shards: every distinct window goes on, with its place if it is still alone
        lone = np.flatnonzero(split[zone])
        lone = lone[np.unique(group[lone], return_index=True)[1]]
        runs: dict[tuple[int, int], list[tuple[bytes, dict | None]]] = {}
        for i in lone.tolist():
            r = held[zone[i]]
            key = hashlib.blake2b(r["zone"][start[i] : start[i] + window], digest_size=16).digest()
            part = int.from_bytes(key[:4], "big") * r["shards"] >> 32
            runs.setdefault((r["h"], part), []).append((key, None if repeat[i] else place(i)))
        for (h, part), found in runs.items():
            found.sort(key=lambda x: x[0])
            rows.append({"h": h, "part": part, "keys": b"".join(k for k, _ in found), "places": [p for _, p in found]})
        at = pa.struct([("doc_id", id_type), ("th", pa.binary()), ("a", pa.int32())])
        schema = pa.schema([*at, ("b", pa.int32()), ("h", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("places", pa.list_(at))])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, id_type = [], None, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for row in batch.to_pylist():
                shard = (row["h"], row["salt"])
                if shard != last and len(held) >= shard_zones:
                    yield flush(held, id_type)
                    held = []
                held.append(row)
                last = shard
        if held:
            yield flush(held, id_type)

    return run


def _merge_shards(rows: pa.Table) -> pa.Table:
    """Windows alone in their shard with an equal in another shard of the same anchor, found by binary search.

    A group is one key range of one anchor: there are as many ranges as shards, so a group is about as large as a shard.
    """
    keys = [np.frombuffer(k, dtype=">u8").reshape(-1, 2).astype(np.uint64) for k in rows.column("keys").to_pylist()]
    out: list[dict] = []
    for i, (mine, places) in enumerate(zip(keys, rows.column("places").to_pylist())):
        met = np.zeros(len(mine), dtype=bool)
        for j, other in enumerate(keys):
            if i != j:
                at = np.minimum(np.searchsorted(other[:, 0], mine[:, 0]), len(other) - 1)
                met |= (other[at] == mine).all(axis=1)
        out += [p for p, again in zip(places, met.tolist()) if again and p is not None]
    return pa.Table.from_pylist(out, schema=pa.schema(list(rows.schema.field("places").type.value_type)))


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, shard_zones: int = SHARD_ZONES, id_col: str = "doc_id", text_col: str = "text", measure_only: bool = True) -> DataFrame:
    """Per row what is left without the bytes that repeated strings of ``window`` bytes cover.

    Removed is every byte of the UTF-8 text in a string of ``window`` bytes that also starts anywhere else, the same
    document included.  The result is (doc_id, n_bytes, n_removed, n_spans, kept_sha256), ``n_spans`` the maximal removed
    runs; without ``measure_only`` also ``kept`` (binary, as a cut may fall inside a character) and ``spans``.  A null
    text is empty; rows repeated in full are copies of each other; an empty table gives none; other columns are not read.
    """
    rows = anchors.keyed(docs, id_col, text_col)
    spans = removable_spans(rows, window, k, shard_zones)
    listed = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(F.array("a", "b"))).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    marked = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").drop("s_id", "s_th")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ("" if measure_only else ", kept binary, spans array<struct<a:int,b:int>>")

    def cut(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for text, own in zip(texts, anchors.ranges_of(batch.column("spans"), first, len(texts))):
            gone = anchors.covered(len(text), own) if len(own) else np.zeros(len(text), dtype=bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if len(own) else text
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(edges) // 2)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
            out["spans"].append([{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()])
        spans = pa.array(out["spans"], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return {"row": np.arange(len(texts))} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")} | {
            "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary()), "spans": spans
        }

    return anchors.over_texts(marked, schema, cut, carry=("doc_id",))


@query("op6_suffix_arrays")
def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))
