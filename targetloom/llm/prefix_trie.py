"""Trie of conversation prefixes, by collapsing whole conversations first.

Conversations with the same turns become one weighted sequence with the list of those that end there; sequences that
are a proper prefix of another one are told from leaves by an anti-join; the prefixes of the distinct sequences are
then aggregated with their weights.  Texts are digested where they are read and never shuffled.  A prefix is named by
its depth and 128 bits: the exclusive or of its turns' digests, each keyed by its depth, which adds up in any order, so a
conversation of any length is worked on in blocks of ``BLOCK`` turns.

Sums over subtrees need no walk: the nodes whose smallest member is c are a path that ends where c ends.  Below a node lie
the rest of its own path and, for every other sequence through it, the whole of that sequence's path.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from targetloom.llm.manifest import CRC32
from targetloom.llm.ordering import number_within
from targetloom.llm.registry import query, table
from targetloom.session import cut_lineage

BLOCK = 4096
PIECE = 256  # identifiers in one row of a long end list
FAMILY = 100
HEADS = 6


def _block(place: str) -> Column:
    return F.expr(f"{place} div {BLOCK}")


def _blocks_of(length: Column) -> Column:
    """One row per block of a sequence with places 0 to ``length``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(length / BLOCK)))


def number_turns(turns: DataFrame) -> DataFrame:
    """(c, pos, m, len) per row: place from 0 in its conversation, digest of role and text, code points of the text.

    Turns ascend (null first); equal ones ascend by digest.  Null roles and texts are empty; rows without a
    conversation identifier belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").alias("c"), "turn", digest.alias("m"), F.char_length(text).cast("long").alias("len"))
    return cut_lineage(number_within(rows, "c", ["turn", "m"]).select("c", "pos", "m", "len"))


def share_heads(numbered: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns taken from another one: (c, depth) and (c, d, m, len).

    ``base`` and ``head`` are expressions on ``c``: the first ``head`` (below ``most``) turns of conversation ``base``, as
    many as there are, then the own turns after the first ``head``.  Each base serves a bounded family of conversations.
    """
    sizes = cut_lineage(numbered.groupBy("c").agg((F.max("pos") + 1).alias("n")))
    bases = sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("c", "n", base.alias("base"), head.cast("long").alias("h")).join(bases, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut_lineage(convs.select("c", "n", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")))
    shift = convs.select("c", "h", "taken", _blocks_of(F.col("n")).alias("blk"))
    own = numbered.withColumn("blk", _block("pos")).join(shift, ["c", "blk"]).where("pos >= h")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "m", "len")
    first = numbered.where(F.col("pos") < most).select(F.col("c").alias("base"), "pos", "m", "len")
    heads = first.join(convs.where("taken > 0").select("c", "base", "taken"), "base").where("pos < taken")
    return convs.select("c", "depth"), own.union(heads.select("c", (F.col("pos") + 1).alias("d"), "m", "len"))


def _keyed(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix names inside each block, and per block what the earlier ones add: (c, blk, a1, a2, e1, e2), e with the block."""
    lanes = rebuilt.select("c", "d", "len", _block("d").alias("blk"), F.xxhash64("d", "m").alias("x1"), F.xxhash64("m", "d").alias("x2"))
    inside = Window.partitionBy("c", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut_lineage(lanes.select("*", F.bit_xor("x1").over(inside).alias("r1"), F.bit_xor("x2").over(inside).alias("r2")))
    until = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("c", "blk").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    blocks = sums.select("c", "blk", "t1", "t2", F.bit_xor("t1").over(until).alias("e1"), F.bit_xor("t2").over(until).alias("e2"))
    return rows, blocks.select("c", "blk", F.expr("e1 ^ t1").alias("a1"), F.expr("e2 ^ t2").alias("a2"), "e1", "e2")


def _hash_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each list, whose pieces arrive in order; only one digest's state is held."""
    name, state = None, None
    for batch in batches:
        for d, k1, k2, ids in batch[["d", "k1", "k2", "ids"]].itertuples(index=False):
            if (d, k1, k2) == name:
                state.update(b",")
            else:
                if name is not None:
                    yield pd.DataFrame([(*name, state.hexdigest())], columns=["d", "k1", "k2", "ends_sha256"])
                name, state = (d, k1, k2), sha256()
            state.update(ids.encode())
    if name is not None:
        yield pd.DataFrame([(*name, state.hexdigest())], columns=["d", "k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256) of the identifiers ``c`` that end at each node, ascending and joined by commas.

    Identifiers are range-partitioned by (node, identifier), so no task holds more than a range of them.  At most one
    node for each border of two ranges has its list in several ranges: such lists are digested as a stream of pieces.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = ["d", "k1", "k2"]
    ranged = cut_lineage(ends.repartitionByRange(parts, *name, "c").withColumn("part", F.spark_partition_id()))
    lists = cut_lineage(ranged.groupBy(*name, "part").agg(F.sort_array(F.collect_list("c")).alias("ids")))
    split = lists.groupBy(*name).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*name, F.lit(True).alias("split"))
    marked = lists.join(F.broadcast(split), name, "left")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    whole = marked.where("split is null").select(*name, F.sha2(joined, 256).alias("ends_sha256"))
    at = F.explode(F.sequence(F.lit(0), F.expr(f"(size(ids) - 1) div {PIECE}"))).alias("at")
    pieces = marked.where("split").select(*name, "part", "ids", at)
    pieces = pieces.select(*name, "part", "at", F.array_join(F.slice("ids", F.col("at") * PIECE + 1, F.lit(PIECE)).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(parts, *name).sortWithinPartitions(*name, "part", "at")
    return whole.union(ordered.mapInPandas(_hash_runs, "d long, k1 long, k2 long, ends_sha256 string"))


def trie_nodes(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (c, depth) with turns ``rebuilt`` (c, d, m, len).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); the turn that a node adds
    is turn ``depth`` of conversation ``conv_id``.  A conversation without turns ends at the root.
    """
    name = ["d", "k1", "k2"]
    rows, blocks = _keyed(rebuilt)
    blocks = cut_lineage(blocks)
    # whole sequences: equal ones collapse to one with a weight and the smallest identifier
    last = blocks.join(convs.select("c", _block("depth").alias("blk")), ["c", "blk"]).select("c", "e1", "e2")
    ends = convs.join(last, "c", "left").select("c", F.col("depth").alias("d"), F.coalesce("e1", F.lit(0)).alias("k1"), F.coalesce("e2", F.lit(0)).alias("k2"))
    ends = cut_lineage(ends)
    sequences = cut_lineage(ends.groupBy(*name).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("w")))
    # prefixes of the distinct sequences, with names; k is the node, p its parent
    weights = sequences.select("c", "w", F.col("d").alias("depth"), _blocks_of(F.col("d")).alias("blk"))
    named = rows.join(weights.join(blocks, ["c", "blk"]), ["c", "blk"])
    prefixes = named.select(
        "c", "w", "d", "blk", "len", (F.col("d") < F.col("depth")).alias("inner"), F.expr("r1 ^ a1").alias("k1"), F.expr("r2 ^ a2").alias("k2"),
        F.expr("r1 ^ a1 ^ x1").alias("p1"), F.expr("r2 ^ a2 ^ x2").alias("p2"),
    )
    zero = F.lit(0).cast("long")
    roots = sequences.select("c", "w", zero, zero, zero, F.col("d") > 0, zero, zero, F.lit(None).cast("long"), F.lit(None).cast("long"))
    prefixes = cut_lineage(prefixes.union(roots))
    nodes = prefixes.groupBy(*name).agg(
        F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("len").alias("len"), F.max("inner").alias("inner"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
    )
    nodes = cut_lineage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("len")).withColumn("blk", _block("d")))
    leaves = sequences.join(nodes.where("inner").select(*name), name, "left_anti").select("c", F.lit(1).cast("long").alias("leaf"))
    # paths of nodes with the same smallest member: what stands above a node on its path, and whole paths
    above = Window.partitionBy("conv_id", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    path_blocks = nodes.groupBy("conv_id", "blk").agg(F.sum("saved").alias("part"))
    before = path_blocks.select("conv_id", "blk", F.coalesce(F.sum("part").over(earlier), zero).alias("before"))
    own = nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), zero)).join(before, ["conv_id", "blk"])
    paths = path_blocks.groupBy(F.col("conv_id").alias("c")).agg(F.sum("part").alias("path"))
    worth = sequences.join(leaves, "c", "left").join(paths, "c", "left")
    worth = worth.select("c", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("path", zero).alias("path"), _blocks_of(F.col("d")).alias("blk"))
    through = prefixes.join(worth, ["c", "blk"]).groupBy(*name).agg(F.sum("leaf").alias("n_leaves"), F.sum("path").alias("paths"))
    children = nodes.where("p1 is not null").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = own.join(through, name).join(children, name, "left").join(end_digests(ends), name, "left")
    full = cut_lineage(full.select(
        *name, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("paths") - F.col("above") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ))
    # a parent with many children would be a hot key; there are at most 4 x shuffle partitions of these
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, full.count() // (4 * parts))
    up = [(F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2")]
    many = full.where(F.col("n_children") > limit).select(*up, F.col("conv_id").alias("many"))
    few = full.where(F.col("n_children").between(1, limit)).select(*up, F.col("conv_id").alias("few"))
    key = ["d", "p1", "p2"]
    placed = full.join(F.broadcast(many), key, "left")
    rest = placed.where("many is null").join(few, key, "left")
    columns = ["conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return placed.where("many is not null").withColumn("parent_conv_id", F.col("many")).select(*columns).union(
        rest.withColumn("parent_conv_id", F.col("few")).select(*columns)
    )


def conversation_trie(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv_id, turn, role, text) after ``share_heads``; see ``trie_nodes``.

    Null turns come first; null roles and texts are empty; rows without a conversation identifier belong to no
    conversation and are not read; repeated rows are turns of their own.  An empty table gives no rows, not even a root.
    Other columns are not read, whatever their names.
    """
    return trie_nodes(*share_heads(number_turns(turns), base, head, most))


@query(
    "op13_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    n AS (SELECT c, count(*) AS n, {CRC32.format("CAST(c AS VARCHAR)")} % 6 AS h FROM t GROUP BY c),
    k AS (SELECT n.c, n.n, n.h, n.c - n.c % 100 AS base, least(n.h, coalesce(b.n, 0)) AS taken FROM n LEFT JOIN n b ON b.c = n.c - n.c % 100),
    rebuilt AS (
        SELECT k.c, t.pos + 1 AS d, r, x FROM k JOIN t ON t.c = k.base AND t.pos < k.taken
        UNION ALL SELECT k.c, t.pos - k.h + k.taken + 1, r, x FROM k JOIN t ON t.c = k.c AND t.pos >= k.h
    ),
    named AS (
        SELECT c, d, length(x) AS len, string_agg(sha256(strlen(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
        FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM k
    ),
    ends AS (SELECT c, max(d) AS d, max(k) AS k FROM named GROUP BY c),
    node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saved FROM named GROUP BY d, k),
    kids AS (SELECT d - 1 AS d, k[: -65] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
    below AS (
        SELECT a.d, a.k, sum(b.saved) AS saved_tokens, count(*) FILTER (NOT EXISTS (SELECT 1 FROM kids WHERE kids.d = b.d AND kids.k = b.k)) AS n_leaves
        FROM node a JOIN node b ON b.d >= a.d AND b.k[: 64 * a.d] = a.k GROUP BY a.d, a.k
    ),
    stop AS (SELECT d, k, sha256(string_agg(c, ',' ORDER BY c)) AS ends_sha256 FROM ends GROUP BY d, k)
    SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM node JOIN below USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN stop USING (d, k) LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.k = node.k[: -65]
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    return conversation_trie(table(spark, sf_dir, "conversations"), F.expr(f"c - c % {FAMILY}"), head, HEADS)
