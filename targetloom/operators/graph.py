"""Graph operators on edge tables (source, target, weight); undirected, iterative rounds written to the checkpoint folder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from targetloom.functions.numeric import keyed_uniform, null_skipping_mean
from targetloom.operators.permutation import numbered, round_keys, shuffled_place
from targetloom.operators.prefix import exact_quantiles
from targetloom.session import cut_lineage


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected, no self loops, the largest weight of duplicates."""
    return edges.where(F.col("source") != F.col("target")).groupBy(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
    ).agg(F.max("weight").alias("weight"))


def restricted_edges(edges: DataFrame, panel: DataFrame) -> DataFrame:
    """Both ends in the panel; the orientation of the heaviest record is kept."""
    a = panel.select(F.col("gene").alias("source"))
    b = panel.select(F.col("gene").alias("target"))
    kept = edges.join(a, "source", "left_semi").join(b, "target", "left_semi").where(F.col("source") != F.col("target"))
    best = kept.groupBy(F.least("source", "target").alias("_s"), F.greatest("source", "target").alias("_t")).agg(
        F.max(F.struct("weight", "source", "target")).alias("b")
    )
    return best.select("b.source", "b.target", "b.weight")


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("weight").alias("w"))
    return a.unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"), F.col("weight").alias("w")))


def vertices_of(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.explode(F.array("source", "target")).alias("v"))
    if extra is not None:
        out = out.unionByName(extra.select("v"))
    return out.distinct()


def strength(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, n_neighbours, degree): degree is the sum of edge weights; isolated vertices stay with 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("v"), "weight")
    agg = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n_neighbours"), F.sum("weight").alias("degree"))
    if vertices is None:
        return agg
    return vertices_of(edges, vertices).join(agg, "v", "left").fillna(0, ["n_neighbours"]).fillna(0.0, ["degree"])


class _Tiled:
    """A graph cut into tiles, so that a round of a vertex program moves vectors and never the edges.

    Vertices are numbered in the order of their names; vertex ``p`` is place ``p // g`` of block ``p % g``.  A tile holds the
    edges between two blocks, about ``TILE_EDGES`` of them, and is written once as a table bucketed by tile.  In a round every
    block is sent to its ``g`` tiles and a tile sends one vector to each of its two blocks: 2 x g x vertices numbers.
    """

    TILE_EDGES = 6_000_000
    LEAST_BLOCKS = 4

    def __init__(self, edges: DataFrame, vertices: DataFrame | None, weighted: bool):
        spark = edges.sparkSession
        edges = cut_lineage(edges.select("source", "target", *([F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w")] if weighted else [])))
        self.names = numbered(vertices_of(edges, vertices), ["v"], "place")
        self.n = self.names.count()
        g = self.g = max(self.LEAST_BLOCKS, math.ceil(math.sqrt(2 * edges.count() / self.TILE_EDGES)))
        self.columns = ["i", "j"] + (["w"] if weighted else [])
        placed = edges.join(self.names.select(F.col("v").alias("source"), F.col("place").alias("p")), "source").drop("source")
        placed = placed.join(self.names.select(F.col("v").alias("target"), F.col("place").alias("q")), "target").drop("target")
        turn = F.col("p") % g > F.col("q") % g
        placed = placed.withColumns({"a": F.when(turn, F.col("q")).otherwise(F.col("p")), "b": F.when(turn, F.col("p")).otherwise(F.col("q"))})
        ends = [((F.col("a") % g) * g + F.col("b") % g).cast("int").alias("tile"), F.floor(F.col("a") / g).cast("int").alias("i"), F.floor(F.col("b") / g).cast("int").alias("j")]
        buckets = max(g * (g + 1) // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        columns = self.columns

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for tile, cells in pdf.groupby("tile"):
                    yield pd.DataFrame({"tile": [tile], **{c: [cells[c].to_numpy()] for c in columns}})

        cells = placed.select(*ends, *self.columns[2:]).repartition(buckets, "tile")
        kinds = "tile int, i array<int>, j array<int>" + (", w array<double>" if weighted else "")
        self.tiles = cut_lineage(cells.mapInPandas(packed, kinds), bucketed=(buckets, "tile"))
        sizes = [(k, max(0, -(-(self.n - k) // g))) for k in range(g)]
        self.blocks = spark.createDataFrame(sizes, "block int, size long")

    def along_edges(self, state: DataFrame, vector: str, kind: str, edge: Callable) -> DataFrame:
        """(block, part): what ``edge`` makes of the vectors of its two blocks, one row per tile and block of the tile."""
        g, columns = self.g, self.columns
        tile = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: (F.least(k, F.col("block")) * g + F.greatest(k, F.col("block"))).cast("int"))
        sent = state.select(F.explode(tile).alias("tile"), "block", F.col(vector).alias("x"))

        def meet(cells: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            if not len(cells):
                return pd.DataFrame({"block": [], "part": []}, dtype=object)
            x = {int(k): np.asarray(v) for k, v in zip(vectors["block"], vectors["x"])}
            a, b = divmod(int(cells["tile"].iloc[0]), g)
            out = edge(x[a], x[b], zip(*[cells[c] for c in columns]))
            return pd.DataFrame({"block": [a, b], "part": list(out)})

        return self.tiles.groupBy("tile").cogroup(sent.groupBy("tile")).applyInPandas(meet, f"block int, part array<{kind}>")

    def by_name(self, state: DataFrame, vector: str) -> DataFrame:
        """(v, place, value) from a vector per block."""
        rows = state.select("block", F.posexplode(vector).alias("at", "value"))
        return rows.select((F.col("at").cast("long") * self.g + F.col("block")).alias("place"), "value").join(self.names, "place").select("v", "place", "value")


def page_rank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tol: float | None = 1e-6, every: int = 5) -> DataFrame:
    """Weighted PageRank of an undirected graph; the mass of isolated vertices is spread evenly.

    Ranks are vectors of blocks, pushed along the tiles of the graph (``_Tiled``), and every round is written out; with
    ``tol`` the L1 change is compared with n x tol every ``every`` rounds, and an error tells that it has not settled
    within ``rounds``.  With ``tol=None`` exactly ``rounds`` rounds are made.
    """
    graph = _Tiled(edges, vertices, weighted=True)
    n = graph.n

    def push(xa: np.ndarray, xb: np.ndarray, cells: Iterable) -> tuple[np.ndarray, np.ndarray]:
        to_a, to_b = np.zeros(len(xa)), np.zeros(len(xb))
        for i, j, w in cells:
            np.add.at(to_b, j, xa[i] * w)
            np.add.at(to_a, i, xb[j] * w)
        return to_a, to_b

    kinds = "block int, degree array<double>, rank array<double>, share array<double>, lost double, change double"

    def kept(block: int, degree: np.ndarray, rank: np.ndarray, change: float) -> pd.DataFrame:
        share = np.divide(rank, degree, out=np.zeros(len(rank)), where=degree != 0)
        return pd.DataFrame({"block": [block], "degree": [degree], "rank": [rank], "share": [share], "lost": [float(rank[degree == 0].sum())], "change": [change]})

    def start(parts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        size = int(blocks["size"].iloc[0])
        return kept(int(blocks["block"].iloc[0]), sum(parts.get("part", []), np.zeros(size)), np.full(size, 1.0 / max(n, 1)), 0.0)

    ones = graph.blocks.select("block", F.array_repeat(F.lit(1.0), F.col("size").cast("int")).alias("x"))
    state = cut_lineage(graph.along_edges(ones, "x", "double", push).groupBy("block").cogroup(graph.blocks.groupBy("block")).applyInPandas(start, kinds))
    lost = state.agg(F.sum("lost")).first()[0]

    def stepped(lost: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def step(parts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            degree, rank = np.asarray(old["degree"].iloc[0]), np.asarray(old["rank"].iloc[0])
            fresh = (1 - damping) / max(n, 1) + damping * (sum(parts.get("part", []), np.zeros(len(rank))) + lost / max(n, 1))
            return kept(int(old["block"].iloc[0]), degree, fresh, float(np.abs(fresh - rank).sum()))

        return step

    for i in range(1, rounds + 1 if n else 1):
        parts = graph.along_edges(state, "share", "double", push)
        state = cut_lineage(parts.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(stepped(lost), kinds))
        lost, change = state.agg(F.sum("lost"), F.sum("change")).first()
        if tol is not None and (i % every == 0 or i == rounds):
            if change < n * tol:
                break
            if i == rounds:
                raise RuntimeError(f"PageRank has not settled within {rounds} rounds")
    return graph.by_name(state, "rank").select("v", F.col("value").alias("pagerank"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, component): smallest vertex id of the component.

    Labels are places in the order of the ids, kept as vectors of blocks (``_Tiled``).  Each round takes the smallest label
    of the neighbours along the tiles and then the label of that label (pointer jumping), so a long chain needs
    logarithmically many rounds; they go on until no label changes.
    """
    graph = _Tiled(edges, vertices, weighted=False)
    g = graph.g
    kinds = "block int, label array<long>, changed boolean"

    def push(xa: np.ndarray, xb: np.ndarray, cells: Iterable) -> tuple[np.ndarray, np.ndarray]:
        to_a, to_b = xa.copy(), xb.copy()
        for i, j in cells:
            np.minimum.at(to_b, j, xa[i])
            np.minimum.at(to_a, i, xb[j])
        return to_a, to_b

    def lowest(parts: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        label = np.array(old["label"].iloc[0], dtype=np.int64)
        low = label.copy()
        for part in parts.get("part", []):
            np.minimum(low, part, out=low)
        return pd.DataFrame({"block": [old["block"].iloc[0]], "label": [low], "changed": [bool((low != label).any())]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, label in zip(pdf["block"], pdf["label"]):
                want = np.unique(np.asarray(label, dtype=np.int64))
                for k in range(g):
                    yield pd.DataFrame({"block": [k], "asker": [block], "want": [want[want % g == k]]})

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({"block": [], "want": [], "hop": []}, dtype=object)
        label = np.asarray(own["label"].iloc[0])
        return pd.DataFrame({"block": asked["asker"], "want": asked["want"], "hop": [label[np.asarray(w, dtype=np.int64) // g] for w in asked["want"]]})

    def jump(hops: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        label = np.asarray(old["label"].iloc[0], dtype=np.int64)
        if len(label):
            want, hop = (np.concatenate([np.asarray(p, dtype=np.int64) for p in hops[c]]) for c in ("want", "hop"))
            order = np.argsort(want)
            label = np.minimum(label, hop[order[np.searchsorted(want[order], label)]])
        return pd.DataFrame({"block": old["block"], "label": [label], "changed": old["changed"]})

    def block_order(n: Column) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda p: p * g + F.col("block"))).otherwise(F.array().cast("array<long>"))

    state = cut_lineage(graph.blocks.select("block", block_order(F.col("size")).alias("label"), F.lit(True).alias("changed")))
    while True:
        low = cut_lineage(graph.along_edges(state, "label", "long", push).groupBy("block").cogroup(state.groupBy("block")).applyInPandas(lowest, kinds))
        if low.where("changed").isEmpty():
            break
        hops = low.select("block", "label").mapInPandas(ask, "block int, asker int, want array<long>")
        hops = hops.groupBy("block").cogroup(low.groupBy("block")).applyInPandas(answer, "block int, want array<long>, hop array<long>")
        state = cut_lineage(hops.groupBy("block").cogroup(low.groupBy("block")).applyInPandas(jump, kinds))
    smallest = graph.names.select(F.col("place").alias("value"), F.col("v").alias("component"))
    return graph.by_name(low, "label").join(smallest, "value").select("v", "component")


def betweenness(edges: DataFrame, vertices: DataFrame | None = None, inverse_weight: bool = False, batch_sources: int = 1024) -> DataFrame:
    """Normalised betweenness with the weight (above 0) as distance, exact, as joins on (source, vertex).

    Sources are taken in batches of about ``batch_sources``: the distances, path counts and path edges of a batch are
    folded into one dependency per vertex and dropped, so the state is batch x vertices, never vertices x vertices.
    Nothing is broadcast and no source is handled by a single task.  Rounds go on until nothing changes; sums of weights
    are equal when they agree to twelve digits.
    """
    if not edges.where("weight is null or not weight > 0").isEmpty():
        raise ValueError("betweenness needs weights above 0: paths of length 0 have no shortest form")
    links = both_ways(edges).groupBy("u", "v").agg(F.min(F.when(F.lit(inverse_weight), 1 / F.col("w")).otherwise(F.col("w"))).alias("w"))
    links = cut_lineage(links)
    verts = cut_lineage(vertices_of(edges, vertices))
    n = verts.count()
    batches = max(1, -(-n // batch_sources))
    total = None
    for i in range(batches):
        sources = verts.where(F.pmod(F.xxhash64("v"), F.lit(batches)) == i)
        part = cut_lineage(_dependencies(links, sources))
        total = part if total is None else cut_lineage(total.unionByName(part).groupBy("k").agg(F.sum("x").alias("x")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return verts.join(total.withColumnRenamed("k", "v"), "v", "left").select("v", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(k, x): how much the shortest paths from ``sources`` depend on vertex k.

    1. distances: relax the edges of the frontier until nothing changes; 2. shortest-path counts: one wave per hop along
    the edges that lie on shortest paths; 3. dependencies: waves backwards with the ratio of path counts.
    """
    dist = cut_lineage(sources.select(F.col("v").alias("s"), "v", F.lit(0.0).alias("d"), F.lit(True).alias("fresh")))
    while True:
        step = dist.where("fresh").select("s", F.col("v").alias("u"), "d").join(links, "u").select("s", "v", (F.col("d") + F.col("w")).alias("d"))
        best = step.groupBy("s", "v").agg(F.min("d").alias("nd"))
        dist = cut_lineage(dist.join(best, ["s", "v"], "full").select(
            "s", "v", F.least(F.coalesce("d", "nd"), F.coalesce("nd", "d")).alias("d"),
            (F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d") * (1 - 1e-12)))).alias("fresh"),
        ))
        if dist.where("fresh").isEmpty():
            break
    du = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    on_path = du.join(links, "u").join(dist.select("s", "v", "d"), ["s", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("d")) <= 1e-12 * F.col("d"))
    on_path = cut_lineage(on_path.select("s", "u", "v"))

    def waves(start: DataFrame, step: DataFrame, come: str, go: str) -> DataFrame:
        """Sum of all waves of a linear propagation along the path edges."""
        total, wave = start, start
        while True:
            wave = wave.withColumnRenamed("k", come).join(step, ["s", come]).groupBy("s", F.col(go).alias("k")).agg(F.sum(F.col("x") * F.col("f")).alias("x"))
            wave = cut_lineage(wave)
            if wave.isEmpty():
                break
            total = total.unionByName(wave)
        return cut_lineage(total.groupBy("s", "k").agg(F.sum("x").alias("x")))

    sigma = waves(sources.select(F.col("v").alias("s"), F.col("v").alias("k"), F.lit(1.0).alias("x")), on_path.withColumn("f", F.lit(1.0)), "u", "v")
    su = sigma.select("s", F.col("k").alias("u"), F.col("x").alias("xu"))
    sv = sigma.select("s", F.col("k").alias("v"), F.col("x").alias("xv"))
    back = cut_lineage(on_path.join(su, ["s", "u"]).join(sv, ["s", "v"]).select("s", "u", "v", (F.col("xu") / F.col("xv")).alias("f")))
    ones = sigma.where(F.col("s") != F.col("k")).select("s", "k", F.lit(1.0).alias("x"))
    delta = waves(ones, back, "v", "u").join(ones.select("s", "k", F.lit(1.0).alias("own")), ["s", "k"])
    return delta.groupBy("k").agg(F.sum(F.col("x") - F.col("own")).alias("x"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the modularity of (v, community)."""
    a = labels.select(F.col("v").alias("source"), F.col("community").alias("cs"))
    b = labels.select(F.col("v").alias("target"), F.col("community").alias("ct"))
    e = edges.join(a, "source").join(b, "target")
    m = e.agg(F.sum("weight").alias("m")).scalar()
    inside = e.where(F.col("cs") == F.col("ct")).groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("i"))
    ends = e.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "weight"), F.struct(F.col("ct").alias("c"), "weight"))).alias("x")).select("x.c", "x.weight")
    tot = ends.groupBy("c").agg(F.sum("weight").alias("k")).join(inside, "c", "left").withColumn("m", m)
    part = F.coalesce("i", F.lit(0.0)) / F.col("m") - resolution * (F.col("k") / (2 * F.col("m"))) * (F.col("k") / (2 * F.col("m")))
    return tot.agg(F.sum(part).alias("modularity"))


def settled_moves(links: DataFrame, resolution: float = 1.0, max_rounds: int = 1000, level: int = 0) -> tuple[DataFrame, list[float]]:
    """((v, c), modularity after each round): local moving until no vertex gains by leaving its community.

    ``links`` hold both directions of every edge, loops once with twice their weight.  A round first moves half of the
    vertices that gain (by a keyed coin) at once.  Where that would not raise the modularity, it makes only the moves
    that are the best of all moves into or out of both their communities: these share no community, so their gains add
    up exactly, and the best move of all is always among them.  The modularity therefore rises in every round, and an
    error tells that ``max_rounds`` were not enough.
    """
    degree = cut_lineage(links.groupBy(F.col("u").alias("v")).agg(F.sum("w").alias("k")))
    m2 = degree.agg(F.sum("k")).first()[0]
    comm = cut_lineage(degree.select("v", F.col("v").alias("c")))
    if not m2:
        return comm, []

    def quality(labels: DataFrame) -> float:
        ends = labels.select(F.col("v").alias("u"), F.col("c").alias("cu"))
        inside = links.join(ends, "u").join(labels, "v").where(F.col("cu") == F.col("c")).agg(F.sum("w").alias("x"))
        part = F.col("k") / m2
        spread = degree.join(labels, "v").groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(part * part).alias("x"))
        return (inside.first()[0] or 0.0) / m2 - resolution * spread.first()[0]

    now, path = quality(comm), []
    for step in range(max_rounds):
        state = degree.join(comm, "v")
        totals = state.groupBy("c").agg(F.sum("k").alias("tot"))
        near = links.where(F.col("u") != F.col("v")).join(comm.select("v", F.col("c").alias("nc")), "v").groupBy("u", "nc").agg(F.sum("w").alias("kin"))
        own = state.select(F.col("v").alias("u"), F.col("c").alias("nc"), F.lit(0.0).alias("kin"))
        cand = near.unionByName(own).groupBy("u", "nc").agg(F.sum("kin").alias("kin"))
        cand = cand.join(state.select(F.col("v").alias("u"), "k", "c"), "u").join(totals.withColumnRenamed("c", "nc"), "nc")
        rest = F.col("tot") - F.when(F.col("nc") == F.col("c"), F.col("k")).otherwise(0.0)
        cand = cand.withColumn("gain", F.round(F.col("kin") - resolution * F.col("k") * rest / m2, 9))
        best = cand.groupBy("u").agg(
            F.max("gain").alias("g"), F.min_by("nc", F.struct(-F.col("gain"), F.col("nc"))).alias("to"),
            F.max(F.when(F.col("nc") == F.col("c"), F.col("gain"))).alias("stay"), F.first("c").alias("c"),
        )
        best = best.select(F.col("u").alias("v"), "c", "to", (F.col("g") - F.col("stay")).alias("more"), keyed_uniform(level, step, "u").alias("coin"))
        best = cut_lineage(best)
        wants = best.where(F.col("more") > 1e-8)
        if wants.isEmpty():
            return comm, path
        bulk = F.when((F.col("more") > 1e-8) & (F.col("coin") < 0.5), F.col("to")).otherwise(F.col("c"))
        moved = cut_lineage(best.select("v", bulk.alias("c")))
        after = quality(moved)
        if after <= now + 1e-12:
            rank = F.struct("more", "coin", "v")
            top = wants.select(F.explode(F.array("c", "to")).alias("x"), rank.alias("rank")).groupBy("x").agg(F.max("rank").getField("v").alias("first"))
            alone = wants.join(top.toDF("c", "out"), "c").join(top.toDF("to", "in"), "to").where((F.col("out") == F.col("v")) & (F.col("in") == F.col("v")))
            moved = best.select("v", "c").join(alone.select("v", "to"), "v", "left").select("v", F.coalesce("to", "c").alias("c"))
            moved = cut_lineage(moved)
            after = quality(moved)
        comm, now = moved, after
        path.append(now)
    raise RuntimeError(f"local moving has not settled within {max_rounds} rounds")


def louvain(edges: DataFrame, vertices: DataFrame | None = None, resolution: float = 1.0, max_rounds: int = 1000) -> DataFrame:
    """(v, community): local moving (``settled_moves``) and contraction until nothing merges; a community is named after its smallest member."""
    edges = cut_lineage(edges.select("source", "target", "weight"))
    member = cut_lineage(vertices_of(edges, vertices).select("v", F.col("v").alias("node")))
    links = cut_lineage(both_ways(canonical_edges(edges)))
    level = 0
    while True:
        comm, path = settled_moves(links, resolution, max_rounds, level)
        if not path:
            break
        names = comm.groupBy("c").agg(F.min("v").alias("to"))
        comm = cut_lineage(comm.join(names, "c").select(F.col("v").alias("node"), "to"))
        member = cut_lineage(member.join(comm, "node", "left").select("v", F.coalesce("to", "node").alias("node")))
        a, b = comm.toDF("u", "a"), comm.toDF("v", "b")
        # both directions of an inner edge fall on one loop, which so carries twice the weight
        links = cut_lineage(links.join(a, "u").join(b, "v").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")))
        level += 1
    first = member.groupBy("node").agg(F.min("v").alias("community"))
    return member.join(first, "node").select("v", "community")


def rewired(edges: DataFrame, replicates: DataFrame, rounds: int = 8, seed: int = 42) -> DataFrame:
    """(replicate, source, target, weight): degree-preserving random graphs with shuffled weights.

    Edges are numbered once and keep their places.  A round pairs the places of each replicate by a keyed bijection and
    swaps the ends of all pairs at once; a swap that would make a loop or a duplicate (of a present edge or of another
    swap) is refused.  Half of the edges try per round and end, so eight rounds are about 4 x edges attempts.  A last
    bijection deals the weights out again.
    """
    base = numbered(canonical_edges(edges), ["source", "target"])
    size = base.count()
    reps = replicates.select("replicate", *[round_keys(seed, i, "replicate").alias(f"k{i}") for i in range(rounds + 1)])
    reps = cut_lineage(reps)  # one row per replicate, a parameter
    cur = base.select("_place", "source", "target", F.explode(reps.agg(F.collect_list("replicate").alias("r")).scalar()).alias("replicate"))
    for i in range(rounds):
        rows = cur.join(F.broadcast(reps.select("replicate", F.col(f"k{i}").alias("_keys"))), "replicate")
        at = shuffled_place(F.col("_place"), size, F.col("_keys"))
        rows = rows.withColumn("_at", at).drop("_keys").withColumn("_p", F.expr("_at div 2")).withColumn("_first", F.col("_at") % 2 == 0)
        flip = keyed_uniform(seed + 1, i, "replicate", "source", "target") < 0.5
        rows = rows.withColumn("a", F.when(flip, F.col("source")).otherwise(F.col("target"))).withColumn("b", F.when(flip, F.col("target")).otherwise(F.col("source")))
        rows = cut_lineage(rows)
        pair = rows.groupBy("replicate", "_p").agg(
            F.max(F.when(F.col("_first"), F.struct("a", "b", "_place"))).alias("x"), F.max(F.when(~F.col("_first"), F.struct("a", "b", "_place"))).alias("y")
        )
        ends = [F.struct(F.col(f"{u}.a").alias("a"), F.col(f"{v}.b").alias("b"), F.col(f"{u}._place").alias("_place")) for u, v in (("x", "y"), ("y", "x"))]
        new = pair.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("replicate", "_p", F.explode(F.array(*ends)).alias("e"))
        new = new.select("replicate", "_p", "e._place", F.least("e.a", "e.b").alias("source"), F.greatest("e.a", "e.b").alias("target"))
        seen = F.count(F.lit(1)).over(Window.partitionBy("replicate", "source", "target"))
        new = new.withColumn("_n", seen).join(rows.select("replicate", "source", "target", F.lit(1).alias("_have")), ["replicate", "source", "target"], "left")
        bad = (F.col("source") == F.col("target")) | (F.col("_n") > 1) | F.col("_have").isNotNull()
        ok = new.withColumn("_bad", bad.cast("int")).withColumn("_any", F.max("_bad").over(Window.partitionBy("replicate", "_p"))).where("_any = 0")
        ok = cut_lineage(ok.select("replicate", "_place", "source", "target"))
        kept = rows.join(ok, ["replicate", "_place"], "left_anti").select("replicate", "_place", "source", "target")
        cur = kept.unionByName(ok)
    placed = cur.join(F.broadcast(reps.select("replicate", F.col(f"k{rounds}").alias("_keys"))), "replicate")
    placed = placed.withColumn("_place", shuffled_place(F.col("_place"), size, F.col("_keys")))
    return placed.join(base.select("_place", "weight"), "_place").select("replicate", "source", "target", "weight")


def adjacency(rows: DataFrame, evidence: Sequence[str], score: str | None = None, min_score: float = 700.0) -> DataFrame:
    """Symmetric weights: mean absolute evidence, largest of duplicates, scaled by the overall maximum."""
    kept = rows.where(F.col(score) >= min_score) if score else rows
    kept = kept.withColumn("weight", null_skipping_mean([F.abs(F.col(c)) for c in evidence])).where(F.col("weight").isNotNull())
    edges = canonical_edges(kept.select("source", "target", "weight"))
    top = edges.agg(F.max("weight").alias("m")).scalar()
    return edges.withColumn("weight", F.when(top > 0, F.col("weight") / top).otherwise(F.col("weight")))


def normalised_adjacency(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Coordinate form of D^-1/2 (A + I) D^-1/2."""
    full = both_ways(edges).unionByName(vertices_of(edges, vertices).select(F.col("v").alias("u"), "v", F.lit(1.0).alias("w")))
    deg = full.groupBy("u").agg(F.sum("w").alias("k"))
    out = full.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v")
    return out.select("u", "v", (F.col("w") / F.sqrt(F.col("k") * F.col("kv"))).alias("w"))


def robust_scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / IQR, an IQR of 0 counts as 1, missing becomes 0."""
    out = df
    for c in cols:
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75]).agg(F.map_from_entries(F.collect_list(F.struct("q", "quantile"))).alias("m")).scalar()
        out = out.withColumn("_q", q)
        spread = F.element_at("_q", F.lit(0.75)) - F.element_at("_q", F.lit(0.25))
        scaled = (F.col(c) - F.element_at("_q", F.lit(0.5))) / F.when(spread > 0, spread).otherwise(1.0)
        out = out.withColumn(c, F.coalesce(scaled, F.lit(0.0))).drop("_q")
    return out


def graph_summary(edges: DataFrame, sign: Column | None = None) -> DataFrame:
    """Nodes, edges, mean degree, density, components, positive and negative edges."""
    edges = cut_lineage(edges)
    comps = connected_components(edges)
    nodes = comps.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("c"))
    both = nodes.select(F.struct("n", "c").alias("s")).scalar()
    s = sign if sign is not None else F.col("weight")
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(s > 0).alias("n_positive"), F.count_if(s < 0).alias("n_negative")).withColumn("_s", both)
    n = F.col("_s.n")
    return e.select(
        n.alias("n_nodes"), "n_edges", (2 * F.col("n_edges") / n).alias("mean_degree"), (2 * F.col("n_edges") / (n * (n - 1))).alias("density"),
        F.col("_s.c").alias("n_components"), "n_positive", "n_negative",
    )
