"""N-gram Jaccard join with several global token orders.

Under any global order of the tokens, two sets that are similar enough share tokens in their prefixes.  Three orders are
used: ascending hash, descending hash, and rarity among the documents that the first one leaves.  A document goes on
only while its prefix shares enough tokens with others; rarity prefixes, where common passages come last, part the
rest into clusters; inside a cluster a pair is verified only if the prefixes meet under both hash orders.

Equal sets are one class from the start.  In a large corpus chance tokens chain rarity clusters to a few giants: those
above ``block`` classes are parted once more, by rarity among themselves, and classes that share a token stay together
only if counts of their tokens in ``BUCKETS`` buckets allow the overlap.  What is still above ``block`` classes is first
held against one block of itself, and then only what is not yet in its largest component against all, in blocks, a few
of them at a time: a group of many near copies costs about its size, no pair is left out that could join two
components, no table of pairs is made, and the sets on disk at once are a few times those of the wide clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm import anchors
from targetloom.llm.components import component_labels, smallest_labels
from targetloom.llm.registry import query, table
from targetloom.llm.wordgrid import Words, mix, prefix_hash, signed, span_hash, words_of
from targetloom.session import cut_lineage

SHINGLE = 4
PERCENT = 85
SLACK_PERCENT = 20  # prefixes are longer than needed by this share, and must share so many tokens more
BLOCK = 512
BLOCK_TOKENS = 1 << 20
HASH_BITS = 1 << 27
BUCKETS = 64
ROUND_BLOCKS = 2  # of what is held against all of a wide cluster at a time
PAIRS_AT_ONCE = 1 << 16
LIST_ROWS = 1 << 14  # held at a time, the last list aside


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of the distinct shingles of all texts, by text and ascending token."""
    prefix = prefix_hash(words.hashes(0), 0)
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    token = span_hash(prefix, start, np.minimum(start + size, words.first[text + 1]), 0)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    return text[new], token[new]


def slack(n: np.ndarray) -> np.ndarray:
    return 1 + n * SLACK_PERCENT // 100


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of ``n`` shares at least with any set similar enough to it."""
    return -(-n * percent // 100)


def shared_counts(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Tokens that each of the first ``n_left`` sets shares with each set.

    Tokens found in the same sets are one weighted column, so near copies make few columns.
    """
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((n_left, len(sets)))
    if not len(token):
        return out
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(head, len(token)))
    sign = np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), head)
    _, pick, weight = np.unique(sign, return_index=True, return_counts=True)
    keep = sizes[pick] > 1
    pick, weight = pick[keep], weight[keep].astype(np.float64)
    for i in range(0, len(pick), 2048):
        some = pick[i : i + 2048]
        column = np.repeat(np.arange(len(some)), sizes[some])
        member = np.concatenate([owner[head[p] : head[p] + sizes[p]] for p in some.tolist()])
        x = np.zeros((len(sets), len(some)))
        x[member, column] = 1
        out += (x[:n_left] * weight[i : i + 2048]) @ x.T
    return out


def linked_parts(sets: list[np.ndarray], n_left: int, percent: int) -> np.ndarray:
    """Component (smallest index) of each set under the links between the first ``n_left`` sets and all of them.

    ``sets`` are sorted by token.  Filters first: both hash orders' prefixes must meet; then the overlap itself.
    """
    n = np.array([len(s) for s in sets])
    need = n - least_overlap(n, percent) + 1
    candidate = shared_counts([s[:p] for s, p in zip(sets, need)], n_left) > 0
    candidate &= shared_counts([s[len(s) - p :] for s, p in zip(sets, need)], n_left) > 0
    candidate[np.arange(n_left), np.arange(n_left)] = False
    label = np.arange(len(sets))
    used = np.flatnonzero(candidate.any(axis=0) | np.append(candidate.any(axis=1), np.zeros(len(sets) - n_left, dtype=bool)))
    left = used[used < n_left]
    if not len(left):
        return label
    shared = shared_counts([sets[i] for i in used], len(left))
    linked = candidate[np.ix_(left, used)] & (100 * shared >= percent * (n[left][:, None] + n[used][None, :] - shared))
    a, b = np.nonzero(linked)
    a, b = left[a], used[b]
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def near_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Words are parted by ASCII white space and A to Z made small; a set holds the distinct runs of ``size`` words, or all
    words as one run where they are fewer.  Two sets are linked when 100 x intersection >= ``percent`` x union.  The
    component is the smallest identifier that links reach.  A null or empty text has an empty set, linked with nothing:
    its component is its own identifier.  Rows that repeat an identifier are rows of their own; a null identifier takes
    the smallest of its component, null if there is none.  An empty table gives no rows; other columns are not read.
    """
    return _placed(anchors.keyed(docs, id_col, text_col), percent, size, block).drop("th", "part")


def drop_near(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``near_components``: that with the smallest identifier.

    Components are told apart by what they hold, not by identifiers, so those without one or with the same one each keep
    their document.  Null identifiers come last, and of one identifier's texts an arbitrary but fixed one stays; of rows
    equal in identifier and text, any one.  Rows with an empty set stay.  Columns are unchanged, whatever their names.
    """
    placed = _placed(anchors.keyed(docs, id_col, text_col), percent, size, block)
    rows = placed.where("n_shingles > 0").groupBy("part", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "rows")).alias("f"))
    blank = placed.where("n_shingles = 0").select("doc_id", "th", F.lit(1).cast("long")).distinct()
    kept = cut_lineage(first.select(F.col("f.doc_id").alias("_keep_id"), F.col("f.th").alias("_keep_th"), F.col("f.rows").alias("_keep_rows")).union(blank))
    met = docs[id_col].eqNullSafe(F.col("_keep_id")) & (anchors.row_digest(docs[id_col], docs[text_col]) == F.col("_keep_th"))
    out = docs.join(kept.where("_keep_rows = 1"), met, "left_semi")
    equal = kept.where("_keep_rows > 1")
    if equal.isEmpty():
        return out
    whole = docs.join(equal, met).select("_keep_id", "_keep_th", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    one = whole.groupBy("_keep_id", "_keep_th").agg(F.first("_row").alias("_row"))
    return out.union(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))


def _placed(rows: DataFrame, percent: int, size: int, block: int) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, part) of rows from ``anchors.keyed``; part names the component by its smallest class."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digests(text: np.ndarray, token: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, heads = np.bincount(text, minlength=count), np.searchsorted(text, np.arange(count))
        sums = []
        for seed in (0x51ED270B, 0x7F4A7C15):
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(token ^ np.uint64(seed)))))
            sums.append(signed(total[heads + n] - total[heads]))
        return n, sums[0], sums[1]

    def measure(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        text, token = shingle_sets(words_of(texts, lower=True), size)
        n, d1, d2 = digests(text, token, len(texts))
        return {"row": np.arange(len(texts)), "n": n.astype(np.int64), "d1": d1, "d2": d2}

    measured = cut_lineage(anchors.over_texts(rows, "n long, d1 long, d2 long", measure))
    mask = _token_mask(measured)

    def prefixes(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        text, token = shingle_sets(words_of(texts, lower=True), size)
        n = np.bincount(text, minlength=len(texts))
        length = np.minimum(n, n - least_overlap(n, percent) + slack(n))
        place = np.arange(len(text)) - np.searchsorted(text, np.arange(len(texts)))[text]
        some = place < length[text]
        return {"row": text[some], "token": signed(token[some]) & mask}

    # first order: prefixes by ascending hash; a document must share so many tokens as any partner would
    shared = anchors.over_texts(rows, "token long", prefixes, carry=()).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    need = 1 + F.floor(F.ceil(F.col("n") * percent / 100) * SLACK_PERCENT / 100)
    met = anchors.over_texts(rows, "token long", prefixes, carry=("doc_id",)).join(shared, "token", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("met"))
    classes = measured.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    # an identifier that stands on several rows has their sum: none of them is lost
    left = cut_lineage(classes.join(met.withColumnRenamed("doc_id", "m_id"), F.col("rep").eqNullSafe(F.col("m_id"))).where(F.col("met") >= need).select("d1", "d2", "rep"))
    asked = cut_lineage(left.select(F.col("rep").alias("a_id")).distinct())

    def fetch(texts: list[bytes], first: int, batch: pa.RecordBatch) -> dict:
        text, token = shingle_sets(words_of(texts, lower=True), size)
        n, d1, d2 = digests(text, token, len(texts))
        ends = np.cumsum(n)
        sets = [token[e - c : e].tobytes() for e, c in zip(ends.tolist(), n.tolist())]
        return {"row": np.arange(len(texts)), "d1": d1, "d2": d2, "n": n.astype(np.int64), "tokens": pa.array(sets, pa.binary())}

    texts = _perhaps_asked(rows, asked).join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")), "left_semi")
    found = anchors.over_texts(texts, "d1 long, d2 long, n long, tokens binary", fetch, carry=()).join(left.select("d1", "d2"), ["d1", "d2"], "left_semi")
    once = found.groupBy("d1", "d2", "n").agg(F.first("tokens").alias("tokens"))
    sets = cut_lineage(once.withColumn("class", F.monotonically_increasing_id()))

    edges = cut_lineage(_cluster_edges(sets.select("class", "n", "tokens"), percent, mask))  # components read them twice
    links = _verified(sets.select("class", "n", "tokens"), edges, percent, block, mask)
    labels = component_labels(links)
    named = sets.select("class", "d1", "d2").join(labels, F.col("class") == F.col("node")).select("d1", "d2", "label")
    known = classes.join(named, ["d1", "d2"]).select("d1", "d2", "n", "rep", "label")
    lowest = known.groupBy("label").agg(F.min("rep").alias("low"), F.min(F.struct("d1", "d2", "n")).alias("head"))
    grouped = known.join(lowest, "label").select("d1", "d2", "n", "low", "head")
    part = F.coalesce("head", F.struct("d1", "d2", "n")).alias("part")
    final = classes.join(grouped, ["d1", "d2", "n"], "left").select("d1", "d2", "n", F.coalesce("low", "rep").alias("component_id"), part)
    placed = measured.join(final, ["d1", "d2", "n"], "left")
    return placed.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).cast(id_type).alias("component_id"), "part")


def _perhaps_asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` without most of those that the join with ``asked`` (a_id) drops, so that their texts are not shuffled.

    A broadcast set of hash bits, at most ``HASH_BITS`` (16 MB), says which identifiers may be asked for; none of those
    asked for is missing, and the join that follows drops the rest.
    """
    bits = max(1 << 18, min(HASH_BITS, 1 << (16 * asked.count()).bit_length()))
    bit = F.pmod(F.xxhash64("a_id"), F.lit(bits))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << 18, dtype=bool)
        block[pdf["bit"].to_numpy() & ((1 << 18) - 1)] = True
        return pd.DataFrame({"block": [int(pdf["bit"].iloc[0]) >> 18], "bits": [np.packbits(block).tobytes()]})

    packed = np.zeros((bits >> 18, 1 << 15), dtype=np.uint8)
    for row in asked.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 18)).applyInPandas(fill, "block long, bits binary").toLocalIterator():
        packed[row.block] = np.frombuffer(row.bits, dtype=np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    @F.pandas_udf("boolean")
    def perhaps(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return rows.where(perhaps(F.pmod(F.xxhash64("doc_id"), F.lit(bits))))


def _token_mask(measured: DataFrame) -> int:
    """Low bits that tell the tokens of this corpus apart well enough for filters, about one clash in 32 tokens.

    Filters only ask whether tokens may be equal, so a clash lets a document through and loses none; fewer bits make the
    shuffles smaller.  Verification takes all 64.
    """
    total = measured.agg(F.sum("n")).first()[0] or 1
    return (1 << min(63, int(total).bit_length() + 5)) - 1


def _rarity_prefixes(sets: DataFrame, percent: int, mask: int) -> DataFrame:
    """(class, df, token, first) of each set's rarity prefix: its tokens, the sets they are in and the first of those."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                token = np.frombuffer(batch.column("tokens")[i].as_py(), dtype=np.int64) & mask
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), batch.column("class")[i].as_py()))], ["token", "class"])

    tokens = sets.mapInArrow(explode, "token long, class long")
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("first"))
    common = tokens.join(df.where("df > 1"), "token")
    # the rarity prefix: tokens of one set alone come first and use it up, the others follow by (df, token)
    listed = common.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token", "first"))).alias("common"))
    sized = sets.select("class", "n").join(listed, "class")
    free = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("common"))
    first = F.explode(F.slice("common", F.lit(1), F.greatest(free, F.lit(0)).cast("int"))).alias("t")
    return sized.select("class", first).select("class", "t.df", "t.token", "t.first")


def _cluster_edges(sets: DataFrame, percent: int, mask: int) -> DataFrame:
    """(u, v) from each set to the first set of each token in its rarity prefix."""
    return _rarity_prefixes(sets, percent, mask).select(F.col("class").alias("u"), F.col("first").alias("v")).distinct()


def bucket_counts(token: np.ndarray) -> bytes:
    """Tokens of a set in each of ``BUCKETS`` buckets; all full for a set that could overflow one."""
    counts = np.bincount((token >> np.uint64(7)) % np.uint64(BUCKETS), minlength=BUCKETS) if len(token) <= 0xFFFF else np.full(BUCKETS, 0xFFFF)
    return counts.astype("<u2").tobytes()


def may_link(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of those sizes and bucket counts (pairs x buckets) can be similar enough: no linked pair is denied."""
    least = np.minimum(n_a, n_b)
    shared = np.where(least > 0xFFFF, least, np.minimum(least, np.minimum(a, b).sum(axis=1, dtype=np.int64)))
    return 100 * shared >= percent * (n_a + n_b - shared)


def _narrower_edges(sets: DataFrame, percent: int, block: int, mask: int) -> DataFrame:
    """(u, v) edges whose components hold all links between ``sets``, finer than those of ``_cluster_edges``.

    Sets that share a token of their rarity prefixes meet in a list; equal lists are one, and inside a list only pairs
    that ``may_link`` are joined.  The sets of a token that more than ``block`` sets hold are joined as they are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [bucket_counts(np.frombuffer(x.as_py(), dtype=np.uint64)) for x in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), pa.array(held, pa.binary())], ["class", "n", "counts"])

    def pairs_of(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = np.triu_indices(size, 1)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            yield i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]

    def solve(lists: np.ndarray, name: np.ndarray, n: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        sizes = np.diff(np.append(head, len(lists)))
        u, v = name, name
        for size in np.unique(sizes[sizes > 1]).tolist():
            starts = head[sizes == size]
            for i, j in pairs_of(size):
                step = max(1, PAIRS_AT_ONCE // len(i))
                for at in range(0, len(starts), step):
                    a, b = ((starts[at : at + step, None] + x).ravel() for x in (i, j))
                    good = may_link(n[a], counts[a], n[b], counts[b], percent)
                    u, v = np.append(u, name[a[good]]), np.append(v, name[b[good]])
                    if len(u) > 8 * PAIRS_AT_ONCE:
                        u, v = smallest_labels(u, v)
        u, v = smallest_labels(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype="<u2").reshape(-1, BUCKETS)
            held.append((*(batch.column(c).to_numpy() for c in ("list", "class", "n")), counts))
            rows += batch.num_rows
            if rows >= LIST_ROWS:  # all but the last list are whole
                whole = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield solve(*(x[:cut] for x in whole))
                held, rows = [tuple(x[cut:] for x in whole)], rows - cut
        if rows:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    prefixes = cut_lineage(_rarity_prefixes(sets, percent, mask))
    hot = prefixes.where(F.col("df") > block).select(F.col("class").alias("u"), F.col("first").alias("v"))
    lists = prefixes.where(F.col("df") <= block).groupBy("token").agg(F.sort_array(F.collect_list("class")).alias("classes")).where(F.size("classes") > 1).select("classes").distinct()
    met = lists.select(F.xxhash64("classes").alias("list"), F.explode("classes").alias("class")).join(sets.select("class", "n", "tokens").mapInArrow(count, "class long, n long, counts binary"), "class")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts, "list").sortWithinPartitions("list").select("list", "class", "n", "counts")
    return dealt.mapInArrow(run, "u long, v long").union(hot).distinct()


def _clusters(sets: DataFrame, edges: DataFrame, percent: int, block: int, mask: int) -> DataFrame:
    """(class, cluster) of all sets that ``edges`` join to others; clusters above ``block`` sets are parted again."""
    clusters = cut_lineage(component_labels(edges).select(F.col("node").alias("class"), F.col("label").alias("cluster")))
    wide = cut_lineage(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("cluster"))  # few: each holds over ``block`` sets
    if wide.isEmpty():
        return clusters
    inside = cut_lineage(sets.join(clusters.join(F.broadcast(wide), "cluster", "left_semi").select("class"), "class", "left_semi"))
    labels = component_labels(cut_lineage(_narrower_edges(inside, percent, block, mask)))
    return cut_lineage(clusters.join(F.broadcast(wide), "cluster", "left_anti").union(labels.select(F.col("node").alias("class"), F.col("label").alias("cluster")).select("cluster", "class")).select("class", "cluster"))


def _verified(sets: DataFrame, edges: DataFrame, percent: int, block: int, mask: int) -> DataFrame:
    """(u, v) edges that join the linked classes; every class of a cluster has at least a loop."""
    members = cut_lineage(_clusters(sets, edges, percent, block, mask).join(sets, "class"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / (block * BLOCK_TOKENS / BLOCK))).cast("int")
    sized = members.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    placed = members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    left = placed.where("block = 0").select("cluster", F.lit(0).alias("i"), everywhere, F.lit(0).alias("side"), "class", "tokens")
    right = placed.select("cluster", F.lit(0).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "class", "tokens").where("j > 0")
    first = cut_lineage(_units(left.union(right), percent))
    # clusters of several blocks: what the first block has not joined to the largest part is held against all
    wide = cut_lineage(sized.where("blocks > 1"))  # a row for each ``block`` classes at most
    if wide.isEmpty():
        return first
    inside = members.join(F.broadcast(wide), "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parts = component_labels(first).select(F.col("node").alias("class"), "label")
    sorted_in = cut_lineage(inside.join(parts, "class", "left").select("cluster", "class", "blocks", "block", F.coalesce("label", "class").alias("part")))
    largest = sorted_in.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", "count").alias("part"), F.max("count").alias("most"), F.sum("count").alias("all"))
    rest = sorted_in.join(largest.select("cluster", "part"), ["cluster", "part"], "left_anti")
    spread = largest.select("cluster", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("rests")).where("rests > 0")
    rest = rest.join(spread, "cluster").withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), F.col("rests")).cast("int"))
    left = cut_lineage(rest.select("cluster", "i", "blocks", "class"))
    most = left.agg(F.max("i")).first()[0]
    tokens = cut_lineage(inside.select("class", "tokens"))  # of wide clusters alone
    out = first
    for low in range(0, 0 if most is None else most + 1, ROUND_BLOCKS):
        some = left.where(F.col("i").between(low, low + ROUND_BLOCKS - 1)).select("cluster", "i", everywhere, F.lit(0).alias("side"), "class")
        turns = F.explode(F.sequence(F.lit(low), F.least(F.lit(low + ROUND_BLOCKS), F.col("rests")) - 1)).alias("i")
        right = inside.join(spread.where(F.col("rests") > low), "cluster").select("cluster", turns, F.col("block").alias("j"), F.lit(1).alias("side"), "class")
        out = out.union(cut_lineage(_units(some.union(right).join(tokens, "class"), percent)))
    return out


def _units(rows: DataFrame, percent: int) -> DataFrame:
    """Verify units (cluster, i, j): side 0 against both sides; edges (u, v) from each class to its part's first."""

    def solve(unit: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        unit.sort(key=lambda r: r[:2])
        left = {r[1] for r in unit if r[0] == 0}
        unit = [r for r in unit if r[0] == 0 or r[1] not in left]
        sets = [np.frombuffer(r[2], dtype=np.uint64) for r in unit]
        part = linked_parts(sets, len(left), percent)
        ids = np.array([r[1] for r in unit])
        return pd.DataFrame({"u": ids, "v": ids[part]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "class", "tokens")]
            for cluster, i, j, side, name, tokens in zip(*columns):
                if held and (cluster, i, j) != last:
                    yield pa.RecordBatch.from_pandas(solve(held), preserve_index=False)
                    held = []
                held.append((side, name, tokens))
                last = (cluster, i, j)
        if held:
            yield pa.RecordBatch.from_pandas(solve(held), preserve_index=False)

    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.select("cluster", "i", "j", "side", "class", "tokens").mapInArrow(run, "u long, v long")


@query("op2_prefix_orders")
def op2_prefix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
