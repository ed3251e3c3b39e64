"""Merkle manifest of a dataset: a hash tree per source over its documents, and one tree over the sources' roots.

Every level is a table of nodes (tree, idx, digest).  A node's siblings have computed indices - ``idx ^ 1`` in a binary
tree, the other slots of its run otherwise - so a level is joined with itself by equality on (tree, sibling index), once
per offset.  The rows in slot zero then hold all children of their parent and emit it.  Going down again, a node's
proof is its own siblings followed by its parent's proof; keys are unique on both sides, so a source that holds a third
of all rows spreads like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from targetloom.llm.ordering import number_within
from targetloom.llm.registry import query, table
from targetloom.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
STEP = "struct<left:binary,right:binary>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over each value as byte count, colon and value, a null as a dash; 32 bytes."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return _sha(F.concat(*parts))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, digest, left, right): the digests of a node's siblings before and after it, each in order."""
    idx = F.col("idx")
    slot = idx % fanout
    joined = nodes
    siblings = []
    for offset in range(1, fanout):
        at = idx.bitwiseXOR(F.lit(1)) if fanout == 2 else idx - slot + (slot + offset) % fanout
        other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias(f"_i{offset}"), F.col("digest").alias(f"_s{offset}"))
        joined = joined.withColumn("_at", at).join(other, (F.col("tree") == F.col("_t")) & (F.col("_at") == F.col(f"_i{offset}")), "left").drop("_t", "_at")
        siblings.append(F.struct(F.col(f"_i{offset}").alias("i"), F.col(f"_s{offset}").alias("d")))
    there = F.array_sort(F.filter(F.array(*siblings), lambda s: s.i.isNotNull()))

    def run(which: Column) -> Column:
        return F.unhex(F.array_join(F.transform(which, lambda s: F.hex(s.d)), ""))

    return joined.select(
        "tree", "idx", "digest", run(F.filter(there, lambda s: s.i < idx)).alias("left"), run(F.filter(there, lambda s: s.i > idx)).alias("right"),
    )


def _grow(nodes: DataFrame, largest: int, fanout: int) -> list[DataFrame]:
    """Levels from the leaves up, as written tables; a tree's last node, its root, has no siblings and index zero."""
    levels = [cut_lineage(_with_siblings(nodes, fanout))]
    while largest > 1:
        inner = levels[-1].where((F.col("idx") % fanout == 0) & ((F.col("idx") > 0) | (F.octet_length("right") > 0)))
        parents = inner.select("tree", F.expr(f"idx div {fanout}").alias("idx"), _sha(F.concat(_hex(F.col("digest")), _hex(F.col("right")))).alias("digest"))
        levels.append(cut_lineage(_with_siblings(parents, fanout)))
        largest = -(-largest // fanout)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    alone = [x.where((F.col("idx") == 0) & (F.octet_length("right") == 0)).select("tree", "digest") for x in levels]
    out = alone[0]
    for x in alone[1:]:
        out = out.union(x)
    return out


def _paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, path, subroot) of the lowest level; ``above`` is (tree, path, subroot) of each tree's root."""
    up = None
    for level in reversed(levels):
        is_root = (F.col("idx") == 0) & (F.octet_length("right") == 0)
        here = level.where(is_root).select("tree", "idx").join(above, "tree")
        if up is not None:
            parents = cut_lineage(up).select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"), "subroot")
            rest = level.where(~is_root).withColumn("_up", F.expr(f"idx div {fanout}")).join(parents, ["tree", "_up"])
            here = here.union(rest.select("tree", "idx", F.concat(F.array(F.struct("left", "right")), F.col("_path")).alias("path"), "subroot"))
        up = here
    return up


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (tree string, id, leaf binary, ...) with tree place, subroot, root and path added to every row.

    ``path`` lists, from the leaf through its tree's root to the root of all, the concatenated digests of the siblings
    left and right of each node.  Leaves ascend by ``id`` (nulls first) within ``tree``; rows repeating an identifier
    ascend by leaf, so their order is fixed but for equal leaves.  ``tree`` must not be null.
    """
    numbered = cut_lineage(number_within(leaves, "tree", ["id", "leaf"], "idx"))
    largest = numbered.agg(F.max("idx")).first()[0]
    lower = _grow(numbered.select("tree", "idx", F.col("leaf").alias("digest")), 1 + (-1 if largest is None else largest), fanout)
    subroots = _roots(lower).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    places = cut_lineage(number_within(subroots, "tree", ["name"], "idx"))
    upper = _grow(places.select("tree", "idx", "digest"), places.count(), fanout)
    no_siblings = upper[0].select("tree").distinct().select("tree", F.array().cast(f"array<{STEP}>").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    top = _paths(upper, no_siblings, fanout).drop("subroot")
    above = places.join(top, ["tree", "idx"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    root = _roots(upper).agg(F.first("digest").alias("root")).scalar()
    return numbered.join(_paths(lower, cut_lineage(above), fanout), ["tree", "idx"]).withColumn("root", root)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path; 32 bytes."""
    return F.aggregate(path, leaf, lambda low, step: _sha(F.concat(_hex(step.left), _hex(low), _hex(step.right))))


def verify_documents(docs: DataFrame, tampered: Column, fanout: int = FANOUT, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row per input row: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests in hex.

    ``columns`` are hashed into the leaf; the first is the identifier, the second the source, the last the text.
    Where ``tampered`` (a condition on the input) holds, the leaf is recomputed without the text's line feeds and folded
    with the siblings of the original.  Nulls: hashed as a dash, apart from the empty text; a null source is a source of
    its own and the first one; a null identifier comes first and is never tampered with by a condition that is null.
    Repeated rows are leaves of their own.  An empty table gives no rows; other columns are not read.
    """
    named = [F.col(f"`{c}`") for c in columns]
    cut = leaf_digest(*named[:-1], F.translate(named[-1], "\n", ""))
    source = named[1].cast("string")
    leaves = docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("+"), source)).alias("tree"), named[0].alias("id"), leaf_digest(*named).alias("leaf"),
        F.when(tampered, cut).alias("changed"),
    )
    placed = manifest(leaves, fanout)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(_hex(step.left), _hex(step.right))), "")
    out = placed.select(
        F.col("id").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), _hex(folded(F.coalesce("changed", "leaf"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


CRC32 = """
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(length({0})), lambda i: [ord({0}[i + 1]) + 1, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, op: CASE WHEN op > 0 THEN xor(s, op - 1) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)
"""  # an entry above zero adds a byte, each of the eight zeros after it shifts one bit out


@query(
    "op11_manifest",
    f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, '+' || source AS src, source, lang, n_chars, text, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS hit FROM documents
    ),
    leaf AS (
        SELECT doc_id, coalesce(src, '') AS tree, row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS idx,
            sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || CASE WHEN hit THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS changed
        FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d)
    ),
    low AS (
        SELECT 0 AS level, tree, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaf
        UNION ALL
        SELECT level + 1, tree, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY level, tree, idx // 3
    ),
    sub AS (SELECT tree, digest AS subroot, level AS height FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, subroot AS digest, count(*) OVER () AS n FROM sub
        UNION ALL
        SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, idx // 3
    ),
    place AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS place FROM sub),
    steps AS (
        SELECT l.doc_id, w.level, string_agg(w.digest, '' ORDER BY w.idx) FILTER (w.idx < l.idx // CAST(3 ** w.level AS BIGINT)) AS a,
            string_agg(w.digest, '' ORDER BY w.idx) FILTER (w.idx > l.idx // CAST(3 ** w.level AS BIGINT)) AS b
        FROM leaf l JOIN low w ON w.tree = l.tree AND w.n > 1 AND w.idx // 3 = l.idx // CAST(3 ** (w.level + 1) AS BIGINT) GROUP BY l.doc_id, w.level
        UNION ALL
        SELECT l.doc_id, 1000 + w.level, string_agg(w.digest, '' ORDER BY w.idx) FILTER (w.idx < p.place // CAST(3 ** w.level AS BIGINT)),
            string_agg(w.digest, '' ORDER BY w.idx) FILTER (w.idx > p.place // CAST(3 ** w.level AS BIGINT))
        FROM leaf l JOIN place p USING (tree) JOIN high w ON w.n > 1 AND w.idx // 3 = p.place // CAST(3 ** (w.level + 1) AS BIGINT) GROUP BY l.doc_id, w.level
    ),
    proof AS (
        SELECT doc_id, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY level) AS siblings, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY level) AS path
        FROM steps GROUP BY doc_id
    ),
    done AS (
        SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
            list_reduce(list_concat([{{'a': l.changed, 'b': ''}}], coalesce(path, [])), lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root
        FROM leaf l JOIN sub s USING (tree) LEFT JOIN proof p ON p.doc_id = l.doc_id
    )
    SELECT *, folded_root = root AS verified FROM done
    """,
)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verify_documents(table(spark, sf_dir, "documents"), tampered)
