"""Merkle manifest, token counts and prefix trie against plain Python versions and the library."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from targetloom.llm import manifest, ordering, prefix_trie
from tests.llm import brute

HEX = 64


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(digests, fanout):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings_of(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = level[i - i % fanout : i - i % fanout + fanout]
        out.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        i //= fanout
    return out


def manifest_rows(rows, hit, fanout):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names}
    above = levels_of([below[s][-1][0] for s in names], fanout)
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = siblings_of(below[s], i, fanout) + siblings_of(above, at, fanout)
            low = leaf_of((*r[:4], r[4].replace("\n", ""))) if hit(r) and r[4] is not None else leaf
            for a, b in path:
                low = sha(a, low, b)
            root = above[-1][0]
            out.append((r[0], leaf, below[s][-1][0], root, sha(*[a + b for a, b in path]), low, low == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "", None]), "en", n, brute.prose(rng, n) + rng.choice(["\n", "", "\n\n x"])) for i, n in enumerate(rng.choices(range(12), k=70))]
    rows += [(500, "lone", None, None, None), (501, "b", None, None, ""), (None, "a", "en", 1, "x\n"), (None, "a", "en", 1, "x\n"), (None, None, None, None, None), (7, "a", "en", 3, "again"), (7, "a", "en", 3, "again\n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("tree", "idx", "path", "leaf", "`root`", "id")])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.verify_documents(docs, hit, fanout).collect()
    want = manifest_rows(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0, fanout)
    assert brute.same_rows(got, want)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_manifest_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.verify_documents(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    one = [(1, None, None, None, None)]
    assert brute.same_rows(manifest.verify_documents(spark.createDataFrame(one, schema), F.lit(True)).collect(), manifest_rows(one, lambda r: True, 3))


def test_numbering_spreads_a_key_with_all_rows(spark):
    """Rows equal in everything are dealt over the ranges as well; places are a permutation."""
    rows = spark.range(4000).select(F.lit("k").alias("tree"), F.lit(None).cast("long").alias("id"))
    got = ordering.number_within(rows, "tree", ["id"])
    assert sorted(r.pos for r in got.select("pos").collect()) == list(range(4000))


def test_token_counts(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from targetloom.llm import token_counts
    from tests.llm.test_tokens_and_files import odd_texts

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 200)
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 40)  # pieces and a cache that starts anew
    own = token_counts.WholeTokens(path)
    letters = [chr(c) for c in range(0x20, 0x250)] + ["'s", "'ll", "'T", "\n", "  ", "<|endoftext|>", "ⅷ", "²", "中"]
    rng = random.Random(3)
    texts = odd_texts(4000, 11) + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(4000)] + ["x" * 5000, " " * 300, brute.prose(rng, 3000)]
    for text in texts:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    rows = brute.awkward(5)
    got = token_counts.count_tokens(brute.documents(spark, rows, clashing=True), path, limit=100).collect()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert brute.same_rows(got, [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, lengths)])
    assert token_counts.count_tokens(brute.documents(spark, []), path).count() == 0


def trie_rows(turns, family, heads):
    """Every prefix of every rebuilt conversation, in plain Python."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(convs.get(c - c % family, [])[:h] + own[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in built.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, inside in members.items():
        under = [u for u in members if u[: len(k)] == k]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in under if u)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(inside), len(k), min(members[k[:-1]]) if k else None, len(inside), children[k], sum(not children[u] for u in under), saved, hashed))
    return out


@pytest.mark.parametrize("block,piece", [(4096, 256), (3, 2)])
def test_prefix_trie(spark, monkeypatch, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(block)
    turns = []
    for c in range(120):
        if c == 100:
            continue  # a family without its first conversation
        for t in range(rng.choice([0, 1, 2, 3, 9])):
            turns.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b\U0001f600", "", None])))
    turns += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a large group of copies
    turns += [(300, t, None, f"long {t}") for t in range(40)] + [(301, t, None, f"long {t}") for t in range(33)]
    turns += [(400, None, "user", "first"), (400, 0, "bot", "tie"), (400, 0, "bot", "tie"), (400, 0, "user", None), (None, 1, "user", "nowhere"), (5, -1, "user", "é")]
    rng.shuffle(turns)
    table = spark.createDataFrame([(*t, 1, 2, "x", 3) for t in turns], "conv_id long, turn long, role string, text string, c long, d long, m string, pos long")
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    got = prefix_trie.conversation_trie(table, F.expr("c - c % 100"), head, 6).collect()
    assert brute.same_rows(got, trie_rows(turns, 100, 6))
    assert prefix_trie.conversation_trie(table.where("false"), F.expr("c - c % 100"), head, 6).count() == 0


def test_long_end_lists_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("c"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("long").alias("d"), F.lit(5).cast("long").alias("k1"), F.lit(6).cast("long").alias("k2"))
    rows = ends.collect()
    want = {d: hashlib.sha256(",".join(map(str, sorted(r.c for r in rows if r.d == d))).encode()).hexdigest() for d in (1, 2)}
    assert {r.d: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()} == want
