"""Tokens, packing, token files and archives: exact round trips and comparisons with the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from targetloom.llm import byte_pairs, packing, piece_codec, token_files, web_archive  # noqa: E402
from tests.llm import brute  # noqa: E402

BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "    ", "\n", "\t", "a", "the", "é", "中", "😀", "'s", "12", "!", "***", "\x1c", "\x85", "　", "▁", "<s>", "<0x41>", "ing", "tion", "\x00", "<|endoftext|>", "\r\n", "ऀ"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_PAIRS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_byte_pairs_equal_library(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE_WORDS", 50)  # the cache is dropped again and again
    texts = odd_texts(4000, 1) + [None, brute.prose(random.Random(2), 5000)]
    for text, raw in zip(texts, byte_pairs.Encoder(BYTE_PAIRS).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, text), text


def test_pieces_equal_library(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 50)
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES)
    rng = random.Random(3)
    syllables = ["th", "he", "an", "er", "in", "re", "ti", "ou", "s", "t", "ble", "ing", " ", "Tion", "xq", "."]
    texts = odd_texts(4000, 4) + ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == [1, *model.encode(text), 2], text
        assert own.decode(ids) == model.decode(ids.tolist()), text
    for _ in range(1000):  # any ids decode as the library does, broken characters too
        ids = [rng.choice([rng.randint(0, 258), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(np.array(ids, dtype=np.int64)) == model.decode(ids), ids


def test_piece_round_trip_rows(spark):
    rows = [(1, None), (1, ""), (None, "the cat"), (2, "中 <0x41>")]
    got = piece_codec.piece_round_trip(brute.documents(spark, rows, clashing=True), PIECES).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert [r.ids for r in got if r.decoded == ""] == [[1, 2]] * 2
    assert piece_codec.piece_round_trip(brute.documents(spark, []), PIECES).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(5)
    for trial in range(200):
        ids = rng.integers(0, [1, 2, 50_257, 2**32][trial % 4], size=int(rng.integers(1, 300))).astype("<u4")
        if trial % 3 == 0:
            ids[int(rng.integers(len(ids)))] = 2**32 - 1  # an outlier goes to the exception list
        for percentile in (0.0, 50.0, 90.0, 100.0):
            assert (token_files.decode_block(token_files.encode_block(ids, percentile)) == ids).all()


def test_token_files(spark, library, tmp_path, monkeypatch):
    rows = brute.awkward(6)
    docs = brute.documents(spark, rows, clashing=True)
    shards = token_files.write_token_files(docs, str(tmp_path), BYTE_PAIRS)
    got = token_files.read_token_files(shards, str(tmp_path), ("ids array<int>", lambda ids: (ids.astype(int).tolist(),))).collect()
    assert brute.same_rows([(r.doc_id, tuple(r.ids)) for r in got], [(i, (*ids_of(library, t), 0)) for i, t in rows])
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [len(r.ids) for r in ordered])[:-1].tolist()
    names = [r.doc_id for r in ordered]
    assert names == sorted(names, key=lambda i: (i is not None, i))
    empty = token_files.write_token_files(brute.documents(spark, []), str(tmp_path / "none"), BYTE_PAIRS)
    assert token_files.read_token_files(empty, str(tmp_path / "none"), ("n long", lambda ids: (len(ids),))).count() == 0


@pytest.mark.parametrize("length,group", [(2048, 4096), (16, 10)])
def test_packing(spark, library, length, group):
    rows = brute.awkward(7)
    got = packing.pack_documents(brute.documents(spark, rows, clashing=True), BYTE_PAIRS, length=length, group_docs=group).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*ids_of(library, t), 1], dtype="<u4")
        for start in range(0, len(ids), length):
            piece = (i, start, min(length, len(ids) - start), zlib.crc32(ids[start : start + length].tobytes()), len(ids))
            want[piece] = want.get(piece, 0) + 1
    have = {}
    for r in got:
        piece = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        have[piece] = have.get(piece, 0) + 1
    assert have == want
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= length
    assert packing.pack_documents(brute.documents(spark, []), BYTE_PAIRS).count() == 0


def test_first_fit_decreasing_is_plain_first_fit():
    rng = np.random.default_rng(8)
    for _ in range(50):
        sizes = rng.integers(1, 101, size=int(rng.integers(0, 80)))
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if at == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (at, 100 - free[at])
            free[at] -= int(sizes[i])


PAGES = "page_id long, url string, html string, `key` string, path string"


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("range_bytes", [8 << 20, 300])
def test_archives(spark, tmp_path, packed, range_bytes):
    fake = web_archive.record("response", 77, "http://fake", "2024-01-01T00:00:00Z", b"not a record").decode()
    rows = [(3, "http://a", "x" * 700), (1, "http://b c\n", "x" * 700), (2, None, None), (5, "u", ""), (9, "u", fake * 3), (4, "v", "x" * 700), (4, "v", "x" * 700),
            (None, "n", "é" * 90), (8, "n", "é" * 90), (11, "w", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (12, "z", "é\r\n\r\nWARC/1.0\r\n" * 40)]
    pages = spark.createDataFrame([(*r, "k", "p") for r in rows], PAGES)
    archives = web_archive.write_archives(pages, str(tmp_path), packed=packed)
    got = web_archive.read_archives(archives, str(tmp_path), range_bytes=range_bytes).collect()
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        first[raw] = min((x for x in (first.get(raw), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first[raw] != i
        want.append((i, "revisit" if again else "response", first[raw] if again else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if again else raw))
    assert brute.same_rows([(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got], want)
    none = web_archive.write_archives(pages.where("false"), str(tmp_path / "none"), packed=packed)
    assert web_archive.read_archives(none, str(tmp_path / "none")).count() == 0


def test_whole_member_inside_a_payload_is_no_record(spark, tmp_path):
    """A stored (not compressed) payload holds a complete gzip member of a record: only the chain tells them apart."""
    inner = web_archive.member(web_archive.record("response", 77, None, "2024-01-01T00:00:00Z", b"inner"))
    outer = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = outer.compress(web_archive.record("response", 1, None, "2024-01-01T00:00:00Z", b"<p>" + inner + b"</p>")) + outer.flush()
    raw += web_archive.member(web_archive.record("response", 2, None, "2024-01-01T00:00:00Z", b"next"))
    assert inner in raw
    (tmp_path / "a.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([("a.warc.gz", len(raw))], "path string, bytes long")
    for size in (1 << 20, 100, 64):
        got = web_archive.read_archives(archives, str(tmp_path), range_bytes=size).collect()
        assert sorted(r.page_id for r in got) == [1, 2]


def test_damaged_archive_gives_what_precedes(spark, tmp_path):
    good = [web_archive.member(web_archive.record("response", i, None, "2024-01-01T00:00:00Z", b"page" * i)) for i in range(4)]
    raw = good[0] + good[1] + good[2][:-9] + b"\0" * 9 + good[3]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = web_archive.read_archives(spark.createDataFrame([("a.warc.gz", len(raw))], "path string, bytes long"), str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [0, 1]
