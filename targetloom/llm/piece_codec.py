"""Merge-type SentencePiece encoding by backtracking, and decoding; exact for BPE models with byte fallback.

The merge process is never run over a text.  An Aho-Corasick automaton gives the longest pieces; two neighbouring
pieces are compatible when re-merging their joined text gives them back, which is remembered per pair.  Where the
longest piece does not fit its left neighbour, shorter ones are tried, and a bitfield keeps the positions from which
no tiling goes on, so each is tried once.  Only pieces of the merge type take part; other characters are bytes.

No piece of these models continues over the start of a word mark, so texts are coded word by word through a bounded
cache (models with such pieces are coded as one word).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.registry import query, table

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
BREAK = "\x00"  # stands between words that are matched together
CACHE_WORDS = 1_200_000  # per Python worker, about 150 bytes each

_codecs: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of one model file; one per Python worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its pieces, scores and normaliser only
        self.normalise = model.normalize
        self.begin, self.end = model.bos_id(), model.eos_id()
        size = model.get_piece_size()
        self.surface = [model.id_to_piece(i) for i in range(size)]
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_of: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.surface):
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.merged: dict[str, bool] = {}
        self.pairs: dict[int, bool] = {}
        for piece, i in self.ids.items():
            automaton.add_word(piece, i)
        automaton.make_automaton()
        self.automaton = automaton
        self.lengths = [len(p) for p in self.surface]
        self.length = np.array(self.lengths, dtype=np.int64)
        self.shorter: dict[int, int] = {}
        self.by_words = BREAK not in "".join(self.ids) and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.words: dict[str, bytes] = {}
        self.texts = np.array([p.replace(MARK, " ") if p in self.ids else "" for p in self.surface], dtype=object)
        self.texts[model.unk_id()] = " \u2047 "
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self.marked = np.array([p.startswith(MARK) and p in self.ids for p in self.surface])
        self.low_byte, self.high_byte = (min(self.byte_of), max(self.byte_of)) if self.byte_of else (size, -1)

    # compatibility

    def remerge(self, text: str) -> list[str]:
        """The merge process on a short text: the best-scored neighbouring pair joins first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        """Whether the merge process can make the piece of its own characters."""
        known = self.merged.get(piece)
        if known is None:
            known = self.merged[piece] = self.remerge(piece) == [piece]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their joined text is merged anew."""
        code = left << 32 | right
        known = self.pairs.get(code)
        if known is None:
            a, b = self.surface[left], self.surface[right]
            known = self.reachable(a) and self.reachable(b) and self.remerge(a + b) == [a, b]
            self.pairs[code] = known
        return known

    # encoding

    def backtrack(self, text: str) -> list[int]:
        """Pieces of one stretch of known characters."""
        lengths, pairs, n = self.lengths, self.pairs, len(text)
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):
            start = end + 1 - lengths[i]
            if longest[start] < 0 or lengths[i] > lengths[longest[start]]:
                longest[start] = i
        failed = bytearray(n + 1)  # 1: no tiling goes on from here
        out: list[int] = []
        at, piece = 0, longest[0]
        while piece >= 0:
            last = out[-1] if out else -1
            while True:
                stop = at + lengths[piece]
                if not failed[stop]:
                    if last < 0:
                        fits = self.reachable(self.surface[piece])
                    else:
                        fits = pairs.get(last << 32 | piece)
                        if fits is None:
                            fits = self.compatible(last, piece)
                    if fits:
                        out.append(piece)
                        at, piece = stop, longest[stop]
                        break
                shorter = self.shorter.get(piece)
                if shorter is None:
                    shorter = self.shorter[piece] = self._shorter(self.surface[piece])
                if shorter >= 0:
                    piece = shorter
                    continue
                if last < 0:
                    raise ValueError(f"no tiling of {text!r}")
                failed[at] = 1
                out.pop()
                at, piece = at - lengths[last], last
                break
        return out

    def _shorter(self, piece: str) -> int:
        """The longest piece that is a proper prefix, or -1."""
        return next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)

    def encode_word(self, word: str) -> list[int]:
        """One word of any characters: unknown ones become bytes and part their neighbours."""
        out: list[int] = []
        known: list[str] = []
        for c in word:
            if c in self.ids:
                known.append(c)
                continue
            if known:
                out += self.backtrack("".join(known))
                known = []
            out += [self.byte_id[b] for b in c.encode()]
        if known:
            out += self.backtrack("".join(known))
        return out

    def learn(self, words: list[str]) -> None:
        """Encode unknown words: those whose longest pieces tile them compatibly at once, the others by backtracking."""
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            found = np.array([(e, p) for e, p in self.automaton.iter_long(BREAK.join(some))], dtype=np.int64).reshape(-1, 2)
            ends, pieces = found[:, 0] + 1, found[:, 1]
            sizes = np.array([len(w) for w in some])
            stops = np.cumsum(sizes + 1) - 1
            word = np.searchsorted(stops, ends)
            covered = np.bincount(word, weights=self.length[pieces], minlength=len(some)).astype(np.int64) == sizes
            inside = word[1:] == word[:-1]
            codes = (pieces[:-1] << 32 | pieces[1:])[inside]
            distinct, which = np.unique(codes, return_inverse=True)
            fits = np.array([self.compatible(c >> 32, c & 0xFFFFFFFF) for c in distinct.tolist()], dtype=bool)
            covered[word[1:][inside][~fits[which]]] = False
            firsts = np.searchsorted(word, np.arange(len(some) + 1))
            raw = pieces.astype("<u4").tobytes()
            for j, (w, good) in enumerate(zip(some, covered.tolist())):
                a, b = int(firsts[j]), int(firsts[j + 1])
                if good and (b - a > 1 or self.reachable(w)):
                    self.words[w] = raw[4 * a : 4 * b]
                else:
                    self.words[w] = np.array(self.encode_word(w), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end id, as little-endian unsigned 32-bit bytes; null counts as the empty text."""
        words = self.split(text or "")
        known = self.words
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > CACHE_WORDS:
                known.clear()
                ids = [None] * len(ids)
            missing = [i for i, x in enumerate(ids) if x is None]
            self.learn(list(dict.fromkeys([words[i] for i in missing])))
            for i in missing:
                ids[i] = known[words[i]]
        body = b"".join(ids)
        return np.array([self.begin], "<u4").tobytes() + body + np.array([self.end], "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        normal = self.normalise(text)
        if not normal:
            return []
        if not self.by_words:
            return [normal]
        if normal[0] == MARK and MARK + MARK not in normal:
            return [MARK + w for w in normal[1:].split(MARK)]
        return WORDS.findall(normal)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: word marks are spaces, the first is dropped; control ids are nothing; bytes join to characters."""
        parts = self.texts[ids].tolist()
        odd = np.flatnonzero((ids >= self.low_byte) & (ids <= self.high_byte))
        if len(odd):
            for run in np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1):
                first, *rest = run.tolist()
                parts[first] = _characters(bytes(self.byte_of[i] for i in ids[run].tolist()))
                for i in rest:
                    parts[i] = ""
        out = "".join(parts)
        heard = np.flatnonzero(~self.silent[ids[:64]]) if len(ids) else ids
        return out[1:] if len(heard) and self.marked[ids[heard[0]]] else out


def _characters(raw: bytes) -> str:
    """UTF-8 text of a run of byte ids; each byte outside a valid character becomes the replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row: ids with begin and end id, and the text that they decode to.

    Null and the empty text have the two ids alone and decode to the empty text.  Identifiers pass through, null and
    repeated ones too; an empty table gives no rows; other columns are not read.
    """
    return _each(docs, model, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: (np.frombuffer(ids, "<u4"), text))


def _each(docs: DataFrame, model: str, id_col: str, text_col: str, schema: str, values) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = codec(model)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = pieces.encode(text)
                rows.append((doc_id, *values(ids, pieces.decode(np.frombuffer(ids, "<u4")))))
                if len(rows) == 2000:
                    yield pd.DataFrame(rows, columns=["doc_id", *names])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    coded = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id string, {schema}")
    return coded.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


@query("op9_piece_codec")
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    def digests(ids: bytes, text: str) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _each(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "text",
        "n_tokens long, ids_sha256 string, decoded_sha256 string", digests,
    )
