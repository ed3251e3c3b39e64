"""Token counts without token ids: pre-tokens that are whole vocabulary entries count one, only the rest is merged.

``WholeTokens`` proves before any text is read which vocabulary strings the merges turn back into one token; all
others (an entry whose own merges end in several tokens) are left out.  A text is cut where white space follows other
characters, which no pre-token crosses.  Cuts seen before are counted from a table; a new cut is split by the
library's pre-tokeniser, its pre-tokens are looked up among the proven strings and merged where they are none.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.registry import query, table

LIMIT = 512
SPACE = r"[^\S\x1c-\x1f]"  # the library's white space; Python's \s has four characters more
OTHER = r"[\S\x1c-\x1f]"
CUTS = re.compile(f"{SPACE}*{OTHER}+|{SPACE}+")
EDGE = re.compile(f"(?<={OTHER})(?={SPACE})")
# The vocabulary's published pre-token pattern, its letters and digits spelled out for the range below
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ɏ]*")
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PIECE_CHARS = 1 << 20  # a longer text is counted piece by piece, cut at an edge
CACHE_CHARS = 24 << 20  # characters held as known cuts per Python worker; beyond it the table starts anew
LONG_CUT = 256  # longer cuts are counted each time, so one cannot fill the table


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
_counters: dict[str, WholeTokens] = {}


class WholeTokens:
    """Counts tokens as the ``tokenizers`` library's file at ``path`` (byte-level BPE) gives them."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.split, self.merge = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        self.special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
        # strings in the byte alphabet of the file; an entry proves itself by merging back into one token
        self.whole = {s for s in library.get_vocab(with_added_tokens=False) if len(self.merge(s)) == 1}
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and the empty text have none.  Special strings count one, as by default."""
        if not text:
            return 0
        parts = [text]
        n = 0
        for special in self.special:
            if special in text:
                split = [p.split(special) for p in parts]
                n += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        return n + sum(self._plain(piece) for part in parts for piece in _pieces(part))

    def _plain(self, text: str) -> int:
        cuts = CUTS.findall(text)
        counts = list(map(self.known.get, cuts))
        if None in counts:
            fresh = {}
            for cut, n in zip(cuts, counts):
                if n is None and cut not in fresh:
                    fresh[cut] = self._new(cut)
            counts = [fresh[c] if n is None else n for c, n in zip(cuts, counts)]
            kept = {c: n for c, n in fresh.items() if len(c) <= LONG_CUT}
            self.held += sum(map(len, kept))
            if self.held > CACHE_CHARS:
                self.known, self.held = {}, sum(map(len, kept))
            self.known.update(kept)
        return sum(counts)

    def _new(self, cut: str) -> int:
        if PLAIN.fullmatch(cut):
            pieces = [p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in PRE_TOKENS.findall(cut)]
        else:
            pieces = [p for p, _ in self.split(cut)]
        whole, merge = self.whole, self.merge
        return sum(1 if p in whole else len(merge(p)) for p in pieces)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE_CHARS:
        edge = EDGE.search(text, start + PIECE_CHARS)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


def counter(path: str) -> WholeTokens:
    if path not in _counters:
        _counters[path] = WholeTokens(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_tokens, over_limit).

    Each text is counted where it is read; nothing is shuffled.  Null counts as the empty text: no bytes, no tokens.
    Repeated and null identifiers are rows of their own; an empty table gives no rows; other columns are not read,
    whatever their names.  A text of any length is counted whole, in pieces of about ``PIECE_CHARS`` characters (one
    run of characters without white space is never cut).
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts.tolist()], dtype="int64")

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
