"""Byte-level BPE ids of whole texts with the ``tokenizers`` library, word by word through a bounded cache.

The library's pre-tokeniser never joins a character that is no white space with white space after it.  Cutting a text
at every such place and encoding the cuts therefore gives the ids of the whole text, and most cuts are known words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

WHITE = r"[^\S\x1c-\x1f]"  # what the library calls white space; Python's \s has four characters more
ODD = re.compile(rf" {WHITE}|{WHITE} ")
RARE = re.compile(r"[^\S\x00-\x20]|[\x0b\x0c]")
NEAR = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
CUTS = re.compile(rf"{WHITE}*(?:(?!{WHITE}).)+|{WHITE}+", re.S)
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # neither letters nor digits; no apostrophe and nothing that added tokens hold
GROUP_CHARS = 1 << 18
CACHE_WORDS = 1_200_000  # per Python worker; a cache is dropped and refilled beyond this and one group's words

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes; one per vocabulary file and Python worker."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}  # cuts of one space and a word, by the word
        self.lines: dict[str, bytes] = {}  # words after a line break, with the break
        self.cuts: dict[str, bytes] = {}  # all other cuts
        alphabet = _byte_alphabet()
        size = self.library.get_vocab_size()
        self.width = np.zeros(size, dtype=np.int64)  # bytes of text behind each id
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.width[i] = sum(1 for c in token if c in alphabet)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())

    def ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without character offsets

    def learn(self, known: dict[str, bytes], cuts: list[str], lead: str) -> None:
        """Encode unknown cuts that start with white space (``lead`` or their own) and end without it, many in one text."""
        for i in range(0, len(cuts), 5000):
            some = cuts[i : i + 5000]
            ids = np.asarray(self.ids(lead + lead.join(some)), dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(lead) + len(c.encode()) for c in some])) + 1
            raw, start = ids.tobytes(), 0
            for cut, end in zip(some, ends.tolist()):
                known[cut] = raw[4 * start : 4 * end]
                start = end

    def _learn_words(self, cuts: list[str]) -> None:
        """Encode unknown cuts of one space and a word; ``word``, ``word.`` and ``word.`` + line break + ``other.`` share their words.

        The pre-tokeniser parts letters from marks and from a single line break, so the ids of the parts follow each other.
        """
        whole, split = [], []
        for cut in cuts:
            stem = cut.rstrip(MARKS)
            if "\n" in stem:
                first, _, line = stem.partition("\n")
                word = first.rstrip(MARKS)
                if _letters(word) and _letters(line):
                    split.append((cut, word, first[len(word) :], line, cut[len(stem) :]))
                    continue
            elif len(stem) < len(cut) and _letters(stem):
                split.append((cut, stem, cut[len(stem) :], "", ""))
                continue
            whole.append(cut)
        words = dict.fromkeys([*whole, *[s[1] for s in split]])
        self.learn(self.words, [w for w in words if w not in self.words], " ")
        self.learn(self.lines, [w for w in dict.fromkeys([s[3] for s in split]) if w and w not in self.lines], "\n")
        for cut, word, marks, line, end in split:
            self.words[cut] = self.words[word] + self._single(marks) + (self.lines[line] + self._single(end) if line else b"")

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; null and the empty text have none.

        Texts are taken in groups of about ``GROUP_CHARS`` characters, whose unknown cuts go to the library together.
        """
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text or "")
            if held >= GROUP_CHARS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[bytes]:
        for known in (self.words, self.lines, self.cuts):
            if len(known) > CACHE_WORDS:
                known.clear()
        parts, fresh = [], ({}, {})
        for text in texts:
            if not text:
                parts.append(None)
                continue
            odd = _has_odd_space(text)
            if odd:
                known = self.cuts
                head, *middle = CUTS.findall(text)
                tail = middle.pop() if middle else ""
            else:
                known = self.words
                head, *middle = text.split(" ")
                tail = " " + middle.pop() if middle else ""
            ids = list(map(known.get, middle))
            missing = [i for i, x in enumerate(ids) if x is None]
            cuts = [middle[i] for i in missing]
            fresh[odd].update(dict.fromkeys(cuts))
            parts.append((head, tail, ids, missing, cuts, known))
        self._learn_words(list(fresh[False]))
        self.learn(self.cuts, list(fresh[True]), "")
        for part in parts:  # all of them before the first is handed out: what follows may empty the caches
            if part:
                _, _, ids, missing, cuts, known = part
                for i, cut in zip(missing, cuts):
                    ids[i] = known[cut]
        for part in parts:
            yield self._single(part[0]) + b"".join(part[2]) + self._single(part[1]) if part else b""

    def _single(self, cut: str) -> bytes:
        """The first and the last cut of a text may lack white space before or end in it: they are encoded alone."""
        if not cut:
            return b""
        got = self.cuts.get(cut)
        if got is None:
            if len(self.cuts) > CACHE_WORDS:
                self.cuts.clear()
            got = self.cuts[cut] = np.asarray(self.ids(cut), dtype="<u4").tobytes()
        return got


def _letters(word: str) -> bool:
    """Letters alone, of scripts where Python and the library agree on what is one."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def _has_odd_space(text: str) -> bool:
    """Whether a space stands next to other white space; ASCII texts need no pattern for it."""
    if any(pair in text for pair in NEAR):
        return True
    rare = "\x0b" in text or "\x0c" in text if text.isascii() else RARE.search(text)
    return bool(rare and ODD.search(text))


def _byte_alphabet() -> set[str]:
    """The printable stand-ins of byte-level vocabularies, one character per byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = 256 - len(shown)
    return {chr(b) for b in shown} | {chr(256 + i) for i in range(rest)}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
