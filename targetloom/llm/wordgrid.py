"""Whole batches of texts as numpy arrays: bytes, words and rolling hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 512 << 10  # texts are worked on together up to this size; a longer text is a chunk by itself
_SEEDS = np.random.default_rng(20240607)
_BYTE_VALUES = _SEEDS.integers(1, 1 << 63, size=(2, 256), dtype=np.int64).astype(np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if lane not in _powers or len(_powers[lane][0]) < size:
        size = max(size, CHUNK_BYTES + 4096)
        out = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[lane] = (out[0], out[1])
    up, down = _powers[lane]
    return up[:size], down[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits may be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, lane: int) -> np.ndarray:
    """Prefix sums whose differences, see ``span_hash``, hash every run of ``values`` (uint64)."""
    up, _ = _power_tables(lane, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, lane: int) -> np.ndarray:
    """Hash of the values in [start, stop); equal runs have equal hashes wherever they stand."""
    _, down = _power_tables(lane, len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


@dataclass
class Words:
    """Words of several texts one after the other; text ``i`` has the words first[i] to first[i + 1]."""

    raw: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lane: int) -> np.ndarray:
        return span_hash(prefix_hash(_BYTE_VALUES[lane][self.raw], lane), self.start, self.stop, lane)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.stop[i]].tobytes()


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) in runs of about ``limit`` bytes; null is the empty text."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def byte_grid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one space after each text, and where each text starts (and the end of the last)."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), starts


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Runs of bytes other than space and 0x09 to 0x0D; ``lower`` makes A to Z small."""
    raw, text_start = byte_grid(texts)
    if lower:
        raw = LOWER[raw]
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]  # the last byte is a space, so every word ends
    return Words(raw, text_start, start, stop, np.searchsorted(start, text_start))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the signed integers that Spark has."""
    return x.view(np.int64)
