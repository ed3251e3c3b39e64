"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation estimates how
often each of them is right from the counts of vote patterns over the whole corpus (a few hundred numbers, whatever its
size).  The posterior labels then train a hashed linear scorer over byte trigrams and binned text statistics, fitted on
a bounded sample of ``sample_docs`` documents drawn by hash; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from targetloom.llm.registry import query, table
from targetloom.llm.wordgrid import SPACE, Words, chunks, mix, words_of
from targetloom.session import cut_lineage

SAMPLE_DOCS = 5_000
SLOT_BITS = 14
PIECE_VALUES = 1 << 16
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "variety", "repeats", "letterless", "word_length", "marked")
_KIND = np.zeros((4, 256), dtype=bool)  # letters, small and capital; symbols: other than letters, digits, sentence marks and space
_KIND[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND[1, 65:91] = True
_KIND[2] = ~_KIND[0] & ~SPACE
_KIND[2, [*range(48, 58), *b".,;:'\"?!-()"]] = False
_EDGES = np.array([0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])


def statistics(words: Words) -> dict[str, np.ndarray]:
    """Per text: shares of symbols, capitals, distinct words, adjacent repeats, words without a letter
    and words with a symbol; mean length."""
    n = np.diff(words.first)
    some = np.maximum(n, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), words.text_start[:-1])

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[words.first[1:]] - total[words.first[:-1]]) / some

    letters = _KIND[0][words.raw]
    written = per_text(~SPACE[words.raw])
    hashes, text = words.hashes(0), words.text
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    so_far = np.concatenate(([0], np.cumsum(letters)))
    odd = np.concatenate(([0], np.cumsum(_KIND[2][words.raw])))
    return {
        "words": n, "letters": per_text(letters),
        "symbols": per_text(_KIND[2][words.raw]) / np.maximum(written, 1),
        "capitals": per_text(_KIND[1][words.raw]) / np.maximum(per_text(letters), 1),
        "variety": per_word(fresh), "repeats": per_word(again),
        "letterless": per_word(so_far[words.stop] == so_far[words.start]),
        "word_length": written / some,
        "marked": per_word(odd[words.stop] > odd[words.start]),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, one column per labeller: 1 good, -1 bad, 0 no vote."""
    n, letters = s["words"], s["letters"]

    def vote(bad: np.ndarray, good: np.ndarray, on: np.ndarray) -> np.ndarray:
        return np.where(on, np.where(bad, -1, np.where(good, 1, 0)), 0)

    length = s["word_length"]
    return np.stack([
        vote(s["symbols"] > 0.04, s["symbols"] < 0.02, letters >= 20),
        vote(s["capitals"] > 0.3, s["capitals"] < 0.1, letters >= 20),
        vote(s["variety"] < 0.4, s["variety"] > 0.5, n >= 40),
        vote(s["repeats"] > 0.1, s["repeats"] < 0.05, n >= 10),
        vote(s["letterless"] > 0.15, s["letterless"] < 0.05, n >= 10),
        vote((length < 4.2) | (length > 9), (length > 4.6) & (length < 7), n >= 10),
        vote(s["marked"] > 0.2, s["marked"] < 0.1, n >= 10),
    ], axis=1).astype(np.int8)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, tolerance: float = 1e-9, rounds: int = 10_000) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for labellers that err independently given the class: (share of good, vote probabilities, posteriors).

    ``patterns`` is patterns x labellers in {-1, 0, 1}, ``counts`` their documents; probabilities are class x labeller x
    vote.  A labeller that does not vote says nothing about the class.  Starts from documents without and with a bad
    vote, so that class 1 stays the good one; raises if it does not settle.
    """
    seen = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    before = -np.inf
    for _ in range(rounds):
        rate, tables = [], []
        for p in (1 - good, good):
            w = p * counts
            rate.append(w.sum())
            voted = np.einsum("p,plv->lv", w, seen) + 0.01
            tables.append(voted / voted.sum(axis=1, keepdims=True))
        share = rate[1] / (rate[0] + rate[1])
        log = [np.log(s) + np.einsum("plv,lv->p", seen, np.log(t)) for s, t in ((max(1 - share, 1e-12), tables[0]), (max(share, 1e-12), tables[1]))]
        total = np.logaddexp(*log)
        good = np.exp(log[1] - total)
        now = float((counts * total).sum() / counts.sum())
        if now - before < tolerance:
            return share, np.stack(tables), good
        before = now
    raise RuntimeError("expectation-maximisation has not settled")


def features(words: Words, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features: (text of each trigram, its slot; texts x statistics slots)."""
    raw = words.raw.astype(np.uint64)
    code = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    slot = (mix(code) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(words.text_start) - 1), np.diff(words.text_start))[: len(slot)]
    inside = np.arange(len(slot)) + 2 < words.text_start[1:][text]
    bins = np.stack([np.searchsorted(_EDGES, s[k] if k != "word_length" else s[k] / 12.0) for k in LABELLERS], axis=1)
    binned = np.stack([(mix((np.uint64(1 << 40) + np.uint64(64 * k) + bins[:, k].astype(np.uint64))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in range(len(LABELLERS))], axis=1)
    return text[inside], slot[inside], binned


def train_scorer(rows: Iterable[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """Logistic weights (one per slot, the last is the bias) from (slots, values, probability of good).

    The rows are read once into pieces of about ``PIECE_VALUES`` values; a round makes arrays of a piece's length, never of all rows'.
    """
    pieces, good, waiting, held = [], [], [], 0

    def close() -> None:
        doc = np.repeat(np.arange(len(waiting), dtype=np.int32), [len(r[0]) for r in waiting])
        pieces.append((len(waiting), doc, np.concatenate([r[0] for r in waiting]), np.concatenate([r[1] for r in waiting])))
        waiting.clear()

    for slot, value, p in rows:
        waiting.append((slot, value))
        good.append(p)
        held += len(slot)
        if held >= PIECE_VALUES:
            close()
            held = 0
    if waiting:
        close()
    y = np.array(good)
    weights, seen = np.zeros((1 << SLOT_BITS) + 1), np.full((1 << SLOT_BITS) + 1, 1e-8)
    bad = max(1e-9, float((1 - y).sum()))
    balance = np.where(y > 0.5, 1.0, max(1.0, float(y.sum()) / bad)) if len(y) else y  # the rarer class counts as much
    for _ in range(rounds if len(y) else 0):
        margin = np.concatenate([np.bincount(doc, weights[slot] * value, minlength=n) for n, doc, slot, value in pieces]) + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / balance.sum()
        slope, first = np.zeros((1 << SLOT_BITS) + 1), 0
        for n, doc, slot, value in pieces:
            slope[:-1] += np.bincount(slot, error[first + doc] * value, minlength=1 << SLOT_BITS)
            first += n
        slope[-1] = error.sum()
        slope[:-1] += penalty * weights[:-1]
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
    return weights


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``posterior`` (weak labels alone), ``score`` (linear scorer) and ``keep`` (score >= threshold).

    Null, empty and blank texts have score 0 and are not kept.  Every row is scored by itself, so repeated rows and ties
    score alike; identifiers may be null; an empty table gives no rows.  Columns of ``docs`` named as the three new ones
    are replaced.
    """
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    cut = int(share * (1 << 32))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sampled = batch["sampled"].to_numpy()
            for first, texts in chunks(batch["text"].tolist()):
                words = words_of(texts)
                s = statistics(words)
                v = votes(s)
                kept = sampled[first : first + len(texts)] & (s["words"] > 0)
                slots, values = [None] * len(texts), [None] * len(texts)
                for i in np.flatnonzero(kept).tolist():
                    one = words_of([texts[i]])
                    _, slot, binned = features(one, statistics(one))
                    distinct, count = np.unique(slot, return_counts=True)
                    slots[i] = np.concatenate([distinct, binned[0]]).astype("<i4").tobytes()
                    values[i] = (np.concatenate([count / max(1, count.sum()), np.full(len(LABELLERS), 0.1)]) * 10).astype("<f4").tobytes()
                yield pd.DataFrame({"pattern": ["".join("-0+"[x + 1] for x in row) for row in v.tolist()], "slots": slots, "vals": values})

    key = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(1 << 32)) < cut
    looked = docs.select(F.col(text_col).alias("text"), F.coalesce(key, F.lit(False)).alias("sampled"))
    seen = cut_lineage(looked.mapInPandas(look, "pattern string, slots binary, vals binary"))
    counted = seen.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    posterior: dict[str, float] = {}
    if counted:
        patterns = np.array([["-0+".index(c) - 1 for c in row["pattern"]] for row in counted])
        _, _, good = fit_accuracies(patterns, np.array([row["count"] for row in counted], dtype=float))
        posterior = {row["pattern"]: float(p) for row, p in zip(counted, good)}
    # repeated identifiers could make the hash sample larger than its share: the bound holds all the same
    sample = seen.where("slots is not null").limit(2 * sample_docs).toLocalIterator()
    weights = train_scorer((np.frombuffer(r.slots, "<i4"), np.frombuffer(r.vals, "<f4"), posterior[r.pattern]) for r in sample)
    learned = docs.sparkSession.sparkContext.broadcast((weights, posterior))  # 2 ** SLOT_BITS + 3 ** labellers numbers

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, table_of = learned.value
        for batch in batches:
            out = []
            for _, texts in chunks(batch.tolist()):
                words = words_of(texts)
                s = statistics(words)
                text, slot, binned = features(words, s)
                n = np.bincount(text, minlength=len(texts))
                margin = 10 * np.bincount(text, w[slot], minlength=len(texts)) / np.maximum(n, 1) + w[binned].sum(axis=1) + w[-1]
                p = np.where(s["words"] > 0, 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 0.0)
                known = [table_of["".join("-0+"[x + 1] for x in row)] for row in votes(s).tolist()]
                out.append(pd.DataFrame({"posterior": known, "score": p}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"posterior": [], "score": []})

    scored = F.pandas_udf(score, "posterior double, score double")
    taken = {"posterior", "score", "keep", "_scored"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    out = docs.select(*rest, scored(F.col(text_col)).alias("_scored"))
    return out.select(*[c for c in out.columns if c != "_scored"], "_scored.posterior", "_scored.score", (F.col("_scored.score") >= threshold).alias("keep"))


@query("op1_weak_labels")
def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).select("doc_id", "posterior", "score", "keep")
