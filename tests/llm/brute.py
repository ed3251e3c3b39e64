"""Plain Python versions of the operators, and small tables that hold the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "norm string, sha string, salt int, row string, h long, th int, spans string, token long, n long, `class` long, keep boolean, score double, slots string, zones string"


def documents(spark, rows, clashing=False):
    """``rows`` are (doc_id, text); the other columns are filled in, with names that operators use inside if asked."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if not clashing:
        return spark.createDataFrame(full, DOCUMENTS)
    return spark.createDataFrame([(*r, *([None] * 14)) for r in full], f"{DOCUMENTS}, {CLASHES}")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "de", "épsilon", "zeta,", "eta.", "theta", "中文", "x"]) + str(rng.randint(0, 40)) for _ in range(n))


def awkward(seed=1, copies=6, near=24):
    """Null, empty, blank, short, very long texts; copies with other spaces; near copies; shared passages; repeated rows."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 150)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b c"), (6, prose(rng, 20_000))]
    for i in range(copies):
        rows.append((10 + i, base.replace(" ", rng.choice([" ", "  ", "\n", "\t "]), rng.randint(0, 3))))
    for i in range(near):
        words = base.split()
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(words)))
    for i in range(8):
        rows.append((200 + i, prose(rng, rng.randint(0, 60)) + " " + passage + "\n" + prose(rng, rng.randint(0, 60))))
    rows += [(300, rows[12][1]), (300, rows[12][1]), (None, prose(rng, 50)), (None, passage), (301, prose(rng, 30) + " " + passage + " " + passage)]
    rng.shuffle(rows)
    return rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()  # bytes know ASCII alone


def shingles(text, size):
    w = words(text, True)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_groups(rows, percent, size):
    """Group index of each row under the links."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(rows))], sets


def near_components(rows, percent=85, size=4):
    groups, sets = near_groups(rows, percent, size)
    low = collections.defaultdict(list)
    for g, (i, _) in zip(groups, rows):
        if i is not None:
            low[g].append(i)
    return [(i, len(s), (min(low[g]) if low[g] else None) if s else i) for g, s, (i, _) in zip(groups, sets, rows)]


def repeated(tokens_of, window):
    """Flags per token of each document: covered by a run of ``window`` tokens that starts anywhere else."""
    seen = collections.Counter(tuple(t[s : s + window]) for t in tokens_of for s in range(len(t) - window + 1))
    out = []
    for t in tokens_of:
        flags = [False] * len(t)
        for s in range(len(t) - window + 1):
            if seen[tuple(t[s : s + window])] > 1:
                flags[s : s + window] = [True] * window
        out.append(flags)
    return out


def cut_words(rows, window):
    tokens = [words(t) for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, tokens, repeated(tokens, window)):
        kept = b" ".join(w for w, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def cut_bytes(rows, window):
    tokens = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, gone in zip(rows, tokens, repeated(tokens, window)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same_rows(got, want):
    return collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))
