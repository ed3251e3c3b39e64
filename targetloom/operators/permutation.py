"""Random permutations of row places as arithmetic: no row is sorted or numbered to be shuffled.

A keyed bijection on [0, n) - a Feistel network over an a x b grid that holds n or a few more places, walked on while it
stands on one of those - gives each place its new place from the place and the key alone, on any task and any retry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from targetloom.operators.prefix import running_sums
from targetloom.session import cut_lineage

ROUNDS = 16  # even, so that the halves end in their places
PRIME = 2_147_483_647
STEP_1, STEP_2 = 48_271, 69_621


def grid(n: int) -> tuple[int, int, int]:
    """(a, b, spare): the nearly square grid with the fewest places beyond ``n``, the squarest of equal ones."""
    n = max(1, n)
    high = max(1, math.isqrt(n))
    a = min(range(max(1, (3 * high + 3) // 4), high + 1), key=lambda x: (-n % x, -x))
    b = -(-n // a)
    return a, b, a * b - n


def round_keys(*parts: Column | str | int) -> Column:
    """One key per round from an md5 of the parts."""
    text = [F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts]

    def key(i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", *[t.cast("string") for t in text], i.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % PRIME

    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), key)


def _mix(value: Column, key: Column) -> Column:
    """A well-spread number below 2^31; products stay below 2^48."""
    x = ((value + key) % PRIME) * STEP_1 % PRIME
    y = x.bitwiseXOR(F.shiftright(x, 15)) * STEP_2 % PRIME
    return y.bitwiseXOR(F.shiftright(y, 11))


def shuffled_place(place: Column, n: int, keys: Column) -> Column:
    """Image of ``place`` (0 to n - 1) under the permutation that ``keys`` name; a bijection on [0, n) for any keys.

    A walk meets each spare place of the grid at most once, so ``spare`` further steps always end inside [0, n).
    """
    a, b, spare = grid(n)

    def step(at: Column) -> Column:
        start = F.struct(((at - at % b) / b).cast("long").alias("x"), F.lit(a).cast("long").alias("mx"), (at % b).alias("y"), F.lit(b).cast("long").alias("my"))

        def turn(s: Column, key: Column) -> Column:
            moved = (s.x + _mix(s.y, key)) % s.mx
            return F.struct(s.y.alias("x"), s.my.alias("mx"), moved.alias("y"), s.mx.alias("my"))

        return F.aggregate(keys, start, turn, lambda s: s.x * b + s.y)

    out = step(place.cast("long"))
    if spare:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(spare)), out, lambda at, _i: F.when(at < n, at).otherwise(step(at)))
    return out


def round_key_numbers(*parts: str | int) -> list[int]:
    """``round_keys`` of constants as numbers."""
    return [int(hashlib.md5("|".join(map(str, (*parts, i))).encode()).hexdigest()[:8], 16) % PRIME for i in range(ROUNDS)]


def shuffled_places(place: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """``shuffled_place`` of an array, for tasks that work on batches of places."""
    a, b, spare = grid(n)

    def step(at: np.ndarray) -> np.ndarray:
        x, mx, y, my = at // b, a, at % b, b
        for key in keys:
            u = (y + key) % PRIME * STEP_1 % PRIME
            v = (u ^ (u >> 15)) * STEP_2 % PRIME
            x, mx, y, my = y, my, (x + (v ^ (v >> 11))) % mx, mx
        return x * b + y

    out = step(place.astype(np.int64))
    for _ in range(spare):
        outside = out >= n
        if not outside.any():
            break
        out[outside] = step(out[outside])
    return out


def numbered(rows: DataFrame, order: Sequence[str], out: str = "_place") -> DataFrame:
    """Rows with their place from 0 in the order of their unique key; numbered range by range."""
    keyed = rows.withColumn("_key", F.struct(*order)).withColumn("_one", F.lit(1).cast("long"))
    return cut_lineage(running_sums(keyed, "_key", ["_one"]).withColumn(out, F.col("cum__one") - 1).drop("_key", "_one", "cum__one"))


# the same permutation in the check texts
KEYS_SQL = f"list_transform(range({ROUNDS}), lambda i: CAST(concat('0x', substr(md5(concat_ws('|', {{parts}}, CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) % {PRIME})"
GRID_SQL = """(SELECT n, a, (n + a - 1) // a AS b, ((n + a - 1) // a) * a - n AS spare FROM (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS h FROM {base}) c
    CROSS JOIN LATERAL (SELECT range AS a FROM range((3 * h + 3) // 4, h + 1) ORDER BY (range - n % range) % range, range DESC LIMIT 1) g)"""
_X = f"(((s.y + k) % {PRIME}) * {STEP_1} % {PRIME})"
_Y = f"(xor({_X}, {_X} >> 15) * {STEP_2} % {PRIME})"
_STEP = f"""list_transform([list_reduce(ks, lambda s, k: {{{{'x': s.y, 'mx': s.my, 'y': (s.x + xor({_Y}, {_Y} >> 11)) % s.mx, 'my': s.mx}}}},
    {{{{'x': CAST({{at}} // b AS BIGINT), 'mx': CAST(a AS BIGINT), 'y': CAST({{at}} % b AS BIGINT), 'my': CAST(b AS BIGINT)}}}})], lambda q: q.x * b + q.y)[1]"""
PLACE_SQL = f"list_reduce(range(1, spare + 1), lambda w, i: CASE WHEN w < n THEN w ELSE {_STEP.format(at='w')} END, {_STEP.format(at='place')})"
