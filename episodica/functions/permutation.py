"""Keyed permutations of 0..n-1 as column expressions: the row at any place of a shuffled pass is computed, and so is the place of any row."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime below 2**31 and multipliers of good spread modulo it (Lehmer generators); products stay below 2**62.
PRIME, FIRST, SECOND = 2_147_483_647, 48_271, 69_621
ROUNDS, WALK = 6, 64


def round_keys(seed: int) -> list[int]:
    """A key for each round, from the seed by a Lehmer generator."""
    out, x = [], seed % (PRIME - 1) + 1
    for _ in range(2 * ROUNDS):
        x = x * FIRST % PRIME
        out.append(x)
    return out[ROUNDS:]


def side(n: int) -> int:
    """The least a with a * a >= n: a number below a * a is two digits in base a."""
    if not 0 < n <= 1 << 62:
        raise ValueError("n must be positive and at most 2**62")
    return isqrt(n - 1) + 1


def mixed(x: Column, key: Column) -> Column:
    """A number below PRIME that depends on all of x (below PRIME) and key, by a product, a shift and a square."""
    y = (x + key) % PRIME * FIRST % PRIME
    y = y.bitwiseXOR(F.shiftright(y, 15))
    y = y * SECOND % PRIME
    return (y * y + key) % PRIME


def _rounds(x: Column, a: int, keys: list[Column], back: bool) -> Column:
    """Feistel rounds over two digits in base a, or their inverse; a bijection of the numbers below a * a."""
    start = F.struct(F.call_function("div", x, F.lit(a).cast("long")).alias("l"), (x % a).alias("r"))
    listed = F.array(*(reversed(keys) if back else keys))

    def forward(s: Column, k: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], k)) % a).alias("r"))

    def backward(s: Column, k: Column) -> Column:
        return F.struct(((s["r"] - mixed(s["l"], k) % a + a) % a).alias("l"), s["l"].alias("r"))

    return F.aggregate(listed, start, backward if back else forward, lambda s: s["l"] * a + s["r"])


def _walked(x: Column, n: int, seed: int, turn: Column | int, back: bool) -> Column:
    """Rounds until the number is below n. Of a * a numbers at most 2 a are not, so a step leads there with a chance of 1 - 2 / a at least;
    for n below 961 the walk's 64 steps cover all of them, above it they fail with a chance below 10**-70, which is an error."""
    later = (turn if isinstance(turn, Column) else F.lit(turn)).cast("long") % PRIME * SECOND % PRIME
    a, keys = side(n), [(F.lit(k).cast("long") + later) % PRIME for k in round_keys(seed)]
    once = _rounds(x, a, keys, back)
    if a * a == n:
        return once

    def further(y: Column) -> Column:
        more = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda z, _: F.when(z < n, z).otherwise(_rounds(z, a, keys, back)))
        return F.when(more < n, more).otherwise(F.raise_error(F.lit("no place found")).cast("long"))

    # an array of one binds the number, so that rounds run once and only the few that are not below n walk on
    return F.transform(F.array(once), lambda y: F.when(y < n, y).otherwise(further(y)))[0]


def row_at(place: Column, n: int, seed: int, turn: Column | int = 0) -> Column:
    """Which of n rows stands at a place of a shuffled pass (a turn of a seed); both count from 0, and every row has one place."""
    return _walked(place.cast("long"), n, seed, turn, False)


def place_of(row: Column, n: int, seed: int, turn: Column | int = 0) -> Column:
    """Where a row stands in a shuffled pass: the inverse of row_at."""
    return _walked(row.cast("long"), n, seed, turn, True)
