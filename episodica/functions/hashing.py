"""Draws that depend on a seed and a key alone, never on partitions: the same rows on any cluster and in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *keys: Column | str) -> Column:
    """Hex digest of seed and keys; ordering by it is a random permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from 32 bits of the digest."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal draw (Box and Muller) from two uniform draws of the same key."""
    u = F.greatest(uniform(seed, *keys), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed + 1_000_003, *keys))
