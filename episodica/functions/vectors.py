"""Array expressions over numeric vectors; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: added to every scale before dividing.
EPS = 1e-6


def bool_mask(*dims: int) -> list[bool]:
    """+n gives n true, -n gives n false, 0 gives nothing."""
    return [d > 0 for d in dims for _ in range(abs(d))]


def pad_mask(mask: list[bool], dim: int) -> list[bool]:
    """A mask of dim flags: false beyond its end, or cut."""
    return [*mask[:dim], *[False] * (dim - len(mask))]


def constants(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def pad(x: Column, dim: int, value: float = 0.0, truncate: bool = False) -> Column:
    """Right-padded to dim; longer vectors are kept, or cut if truncate."""
    longer = F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(dim) - F.size(x), F.lit(0))))
    return F.slice(longer, 1, dim) if truncate else longer


def _masked(new: Column, old: Column, mask: list[bool] | None, tail: bool) -> Column:
    """Where mask is false the old value stays; beyond the mask, tail tells which one holds. An empty vector stays empty."""
    if mask is None:
        return new
    flags = constants(mask)
    return F.transform(new, lambda a, i: F.when(F.coalesce(F.get(flags, i), F.lit(tail)), a).otherwise(F.get(old, i)))


def standardise(x: Column, mean: Column, std: Column, mask: list[bool] | None = None, tail: bool = True) -> Column:
    """(x - mean) / (std + EPS); statistics longer than x are cut to it."""
    n = F.size(x)
    centred = F.zip_with(x, F.slice(mean, F.lit(1), n), lambda a, b: a - b)
    return _masked(F.zip_with(centred, F.slice(std, F.lit(1), n), lambda a, b: a / (b + EPS)), x, mask, tail)


def destandardise(x: Column, mean: Column, std: Column, dim: int, mask: list[bool] | None = None) -> Column:
    """Inverse of standardise on the first dim components; missing statistics count as mean 0 and std 1, and what lies beyond the mask stays."""
    scaled = F.zip_with(x, F.slice(F.concat(std, F.array_repeat(F.lit(1.0), F.size(x))), F.lit(1), F.size(x)), lambda a, b: a * (b + EPS))
    moved = F.zip_with(scaled, F.slice(F.concat(mean, F.array_repeat(F.lit(0.0), F.size(x))), F.lit(1), F.size(x)), lambda a, b: a + b)
    return F.slice(_masked(moved, x, mask, False), 1, dim)


def rescale_quantiles(x: Column, low: Column, high: Column) -> Column:
    """The range from the low to the high quantile becomes [-1, 1]."""
    shifted = F.zip_with(x, F.slice(low, F.lit(1), F.size(x)), lambda a, b: a - b)
    width = F.zip_with(high, low, lambda a, b: a - b + EPS)
    return F.zip_with(shifted, F.slice(width, F.lit(1), F.size(x)), lambda a, w: a / w * 2 - 1)


def delta(action: Column, state: Column, mask: list[bool]) -> Column:
    """Actions relative to the state where the mask is true."""
    moves = F.zip_with(F.slice(state, 1, len(mask)), constants(mask), lambda s, m: F.when(m, s).otherwise(0.0))
    return F.transform(action, lambda a, i: a - F.coalesce(F.get(moves, i), F.lit(0.0)))


def gripper_to_unit(action: Column) -> Column:
    """The last component from [-1, 1] to [0, 1], reversed: (1 - a) / 2."""
    return F.concat(F.slice(action, F.lit(1), F.size(action) - 1), F.array((1 - F.element_at(action, -1)) / 2))


def gripper_from_unit(action: Column, width: int = 7) -> Column:
    """1 - 2g on the last of the first `width` components."""
    own = F.slice(action, 1, width)
    return F.concat(F.slice(own, F.lit(1), F.size(own) - 1), F.array(1 - 2 * F.element_at(own, -1)))


def state_vector(position: Column, orientation: Column, gripper: Column, whole_gripper: bool = False) -> Column:
    """Position, orientation, a zero, and the gripper's first component; or position, orientation and all of the gripper."""
    if whole_gripper:
        return F.concat(position, orientation, gripper)
    return F.concat(position, orientation, F.array(F.lit(0.0)), F.slice(gripper, 1, 1))


def first_long(x: Column) -> Column:
    """The first element of an array as an integer, null where there is none."""
    return F.get(x, F.lit(0)).cast("long")


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation vector of a quaternion; w is clipped to [-1, 1], and no rotation gives zeros."""
    c = F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0))
    den = F.sqrt(1 - c * c)
    return F.transform(F.array(x, y, z), lambda q: F.when(den == 0, 0.0).otherwise(q * 2 * F.acos(c) / F.when(den == 0, 1.0).otherwise(den)))


def squared_error(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def mean_of(x: Column, first: int | None = None) -> Column:
    part = x if first is None else F.slice(x, 1, first)
    return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / F.size(part)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def interpolate(noise: Column, action: Column, t: Column) -> Column:
    """t * noise + (1 - t) * action."""
    return F.zip_with(noise, action, lambda e, a: t * e + (1 - t) * a)


def flow_target(noise: Column, action: Column) -> Column:
    return F.zip_with(noise, action, lambda e, a: e - a)


def sinusoidal(position: Column, dim: int, least: float, most: float) -> Column:
    """Sines, then cosines, of position over periods spaced geometrically from least to most."""
    if dim % 2:
        raise ValueError("the dimension must be even")
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: 2 * F.pi() * position / (F.lit(least) * F.pow(F.lit(most / least), i / F.lit(max(1, half - 1)))))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def unit_pixels(x: Column) -> Column:
    """0..255 to [-1, 1]."""
    return x / 255.0 * 2 - 1


def adam_momentum(step: Column, b1: float = 0.9, b2: float = 0.95, start: float = 0.85, steps: int = 25) -> tuple[Column, Column]:
    """First and second momentum: the first warms up by a factor from start to 1, the second keeps the ratio of their distances to 1."""
    first = F.least(F.lit(start) + (1 - start) * step / steps, F.lit(1.0)) * b1
    return first, 1 - (1 - first) * ((1 - b2) / (1 - b1))


def learning_rate(step: Column, warmup: int = 400, peak: float = 2.5e-5, decay: int = 10_000, end: float = 2.5e-6) -> Column:
    """Linear from peak / (warmup + 1), then a cosine to end; steps past decay stay there."""
    start = peak / (warmup + 1)
    rise = start + (peak - start) * step / warmup
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, decay - warmup)))))
    return F.when(step < warmup, rise).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(F.pi() * progress)))
