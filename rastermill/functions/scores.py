"""Scalar expressions: grey conversion, the score of a window, rectangles and small integer helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in 1/16384, and the rounding half.
GREY_WEIGHTS, GREY_HALF, GREY_SHIFT = (4899, 9617, 1868), 8192, 14
#: When a window counts as flat, and how far rounding may push a score beyond 1.
FLAT_CAP, FLAT_SCALE, SATURATION = 0.5, 10 * 2.0**-23, 1.125
#: The largest template area by number of channels for which all sums fit in 64 bits.
AREA_CAPS = {1: 11909805, 2: 8421504, 3: 6876129, 4: 5954902}


def grey(r: Column, g: Column, b: Column) -> Column:
    """BT.601 grey of 8-bit channels, in integers."""
    return F.shiftright(sum(w * c.cast("long") for w, c in zip(GREY_WEIGHTS, (r, g, b), strict=True)) + GREY_HALF, GREY_SHIFT)


def score(corr: Column, cross: Column, squares: Column, s2: Column, area: Column, var_sum: Column) -> Column:
    """Pearson coefficient of a window and a template from exact sums.

    corr: sum of products; cross: sum over channels of window sum times template sum; squares: sum of
    squared window sums; s2: sum of squared window values. 1 for a flat template, 0 for a flat window.
    """
    a = area.cast("double")
    num = corr.cast("double") - cross.cast("double") / a
    spread = (area * s2 - squares).cast("double") / a
    limit = F.least(F.lit(FLAT_CAP), F.lit(FLAT_SCALE) * s2.cast("double"))
    den = F.when(spread > limit, F.sqrt(spread) * F.sqrt(var_sum.cast("double") / a)).otherwise(F.lit(0.0))
    ladder = F.when(F.abs(num) < den, num / den).when(F.abs(num) < SATURATION * den, F.signum(num)).otherwise(F.lit(0.0))
    return F.when(var_sum == 0, F.lit(1.0)).otherwise(ladder)


def saturated(v: Column) -> Column:
    """Cut off at 0 and 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), v))


def next_pow2(n: Column) -> Column:
    """The least power of two that is n or more, for n from 1 to 2^30."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long") - 1)) - F.when(n <= 1, 1).otherwise(0))


def clamp_workers(n: int, available: int) -> int:
    """0 or less: as many as there are, 16 at most; else 1 to 16."""
    return max(1, min(16, available if n <= 0 else n))


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle with its corners in order; x1 and y1 are outside."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def intersect(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"))


def is_empty(r: Column) -> Column:
    return (r["x1"] <= r["x0"]) | (r["y1"] <= r["y0"])


def lcg(state: Column) -> Column:
    """The next state of the 32-bit linear congruential generator used for textures."""
    return F.pmod(state.cast("decimal(38,0)") * 1664525 + 1013904223, F.lit(1 << 32)).cast("long")
