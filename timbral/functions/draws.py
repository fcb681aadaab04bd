"""Random draws as functions of (key, seed, number of the draw): expressions without state.

The same key, seed and draw give the same value on any partitioning, in any order and on every retry, and SQL can say it:
the first 48 bits of an md5 of the three, joined by bars. A null key draws as the empty string does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 48


def unit(key: Column, seed: str, draw: int | Column) -> Column:
    """From 0 (included) to 1 (not)."""
    number = draw.cast("string") if isinstance(draw, Column) else F.lit(str(draw))
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed), number)
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)


def whole(key: Column, seed: str, draw: int | Column, n: Column | int) -> Column:
    """0 to n - 1, as a long; null where n isn't positive."""
    count = n.cast("long") if isinstance(n, Column) else F.lit(n).cast("long")
    return F.when(count > 0, F.floor(unit(key, seed, draw) * count))


def between(key: Column, seed: str, draw: int | Column, low: Column | float, high: Column | float) -> Column:
    """Even between two levels."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return low + unit(key, seed, draw) * (high - low)


def chance(key: Column, seed: str, draw: int | Column, p: float) -> Column:
    """True with probability p."""
    return unit(key, seed, draw) < p
