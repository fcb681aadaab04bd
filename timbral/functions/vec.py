"""Vector arithmetic on array columns. Arguments are arrays of numbers; results are doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row. A lambda over an array computes what it refers to anew for each element, so that
    a sum over the same array would take the square of its length."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, scale: str = "raw") -> Column:
    """raw: from -1 to 1; unit: (x + 1) / 2."""
    c = dot(a, b) / (norm(a) * norm(b))
    return (c + 1) / 2 if scale == "unit" else c


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def times(v: Column, factor: Column | float) -> Column:
    if not isinstance(factor, Column):
        return F.transform(as_double(v), lambda x: x * F.lit(float(factor)))
    return held(factor, lambda f: F.transform(as_double(v), lambda x: x * f))


def length_norm(v: Column, kind: str = "unit") -> Column:
    """unit: norm 1; dimension: norm sqrt(D), as likelihood-ratio scoring expects. Zeros have no direction and become nulls."""
    return times(v, F.try_divide(F.sqrt(F.size(v).cast("double")) if kind == "dimension" else F.lit(1.0), norm(v)))


def project(v: Column, columns: list[list[float]]) -> Column:
    """v times a matrix that is given by its columns, for small matrices."""
    return F.array(*(dot(v, F.array(*(F.lit(float(x)) for x in c))) for c in columns))


def lit_vector(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def min_max_diff_ratio(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    low, high = F.least(a, b), F.greatest(a, b)
    return low, high, high - low, low / high


def mel(hz: Column, form: str = "natural") -> Column:
    return 1127.0 * F.log(1 + hz / 700.0) if form == "natural" else 2595.0 * F.log10(1 + hz / 700.0)


def inverse_mel(m: Column, form: str = "natural") -> Column:
    return 700.0 * (F.exp(m / 1127.0) - 1) if form == "natural" else 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def poincare_distance(a: Column, b: Column) -> Column:
    """Distance in the unit ball, for vectors of norm below 1."""
    d = minus(a, b)
    return F.acosh(1 + 2 * dot(d, d) / ((1 - dot(a, a)) * (1 - dot(b, b))))


def to_ball(v: Column, curvature: float = 1.0, eps: float = 1e-5) -> Column:
    """v, shortened to just below the radius of the ball of that curvature where it is longer."""
    return times(v, F.least((1 - eps) / curvature**0.5 / F.greatest(norm(v), F.lit(eps)), F.lit(1.0)))


def margin_logit(cos: Column, is_class: Column, kind: str = "aam", margin: float = 0.2, scale: float = 32.0) -> Column:
    """Logits of margin softmax: aam adds the margin to the angle, am subtracts it from the cosine."""
    if kind == "am":
        own = cos - margin
    else:
        sine = F.sqrt(F.greatest(1 - cos * cos, F.lit(0.0)))
        import math

        own = F.when(cos > math.cos(math.pi - margin), cos * math.cos(margin) - sine * math.sin(margin)).otherwise(cos - math.sin(math.pi - margin) * margin)
    return scale * F.when(is_class, own).otherwise(cos)


def chunk(v: Column, start: Column, length: int) -> Column:
    """length values from start (from 0); a shorter array is repeated until it is long enough."""
    n = F.size(v)
    repeated = F.flatten(F.array_repeat(v, F.floor(F.lit(length) / n).cast("int") + 1))
    return F.when(n >= length, F.slice(v, start.cast("int") + 1, F.lit(length))).otherwise(F.slice(repeated, 1, length))


def peak_normalise(v: Column) -> Column:
    return times(v, 1.0 / (F.array_max(F.transform(as_double(v), lambda x: F.abs(x))) + 1e-4))


def mask_range(v: Column, first: Column, width: Column) -> Column:
    """Zeros from position first (from 0) over width values, as in time and frequency masking."""
    return F.transform(as_double(v), lambda x, i: F.when((i >= first) & (i < first + width), 0.0).otherwise(x))


def noise_gain(signal: Column, noise: Column, snr_db: Column) -> Column:
    """The factor on the noise that gives the signal-to-noise ratio."""
    power = lambda x: dot(x, x) / F.size(x) + 1e-4
    db = lambda x: 10 * F.log10(power(x))
    return F.sqrt(F.pow(F.lit(10.0), (db(signal) - db(noise) - snr_db) / 10))
