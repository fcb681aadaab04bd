"""Global order without a global task: positions, running sums, neighbours and runs over all rows of a table.

Rows are dealt into ranges of the order and sorted inside; each range hands on one row (its count, sum, or border), those are
added up on the driver, and go back to all tasks. The number of such rows is the number of ranges, whatever the data.

The order must name each row (put tie-breakers behind it); where it doesn't, equal rows follow each other in any order, but in
one and the same for all columns of a result. A key that many rows share is cut between ranges only by the tie-breakers.
Nulls come last. Names that begin with ``__`` are the operator's own.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..scratch import pinned

#: monotonically_increasing_id has the number of the partition above these bits, and the place inside it below.
_PLACE_BITS = 33


def _inside() -> WindowSpec:
    return Window.partitionBy("__range").orderBy("__place")


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ``__range`` and ``__place``: ranges ascend in the order, as do the places (from 0) inside of each."""
    keys = [c.asc_nulls_last() if isinstance(c, Column) else F.col(c).asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return pinned(dealt.withColumns({"__range": F.shiftright("__id", _PLACE_BITS), "__place": F.col("__id").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("__id"))


def _with_offsets(ranged: DataFrame, total: Column, zero: int | float = 0) -> DataFrame:
    """ranged with ``__before``: the totals of all ranges before a row's own."""
    rows = sorted(ranged.groupBy("__range").agg(total.alias("t")).collect())  # one row a range
    before = [zero, *accumulate(r["t"] for r in rows)][: len(rows)]
    kind = "double" if isinstance(zero, float) else "long"
    offsets = ranged.sparkSession.createDataFrame([(r["__range"], type(zero)(b)) for r, b in zip(rows, before)], f"__range long, __before {kind}")
    return ranged.join(F.broadcast(offsets), "__range")


def numbered(df: DataFrame, *order: str | Column, out: str = "at") -> DataFrame:
    """Each row with its place, from 0, in the order of all rows."""
    placed = _with_offsets(in_ranges(df, *order), F.count(F.lit(1)))
    return placed.withColumn(out, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def running_before(df: DataFrame, value: str, *order: str | Column, out: str = "before") -> DataFrame:
    """Each row with the sum of the values of all rows before it; a null value counts as 0."""
    zero = 0.0 if dict(df.dtypes)[value] in ("double", "float") else 0
    x = F.coalesce(F.col(value), F.lit(zero))
    placed = _with_offsets(in_ranges(df, *order), F.sum(x), zero)
    inside = F.coalesce(F.sum(x).over(_inside().rowsBetween(Window.unboundedPreceding, -1)), F.lit(zero))
    return placed.withColumn(out, F.col("__before") + inside).drop("__range", "__place", "__before")


def with_previous(df: DataFrame, columns: dict[str, str], *order: str | Column) -> DataFrame:
    """Each row with columns of the row before it, under other names ``{column: name}``; the first row has nulls."""
    return _previous(in_ranges(df, *order), columns).drop("__range", "__place", "__first")


def _previous(ranged: DataFrame, columns: dict[str, str]) -> DataFrame:
    """ranged with columns of the row before, and ``__first``: whether there is none."""
    last = ranged.groupBy("__range").agg(F.max_by(F.struct(*columns), "__place").alias("row"))
    rows = sorted(last.collect(), key=lambda r: r["__range"])  # one row a range
    kinds = ", ".join(f"`__p_{i}` {ranged.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    shifted = [(b["__range"], *a["row"]) for a, b in zip(rows, rows[1:])]
    borders = ranged.sparkSession.createDataFrame(shifted, f"__range long, {kinds}")
    met = ranged.join(F.broadcast(borders), "__range", "left")
    head = F.col("__place") == 0
    inside = {c: F.lag(c).over(_inside()) for c in columns}
    first = rows[0]["__range"] if rows else 0
    out = met.withColumns({name: F.when(head, F.col(f"__p_{i}")).otherwise(inside[c]) for i, (c, name) in enumerate(columns.items())})
    return out.withColumn("__first", head & (F.col("__range") == first)).drop(*(f"__p_{i}" for i in range(len(columns))))


def islands(df: DataFrame, same: list[str], *order: str | Column, out: str = "run") -> DataFrame:
    """Each row with the number, from 0, of its run: neighbours in the order that agree in all columns of same (nulls are equal).

    A key that comes back after another one begins a new run, wherever the ranges were cut.
    """
    ranged = in_ranges(df, *order)
    names = {c: f"__b_{i}" for i, c in enumerate(same)}
    fresh = ~reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    marked = _previous(ranged, names).withColumn("__fresh", (F.col("__first") | fresh).cast("long")).drop(*names.values())
    placed = _with_offsets(marked, F.sum("__fresh"))
    inside = F.sum("__fresh").over(_inside().rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(out, F.col("__before") + inside - 1).drop("__range", "__place", "__before", "__fresh", "__first")
