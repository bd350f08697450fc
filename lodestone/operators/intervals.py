"""Interval operators: overlap, innermost container, as-of look-up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


STEP = 3  # bits between two lengths of cells
TOP = 24  # bits of the longest cells; what is longer covers several of them


def _level(start: Column, end: Column) -> Column:
    """Bits of the shortest cells that are as long as an interval."""
    bits = F.when(end > start, F.length(F.bin(end - start))).otherwise(0)
    return F.least(F.ceil(bits / F.lit(STEP)).cast("int") * STEP, F.lit(TOP))


def _in_cells(df: DataFrame, key: str, span: tuple[str, str], side: str, only_own: bool, where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row for every cell that an interval touches: of its own length, and of all longer ones unless ``only_own``.

    An interval touches two cells of a length at most, but for the longest cells.
    ``where`` says of a length, and an interval's own one, whether cells of it are needed.
    """
    start, end = (F.col(c).cast("long") for c in span)
    own = df.withColumns({f"_from_{side}": start, f"_to_{side}": end, f"_own_{side}": _level(start, end)})
    levels = F.array(F.col(f"_own_{side}")) if only_own else F.sequence(F.col(f"_own_{side}"), F.lit(TOP), F.lit(STEP))
    if where:
        levels = F.filter(levels, lambda at: where(at, F.col(f"_own_{side}")))
    cells = own.where((F.col(f"_from_{side}") <= F.col(f"_to_{side}")) & F.col(key).isNotNull()).withColumn("_level", F.explode(levels))
    first = F.expr(f"shiftright(_from_{side}, _level)")
    return cells.withColumn(f"_first_{side}", first).withColumn("_cell", F.explode(F.sequence(first, F.expr(f"shiftright(_to_{side}, _level)"))))


def lengths(df: DataFrame, span: tuple[str, str]) -> list[int]:
    """The lengths of cells, in bits, that the intervals of a table have as their own."""
    start, end = (F.col(c).cast("long") for c in span)
    return sorted(df.where(start <= end).select(_level(start, end).alias("at")).distinct().toPandas()["at"].tolist())


def _meeting(points: DataFrame, ranges: DataFrame, key: str, p: tuple[str, str], r: tuple[str, str], known: tuple[list[int], list[int]] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in their cells, and the columns on which they meet.

    The longer of two intervals is in cells of its own length: ``_meet`` is 0
    where that is the point, or both, and 1 where it is the range. Two short
    intervals never meet in long cells, which all of a key share.
    """
    longer = lambda side: F.col("_level") > F.col(f"_own_{side}")
    of_left = of_right = None
    if known:
        of_p, of_r = known
        of_left = lambda at, own: (at == own) | at.isin(*of_r)
        of_right = lambda at, own: at.isin(*of_p) | ((at == own) & (at > min(of_p, default=TOP)))
    left = _in_cells(points, key, p, "p", r[0] == r[1], of_left).withColumn("_meet", longer("p").cast("int"))
    right = _in_cells(ranges, key, r, "r", p[0] == p[1], of_right).withColumn("_meet", F.explode(F.when(longer("r"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    if known:
        right = right.where(F.when(F.col("_meet") == 0, F.col("_level").isin(*of_p)).otherwise(F.col("_level") > min(of_p, default=TOP)))
    return left, right, [key, "_level", "_cell", "_meet"]


def overlap_join(points: DataFrame, ranges: DataFrame, key: str, p: tuple[str, str], r: tuple[str, str], how: str = "inner", known: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Rows of two tables with one key whose closed integer intervals overlap.

    The result has both tables' columns, those of ``points`` as ``p.`` and those
    of ``ranges`` as ``r.``; with ``how`` left_semi or left_anti it has rows of
    ``points`` alone. Intervals meet in cells whose lengths are powers of two: in
    cells as long as the longer of the two, the first one that both touch. So a
    key with many lines and many ranges costs about the pairs that it yields,
    never all of them. Empty intervals and null ends or keys meet nothing.

    Neither side is ever broadcast: sizes are estimated without the rows that
    the cells add. ``known`` has the ``lengths`` of both sides: intervals are then
    in cells of those lengths only that the other side has, mostly one row each
    where they else have one for every length.
    """
    left, right, on = _meeting(points, ranges, key, p, r, known)
    left, right = left.alias("p"), right.alias("r")
    meets = (F.col("_from_p") <= F.col("_to_r")) & (F.col("_to_p") >= F.col("_from_r"))
    once = F.col("p._cell") == F.greatest("_first_p", "_first_r")
    same = reduce(and_, (F.col(f"p.{c}") == F.col(f"r.{c}") for c in on))
    met = left.join(right.hint("merge"), same & once & meets)
    if how == "inner":
        return met
    hit = met.select(*(F.col(f"p.{c}").alias(f"_{i}") for i, c in enumerate(dict.fromkeys((key, *p))))).distinct()
    alike = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(dict.fromkeys((key, *p)))]
    return points.join(hit.hint("merge"), alike, how)


def overlap_length(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Length of the overlap of two closed integer intervals, 0 at least."""
    return F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1, F.lit(0))


def innermost(joined: DataFrame, point: list[str], width: Column, order: list[Column]) -> DataFrame:
    """Of the ranges joined to each point the narrowest, first in order on ties."""
    return joined.withColumn("_at", F.row_number().over(Window.partitionBy(*point).orderBy(width, *order))).where("_at = 1").drop("_at")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, carry: list[str], tie: str) -> DataFrame:
    """For each left row the columns of the last right row of its key at or before it.

    Both sides go through one window over their union, so a key costs its rows,
    not its pairs. On equal times right rows come first; ``tie`` orders them.
    """
    mine = left.select("*", F.lit(1).alias("_side"), *(F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_{c}") for c in carry))
    theirs = right.select(key, at, tie, *(F.col(c).alias(f"_{c}") for c in carry)).withColumn("_side", F.lit(0))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("*", *(F.last(F.when(F.col("_side") == 0, F.struct(F.col(f"_{c}"))), ignorenulls=True).over(w).alias(f"_s_{c}") for c in carry))
    return found.where("_side = 1").select(*left.columns, *(F.col(f"_s_{c}._{c}").alias(f"matched_{c}") for c in carry))
