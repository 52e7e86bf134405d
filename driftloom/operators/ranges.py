"""Joins of points with half-open ranges, without comparing every point with every range.

A range of width w is registered at level ceil(log2 w), where it touches at most two cells of size 2^level; a point looks up its one cell at each
level that occurs. So both sides are joined by equality on (level, cell), however wide the ranges are and however they overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` and ``ranges`` with start <= at < end. Null bounds or points and empty ranges match nothing.

    The sides must not share column names."""
    level = F.ceil(F.log2(F.col(end) - F.col(start))).cast("int")
    kept = ranges.where(F.col(end) > F.col(start)).withColumn("_level", level)
    cells = F.sequence(F.expr(f"shiftright({start}, _level)"), F.expr(f"shiftright({end} - 1, _level)"))
    registered = kept.withColumn("_cell", F.explode(cells))
    levels = kept.agg(F.collect_set("_level").alias("_levels"))  # one row, at most 64 levels
    looked = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).withColumn("_cell", F.expr(f"shiftright({at}, _level)")).drop("_levels")
    return looked.join(registered, ["_level", "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_cell")
