"""Statistics with the pipeline's own rules: three medians, deviations of one value, guarded correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_median(x: Column) -> Column:
    return F.median(x)


def upper_median(x: Column) -> Column:
    """The element at index n div 2 of the ascending values, for groups of bounded size; counts of equal values do it for others."""
    n = F.count(x)
    return F.element_at(F.sort_array(F.collect_list(x)), F.floor(n / 2).cast("int") + 1)


def deviation(x: Column) -> Column:
    """Sample deviation, 0 for one value, null for none."""
    return F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))


def exact_mean(x: Column) -> Column:
    """Mean of values taken to six places, added up as decimals: the same in any order of the rows."""
    return F.sum(x.cast("decimal(38,6)")).cast("double") / F.count(x)


def quantiles(x: Column, ps: list[float]) -> Column:
    """Linear interpolation between ranks."""
    return F.percentile(x, F.array(*map(F.lit, ps)))


def positive_share(x: Column) -> Column:
    return F.avg((x > 0).cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (spread > 1e-15), F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def top_mean(x: Column, k: int) -> Column:
    """Mean of the k greatest values; for groups of bounded size (the tokens of one sequence)."""
    top = F.slice(F.sort_array(F.collect_list(x), asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)


def band(value: Column, high: float, low: float) -> Column:
    return F.when(value.isNull(), "missing").when(value >= high, "pass").when(value >= low, "caution").otherwise("fail")


#: Relative width of the cells that order statistics are found in; a group has some 10,000 of them for each power of 10,000.
_WIDTH, _SHIFT = 0.001, 800_000


def ordered_cell(x: Column) -> Column:
    """A whole number that never falls as x grows: values of about the same size share one."""
    size = F.ceil(F.ln(F.abs(x)) / _WIDTH) + _SHIFT
    return F.when(x == 0, F.lit(0)).otherwise((F.signum(x) * size).cast("long"))


#: Cells that the values of one cell are spread over again, by their place between its least and greatest.
_FINE = 1 << 16


def _cells(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their cell and finer cell, and per finer cell its count, the rows below it and the rows of its group. Windows run over cells, not rows.

    Values that lie close together share a cell of relative width, however many they are; so each cell is divided once more by its own range."""
    x = F.col(value)
    celled = df.withColumn("_cell", ordered_cell(x))
    ranges = celled.groupBy(*keys, "_cell").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    fine = F.when(F.col("_hi") > F.col("_lo"), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _FINE)).otherwise(0)
    celled = celled.join(ranges, [*keys, "_cell"]).withColumn("_fine", fine).drop("_lo", "_hi")
    hist = celled.groupBy(*keys, "_cell", "_fine").agg(F.count(F.lit(1)).alias("_in"))
    cells = hist.groupBy(*keys, "_cell").agg(F.sum("_in").alias("_cell_in"))
    by = Window.partitionBy(*keys)
    cells = cells.withColumn("_cell_below", F.sum("_cell_in").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell_in")).withColumn("_all", F.sum("_cell_in").over(by))
    within = Window.partitionBy(*keys, "_cell").orderBy("_fine").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_below", F.sum("_in").over(within) - F.col("_in")).join(cells, [*keys, "_cell"])
    return celled, hist.withColumn("_below", F.col("_below") + F.col("_cell_below")).drop("_cell_in", "_cell_below")


def value_at(df: DataFrame, keys: Sequence[str], value: str, fraction: float) -> DataFrame:
    """(keys, value): the element at index floor(n * fraction) of each group's finite ascending values, exact; only one finer cell of a group is sorted."""
    celled, hist = _cells(df, keys, value)
    at = F.least(F.floor(F.col("_all") * fraction), F.col("_all") - 1)
    cell = hist.where((F.col("_below") <= at) & (F.col("_below") + F.col("_in") > at)).select(*keys, "_cell", "_fine", (at - F.col("_below")).alias("_at"))
    values = celled.join(cell, [*keys, "_cell", "_fine"]).groupBy(*keys, "_at", value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*keys, value)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The rows with the rank of their finite value in their group, from 1, ties sharing the mean of their ranks.

    A rank is the number of rows in lower cells, and the rank within the finer cell; equal values are counted once."""
    celled, hist = _cells(df, keys, value)
    values = celled.groupBy(*keys, "_cell", "_fine", value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_cell", "_fine").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.withColumn("_upto", upto).join(hist.select(*keys, "_cell", "_fine", "_below"), [*keys, "_cell", "_fine"])
    return df.join(ranks.select(*keys, value, (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), [*keys, value])
