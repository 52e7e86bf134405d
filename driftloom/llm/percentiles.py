"""Mergeable percentiles with a guaranteed relative error: counts in signed logarithmic buckets.

Bucket i of a sign holds the magnitudes in (gamma^(i-1), gamma^i] with gamma = (1 + alpha) / (1 - alpha); its value 2 gamma^i / (gamma + 1) is
within a relative error of alpha of every member. Zero has a bucket of its own. A sketch is a table (keys, metric, sgn, bucket, cnt): sketches
of partitions, files or days are combined by adding the counts of equal buckets, without loss. The counts are partially aggregated
before the shuffle, so a group that holds most rows costs as little as any other; the number of buckets of a group depends on the spread of
its values only (about ln(max / min) / (2 alpha) for each sign).

Percentile p of n values is the value of rank floor(p (n - 1)), counted from 0 in ascending order.

Defined cases: null, NaN and infinite values are not counted; a group without a finite value has no row; a null group is a group; an empty
table gives an empty sketch; repeated rows count as often as they occur, since a sketch of one day cannot know another day's rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gamma_of(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def sketch(df: DataFrame, groups: Sequence[str], values: Sequence[str], alpha: float) -> DataFrame:
    """(groups, metric, sgn, bucket, cnt)."""
    log_gamma = math.log(gamma_of(alpha))
    pairs = F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values))
    long = df.select(*groups, F.explode(pairs).alias("_pair")).select(*groups, "_pair.metric", "_pair.v")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    bucket = F.when(F.col("v") == 0, 0).otherwise(F.ceil(F.ln(F.abs("v")) / F.lit(log_gamma)).cast("int"))
    return long.groupBy(*groups, "metric", F.signum("v").cast("int").alias("sgn"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds the counts of equal buckets; ``groups`` may be fewer than the sketches' own keys (days to a total)."""
    return sketches.groupBy(*groups, "metric", "sgn", "bucket").agg(F.sum("cnt").alias("cnt"))


def percentiles(sketches: DataFrame, groups: Sequence[str], ps: Sequence[float], alpha: float) -> DataFrame:
    """(groups, metric, p, n, estimate) from one sketch per group."""
    gamma = gamma_of(alpha)
    keys = [*groups, "metric"]
    by = Window.partitionBy(*keys)
    upto = by.orderBy("sgn", F.col("sgn") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("n", F.sum("cnt").over(by)).withColumn("cum", F.sum("cnt").over(upto))
    hits = F.filter(F.array(*map(F.lit, map(float, ps))), lambda p: (F.floor(p * (F.col("n") - 1)) < F.col("cum")) & (F.floor(p * (F.col("n") - 1)) >= F.col("cum") - F.col("cnt")))
    value = F.col("sgn") * F.lit(2 / (gamma + 1)) * F.pow(F.lit(gamma), F.col("bucket"))
    return ranked.select(*keys, F.explode(hits).alias("p"), "n", value.alias("estimate"))
