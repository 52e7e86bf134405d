"""Bootstrap intervals of group means from bounded sums.

Rows fall into BLOCKS blocks per group by a hash of their identifier; only the count and sum of each block are kept, by partial aggregation. A replicate
draws each block a Poisson(1) number of times, told by a hash of (seed, group, block, replicate), so the result is the same in any layout and the cost of
the replicates does not grow with the rows.

Defined cases: null and not finite values do not count; a group without values has no row; repeated rows count as often as they occur; with one block
in use, the interval is where its mean lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vectors as V

BLOCKS = 256
#: Upper bounds of the Poisson(1) counts 0, 1, 2, ... on the scale of 16^8.
POISSON = tuple(int(16**8 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def _digits(*parts: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256 of the parts, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, n), 16, 10).cast("bigint")


def bootstrap_means(df: DataFrame, group: str, ident: str, value: str, replicates: int, seed: int, levels: Sequence[float]) -> DataFrame:
    """(group, n, mean, low, high): the mean and the values at floor(level * replicates) of the ascending replicates' means for both levels."""
    x = F.col(value)
    rows = df.where(V.is_finite(x)).select(group, F.pmod(_digits(F.col(ident).cast("string"), n=6), F.lit(BLOCKS)).alias("block"), x.cast("decimal(38,9)").alias("x"))
    blocks = rows.groupBy(group, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    at = _digits(F.lit(str(seed)), F.col(group).cast("string"), F.col("block").cast("string"), F.col("b").cast("string"), n=8)
    times = sum((F.when(at >= bound, 1).otherwise(0) for bound in POISSON), F.lit(0))
    drawn = blocks.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", times)
    means = drawn.groupBy(group, "b").agg((F.sum(F.col("k") * F.col("s")).cast("double") / F.nullif(F.sum(F.col("k") * F.col("n")), F.lit(0))).alias("m"))
    sorted_ = F.array_sort(F.collect_list("m"))  # one value per replicate
    ends = means.groupBy(group).agg(sorted_.alias("ms")).select(group, *(F.element_at("ms", F.greatest(F.floor(F.lit(level) * F.size("ms")).cast("int"), F.lit(1))).alias(n) for n, level in zip(("low", "high"), levels)))
    whole = blocks.groupBy(group).agg(F.sum("n").alias("n"), (F.sum("s").cast("double") / F.sum("n")).alias("mean"))
    return whole.join(ends, group)
