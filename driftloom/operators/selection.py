"""Latest rows, hash-ranked and nested subsets, round-robin and seeded samples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.text import selection_hash


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: Sequence[Column] = ()) -> DataFrame:
    """The row of greatest ``order`` per key, by partial aggregation rather than a window over each key's rows.

    ``first``: columns whose least value over the key's rows is kept as well, under their own names."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    rows = df.groupBy(*keys).agg(best, *(F.min(c).alias(f"_first_{i}") for i, c in enumerate(first)))
    return rows.select(*keys, "_row.*", *(F.col(f"_first_{i}").alias(f"first_{i}") for i in range(len(first))))


def hash_ranked(df: DataFrame, ident: str, n: int, seed: int, namespace: str) -> DataFrame:
    """The n rows of least (hash, ident); a top-n, so each task sends n rows at most."""
    return df.withColumn("stable_hash", selection_hash(seed, namespace, F.col(ident))).orderBy("stable_hash", ident).limit(n)


def nested(df: DataFrame, ident: str, sizes: Sequence[tuple[str, int]], seed: int) -> DataFrame:
    """Nested subsets: each namespace is ranked inside the one before; (ident, <namespace> boolean...) for the first subset's rows."""
    name, n = sizes[0]
    rows = hash_ranked(df.select(ident), ident, n, seed, name).select(ident).withColumn(name, F.lit(True))
    inner = rows
    for name, n in sizes[1:]:
        inner = hash_ranked(inner.select(ident), ident, n, seed, name).select(ident, F.lit(True).alias(name))
        rows = rows.join(inner, ident, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return rows


def round_robin(df: DataFrame, bucket: str, order: Sequence[str], n: int) -> DataFrame:
    """One row of each bucket in turn until n are taken; null is a bucket, the last one. Only the first n rows of a bucket are ever ranked on."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("turn", rank).where(F.col("turn") <= n).orderBy("turn", F.col(bucket).asc_nulls_last()).limit(n)


def sampled_per_group(df: DataFrame, group: str, ident: str, size: str, seed: str, namespace: str = "sample") -> DataFrame:
    """Up to ``size`` rows per group by least hash of (seed, namespace, group, ident); size and seed are columns.

    The greatest size is read first, so that each task keeps no more rows of a group than that before the shuffle."""
    most = df.agg(F.max(size)).first()[0] or 0
    h = F.sha2(F.concat_ws(":", F.col(seed).cast("string"), F.lit(namespace), F.col(group), F.col(ident).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", ident))
    return df.withColumn("_h", h).withColumn("rank", rank).where(F.col("rank") <= int(most)).where(F.col("rank") <= F.col(size)).drop("_h")


def drawn_indices(population: int, n: int, seed: int) -> list[int]:
    """The indices that the standard library's generator draws without replacement, in ascending order; all if n >= population."""
    return list(range(population)) if n >= population else sorted(random.Random(seed).sample(range(population), n))


def drawn(df: DataFrame, order: Sequence[str], n: int, seed: int) -> DataFrame:
    """Rows at ``drawn_indices`` of the order, for populations small enough to be numbered in one task (config-sized tables)."""
    rows = df.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    wanted = df.sparkSession.createDataFrame([(i,) for i in drawn_indices(df.count(), n, seed)], "_at int")
    return rows.join(F.broadcast(wanted), "_at").drop("_at")  # n indices
