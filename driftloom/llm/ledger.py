"""A reproducible sample that is stable as data grows: a persisted selection ledger.

Every key has a priority, the SHA-256 of the seed and the key, which depends on nothing else. A ledger is the table of the keys selected so far,
a folder with one part per generation: ``extend`` reads what is there and adds the next part, ``load`` reads all. To grow it, all earlier keys are kept by join; the quota, a share of the keys known now, is then filled from the unselected keys with
the lowest priority. So a selected key stays selected whatever is added, and the same data give the same sample in any layout.

Scale: the lowest-priority keys are found without a global sort. Keys are counted by the first 16 bits of their priority (65,536 rows at most,
the bound of what is ever gathered); whole cells below the cut are taken, and the cell at the cut is ranked or, above RANKED keys, first
counted again by the next 16 bits.

Defined cases: repeated keys are one key; null parts are a value of their own, distinct from every string; an empty table leaves the ledger
as it is; a quota below the ledger's size keeps the whole ledger; keys that vanish from the data stay in the ledger; a generation that is
written already is not drawn again; a part whose writing broke off has no success mark, does not count and is written anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL_DIGITS = 4
#: A cell of so many keys is ranked as it is.
RANKED = 1_000_000
#: Name of a generation's part, before its number.
PART = "part_"


def priority(seed: int, parts: Sequence[str]) -> Column:
    """Hex digest of seed and parts, joined by U+001F; a null part is U+0000."""
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *texts), 256)


def lowest(keys: DataFrame, quota: int, order: str = "priority") -> DataFrame:
    """The ``quota`` keys of least ``order``, a unique hex column: those up to the last of them, which is found by counting cells, then cells of cells."""
    prefix, left = "", quota
    if quota <= 0:
        return keys.limit(0)
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # 16^CELL_DIGITS rows at most
    for _ in range(2):
        cell = F.substring(order, 1, len(prefix) + CELL_DIGITS).alias("_cell")
        counts = keys.where(F.col(order).startswith(prefix)).groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
        at = counts.where(F.col("_upto") >= left).orderBy("_cell").first()
        if at is None:
            return keys
        prefix, left = at["_cell"], left - (at["_upto"] - at["_n"])
        if at["_n"] <= RANKED:  # the same keys come out either way
            break
    last = keys.where(F.col(order).startswith(prefix)).select(order).orderBy(order).limit(left).agg(F.max(order)).first()[0]
    return keys.where(F.col(order) <= last)


def grow(keys: DataFrame, ledger: DataFrame | None, parts: Sequence[str], share: float, seed: int, generation: int) -> DataFrame:
    """The ledger after ``keys`` (distinct, with priority) are known: (parts, priority, generation).

    ``ledger`` is an earlier result, or None. The caller persists what is returned. ``keys`` is read several times and should be materialised."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    have = ledger if ledger is not None else keys.select(*parts, "priority", F.lit(0).alias("generation")).limit(0)
    fresh = keys.select(*parts, "priority").join(have.select("priority"), "priority", "left_anti")
    quota = math.ceil(round(keys.count() * share, 6)) - have.count()
    added = lowest(fresh, quota).select(*parts, "priority", F.lit(generation).alias("generation"))
    return have.select(*parts, "priority", "generation").unionByName(added)


def distinct_keys(df: DataFrame, parts: Sequence[str], seed: int, seen: Sequence[str] = ()) -> DataFrame:
    """One row per key with its priority, and the least of the ``seen`` times as seen_at (null if none is given)."""
    times = [F.col(c).cast("timestamp_ntz") for c in seen]
    at = F.greatest(*times) if len(times) > 1 else times[0] if times else F.lit(None).cast("timestamp_ntz")
    return df.select(*parts, at.alias("seen_at")).groupBy(*parts).agg(F.min("seen_at").alias("seen_at")).withColumn("priority", priority(seed, parts))


def generations(spark: SparkSession, path: str) -> list[int]:
    """The generations whose parts are written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    whole = [n for n in names if n.startswith(PART) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[len(PART) :]) for n in whole)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """All written generations of the ledger at ``path``; None if there are none."""
    parts = [f"{path}/{PART}{n}" for n in generations(spark, path)]
    return spark.read.parquet(*parts) if parts else None


def extend(keys: DataFrame, path: str, parts: Sequence[str], share: float, seed: int, generation: int) -> None:
    """Draws a generation from ``keys`` and adds it to the ledger at ``path``, unless it is there already."""
    spark = keys.sparkSession
    done = generations(spark, path)
    if generation in done:
        return
    if done and done[-1] > generation:
        raise ValueError(f"the ledger holds generation {done[-1]} already")
    grown = grow(keys, load(spark, path), parts, share, seed, generation).where(F.col("generation") == generation)
    grown.write.mode("overwrite").parquet(f"{path}/{PART}{generation}")
