"""Bundles of named target vectors: built from axes, loaded by name, and scored against vectors.

A bundle is a table (axis_name, kind, vector, raw_norm, dimension, records): one row per target, as many as the configuration names. Loading brings the
vectors to unit length and raises an error where a wanted name is missing or a vector has no finite positive norm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vectors as V


def metadata(name: Column, kind: str, vector: Column, raw_norm: Column) -> list[Column]:
    """The columns that describe a target."""
    return [name.alias("axis_name"), F.lit(kind).alias("kind"), vector.alias("vector"), raw_norm.alias("raw_norm"), F.size(vector).alias("dimension")]


def bundle(axes: DataFrame, name: str, endpoint: str, native: str) -> DataFrame:
    """The given axes (``name``, axis, raw_norm), and the innovation of the endpoint's axis over the native one; both are single axes of the table."""
    own = axes.select(*metadata(F.col(name), "axis", F.col("axis"), F.col("raw_norm")))
    pair = axes.agg(F.max(F.when(F.col(name) == endpoint, F.col("axis"))).alias("e"), F.max(F.when(F.col(name) == native, F.col("axis"))).alias("n"))
    rest = pair.where("e IS NOT NULL AND n IS NOT NULL").withColumn("r", V.residual(F.col("e"), F.col("n")))
    rest = rest.where(V.norm(F.col("r")) > 1e-8)
    return own.unionByName(rest.select(*metadata(F.lit("innovation"), "innovation", V.unit(F.col("r")), V.norm(F.col("r")))))


def load(targets: DataFrame, names: Sequence[str]) -> DataFrame:
    """(axis_name, axis) of the wanted targets, of unit length."""
    rows = targets.where(F.col("axis_name").isin(*names)).select("axis_name", V.unit(F.col("vector")).alias("axis"))
    have = {r.axis_name: r.ok for r in rows.select("axis_name", F.col("axis").isNotNull().alias("ok")).collect()}  # one row per target
    missing = sorted(set(names) - set(have))
    if missing:
        raise ValueError(f"the bundle has no targets {missing}")
    if not all(have.values()):
        raise ValueError(f"invalid target vectors: {sorted(k for k, ok in have.items() if not ok)}")
    return rows


def projected(rows: DataFrame, vec: str, axes: DataFrame) -> DataFrame:
    """Every row with every axis: the rows with axis_name and raw, the projection. The axes are one row per target of the configuration."""
    return rows.crossJoin(F.broadcast(axes)).withColumn("raw", V.dot(F.col(vec), F.col("axis"))).drop("axis")
