"""Group means, contrast axes, loadings and principal components.

Means and scatter matrices are sums, so they are partially aggregated: a group is never gathered, whatever its size. Only matrices of the
vectors' own dimension reach Python for the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import vectors as V


#: Bytes of matrices that a task holds before it hands them on.
HELD = 1 << 27


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str, out: str = "mean") -> DataFrame:
    """(keys, n, mean). Null vectors are left out; a group without vectors has no row."""
    rows = df.where(F.col(vec).isNotNull()).select(*keys, array_to_vector(V.as_double(vec)).alias("_v"))
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m")).where("n > 0").select(*keys, "n", vector_to_array("_m").alias(out))


def sum_vectors(df: DataFrame, keys: Sequence[str], vec: str, out: str = "sum") -> DataFrame:
    """(keys, sum), added up partially; null vectors are left out."""
    rows = df.where(F.col(vec).isNotNull()).select(*keys, array_to_vector(V.as_double(vec)).alias("_v"))
    return rows.groupBy(*keys).agg(Summarizer.sum(F.col("_v")).alias("_s")).select(*keys, vector_to_array("_s").alias(out))


def contrast(df: DataFrame, keys: Sequence[str], vec: str, default: Column, other: Column) -> DataFrame:
    """(keys, axis, raw_norm, midpoint): the unit difference of both sides' means. Keys where a side is empty or the norm is 0 have no row."""
    side = F.when(default, "default").when(other, "contrast")
    means = mean_vectors(df.withColumn("_side", side).where(F.col("_side").isNotNull()), [*keys, "_side"], vec)
    sides = means.groupBy(*keys).agg(F.max(F.when(F.col("_side") == "default", F.col("mean"))).alias("d"), F.max(F.when(F.col("_side") == "contrast", F.col("mean"))).alias("c"))
    raw = V.minus(F.col("d"), F.col("c"))
    rows = sides.where("d IS NOT NULL AND c IS NOT NULL").select(*keys, raw.alias("raw"), F.zip_with("d", "c", lambda x, y: (x + y) / 2).alias("midpoint"))
    return rows.select(*keys, V.unit(F.col("raw")).alias("axis"), V.norm(F.col("raw")).alias("raw_norm"), "midpoint").where("axis IS NOT NULL")


def loadings(df: DataFrame, keys: Sequence[str], group: str, vec: str, axis: DataFrame) -> DataFrame:
    """(keys, group, n, loading): dot of each unit group mean with the axis of its keys."""
    means = mean_vectors(df, [*keys, group], vec)
    joined = means.join(axis, list(keys)) if keys else means.crossJoin(F.broadcast(axis))  # one axis
    return joined.select(*keys, group, "n", V.dot(V.unit(F.col("mean")), F.col("axis")).alias("loading"))


def scatter(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys, flat): per key the flattened sums [n, sum of x, sum of x x'], added up over tasks in the JVM."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        out = lambda: pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, "flat"])
        for pdf in frames:
            if sum(v.nbytes for v in held.values()) > HELD:
                yield out()
                held.clear()
            for key, own in pdf.groupby(list(keys), dropna=False) if keys else [((), pdf)]:
                x = np.stack(own["v"].to_numpy()).astype(float)
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                held[key] = held[key] + flat if key in held else flat
        yield out()

    rows = df.where(F.col(vec).isNotNull()).select(*keys, V.as_double(vec).alias("v"))
    types = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    partial = rows.mapInPandas(run, types + "flat array<double>").select(*keys, array_to_vector("flat").alias("flat"))
    return partial.groupBy(*keys).agg(Summarizer.sum(F.col("flat")).alias("flat")).select(*keys, vector_to_array("flat").alias("flat"))


def decompose(flat: np.ndarray, centred: bool, components: int) -> tuple[str, int, np.ndarray, np.ndarray]:
    """(skip reason or '', n, energies, directions) of summed scatter; energies over all directions, greatest first."""
    dim = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, total, gram = int(round(flat[0])), flat[1 : dim + 1], flat[dim + 1 :].reshape(dim, dim)
    if n < 2:
        return "too_few_records", n, np.zeros(0), np.zeros((0, dim))
    if centred:
        gram = gram - np.outer(total, total) / n
    energy, direction = np.linalg.eigh((gram + gram.T) / 2)
    energy, direction = np.clip(energy[::-1], 0, None), direction[:, ::-1].T
    if not np.isfinite(energy).all():
        return "invalid_energy", n, np.zeros(0), np.zeros((0, dim))
    if energy.sum() <= 1e-18 * max(1.0, abs(np.trace(gram))) or energy.sum() <= 0:
        return "zero_variance", n, np.zeros(0), np.zeros((0, dim))
    k = min(components, n - centred, dim)
    return "", n, energy, direction[:k]


def principal_components(df: DataFrame, keys: Sequence[str], vec: str, components: int, axis: DataFrame | None = None, centred: bool = True) -> DataFrame:
    """One row per key and component, or one with a skip reason: (keys, component, n, reason, evr, cumulative, axis_cosine, direction).

    Directions are turned so that their cosine with the axis is not negative; without an axis their sign is that of their largest element."""
    sums = scatter(df, keys, vec)
    sums = sums.crossJoin(F.broadcast(axis.select(F.col("axis").alias("_axis")))) if axis is not None else sums.withColumn("_axis", F.lit(None).cast("array<double>"))  # one axis

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                key = [r[k] for k in keys]
                reason, n, energy, direction = decompose(np.asarray(r["flat"]), centred, components)
                if reason:
                    rows.append((*key, None, n, reason, None, None, None, None))
                    continue
                share, a = energy / energy.sum(), None if r["_axis"] is None else np.asarray(r["_axis"])
                for i, d in enumerate(direction):
                    c = None if a is None else float(d @ a / (np.linalg.norm(d) * np.linalg.norm(a)))
                    turn = -1.0 if (c if c is not None else d[np.argmax(np.abs(d))]) < 0 else 1.0
                    rows.append((*key, i + 1, n, "", float(share[i]), float(share[: i + 1].sum()), None if c is None else turn * c, list(turn * d)))
            yield pd.DataFrame(rows, columns=[*keys, "component", "n", "reason", "evr", "cumulative", "axis_cosine", "direction"])

    types = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return sums.mapInPandas(run, types + "component int, n long, reason string, evr double, cumulative double, axis_cosine double, direction array<double>")
