import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import vectors as V
from driftloom.operators import geometry as G
from driftloom.operators import stats as S


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(V.dot(a, b).alias("d"), V.norm(a).alias("n"), V.unit(b).alias("u"), V.cosine(a, b).alias("c"), V.residual(b, V.unit(a)).alias("r")).collect()
    assert rows[0].n == 5 and rows[0].u is None and math.isnan(rows[0].c)
    assert rows[1].d == 1 and abs(rows[1].c - 2**-0.5) < 1e-12 and rows[1].r == [0.0, 1.0]


def test_axis_and_loadings_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(60, 5)), np.arange(60) % 4
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(g, x)] + [(0, None)], "g int, v array<double>").repartition(5)
    row = G.contrast(df, [], "v", F.col("g") == 0, F.col("g").isin(1, 2)).first()
    raw = x[g == 0].mean(0) - x[(g == 1) | (g == 2)].mean(0)
    assert np.allclose(row.axis, raw / np.linalg.norm(raw)) and abs(row.raw_norm - np.linalg.norm(raw)) < 1e-12
    axis = G.contrast(df, [], "v", F.col("g") == 0, F.col("g").isin(1, 2)).select("axis")
    for r in G.loadings(df, [], "g", "v", axis).collect():
        m = x[g == r.g].mean(0)
        assert abs(r.loading - m @ row.axis / np.linalg.norm(m)) < 1e-12
    assert G.contrast(df, [], "v", F.col("g") == 9, F.col("g") == 1).count() == 0


@pytest.mark.parametrize("centred", [True, False])
def test_components_equal_svd_and_do_not_depend_on_layout(spark, centred):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) + 2
    rows = [("a", v.tolist()) for v in x] + [("one", [1.0] * 6)] + [("same", [2.0] * 6)] * 3 + [(None, v.tolist()) for v in x[:5]]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    axis = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0, 0.0, 0.0],)], "axis array<double>")
    got = [G.principal_components(d, ["k"], "v", 3, axis, centred).orderBy("k", "component").collect() for d in (df, df.repartition(7))]
    y = x - x.mean(0) if centred else x
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    for rows_ in got:
        own = [r for r in rows_ if r.k == "a"]
        assert np.allclose([r.evr for r in own], (s**2 / (s**2).sum())[:3]) and all(r.axis_cosine >= 0 for r in own)
        assert all(abs(abs(np.dot(r.direction, vt[i])) - 1) < 1e-8 for i, r in enumerate(own))
        assert next(r for r in rows_ if r.k == "one").reason == "too_few_records"
        if centred:
            assert next(r for r in rows_ if r.k == "same").reason == "zero_variance"
        assert len([r for r in rows_ if r.k is None]) == 3


def test_statistics_rules(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0 * i) for i in range(4)], "x double, c double, y double")
    x = F.col("x")
    r = df.agg(S.upper_median(x).alias("u"), S.true_median(x).alias("t"), S.quantiles(x, [0.1, 0.5, 0.9]).alias("q"), S.deviation(x).alias("s"), S.pearson(x, F.col("c")).alias("p"), S.pearson(x, F.col("y")).alias("p1"), S.top_mean(x, 2).alias("m"), S.positive_share(x).alias("f")).first()
    assert (r.u, r.t) == (2.0, 1.5) and np.allclose(r.q, [0.3, 1.5, 2.7]) and abs(r.s - 1.2909944) < 1e-6
    assert r.p is None and abs(r.p1 - 1) < 1e-12 and r.m == 2.5 and r.f == 0.75
    one = df.limit(1).agg(S.deviation(x).alias("s"), S.pearson(x, x).alias("p")).first()
    assert one.s == 0.0 and one.p is None
    none = df.limit(0).agg(S.deviation(x).alias("s")).first()
    assert none.s is None
    bands = df.select(S.band(F.lit(0.9226), 0.30, 0.15).alias("a"), S.band(F.lit(0.20), 0.30, 0.15).alias("b"), S.band(F.lit(0.10), 0.30, 0.15).alias("c"), S.band(F.lit(None).cast("double"), 0.3, 0.1).alias("d")).first()
    assert tuple(bands) == ("pass", "caution", "fail", "missing")


def test_published_transition_score():
    """Step 1000 to 2000 of the published dense table."""
    score = (1 - 0.6231) + (1 - 0.7484) + (1 - 0.9852) + abs(0.8882 - 0.8715) + abs(0.4216 - 0.4794)
    assert abs(score - 0.7177) < 2e-4


def test_order_statistics_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([0.0, -0.0, 1.0, -1.0, rng.gauss(0, 1), rng.lognormvariate(0, 9), -rng.lognormvariate(0, 9), 5e-310])) for _ in range(600)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for f in (0.0, 0.25, 0.5, 1.0):
        got = {r.k: r.v for r in S.value_at(df, ["k"], "v", f).collect()}
        assert got == {k: (x := sorted(v for g, v in rows if g == k))[min(int(len(x) * f), len(x) - 1)] for k in ("a", "b", "one")}
    ranked = S.average_ranks(df, ["k"], "v", "r").collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        own = [v for g, v in rows if g == r.k]
        assert r.r == sum(v < r.v for v in own) + (sum(v == r.v for v in own) + 1) / 2
    assert S.value_at(df.limit(0), ["k"], "v", 0.5).count() == 0


def test_order_statistics_of_values_that_lie_close_together(spark):
    import random

    rng = random.Random(4)
    rows = [("a", 0.999999 + rng.randrange(5000) * 1e-10) for _ in range(3000)] + [("b", 1e15 + i % 700) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    _, hist = S._cells(df, ["k"], "v")
    assert hist.select("k", "_cell").distinct().count() == 2 and hist.agg({"_in": "max"}).first()[0] < 30
    for f in (0.0, 0.5, 0.9):
        assert {r.k: r.v for r in S.value_at(df, ["k"], "v", f).collect()} == {k: sorted(v for g, v in rows if g == k)[int(n * f)] for k, n in (("a", 3000), ("b", 1500))}


def test_components_do_not_depend_on_when_matrices_are_handed_on(spark, monkeypatch):
    from driftloom.operators import geometry

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "k int, v array<double>")
    whole = sorted((r.k, r.component, round(r.evr, 9)) for r in geometry.principal_components(df, ["k"], "v", 2).collect())
    monkeypatch.setattr(geometry, "HELD", 1)
    assert sorted((r.k, r.component, round(r.evr, 9)) for r in geometry.principal_components(df, ["k"], "v", 2).collect()) == whole
