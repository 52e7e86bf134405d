"""Vector queries over ``embeddings``: labels 0-1 are defaults, 2-4 one role group, 5-7 the contrast, 8-9 neutral; four revisions by vec_id % 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import vectors as V
from driftloom.operators import geometry as G
from driftloom.operators import stats as S
from driftloom.session import table

FINAL = 3


def _default():
    return F.col("label").isin(0, 1)


def _contrast():
    return F.col("label").isin(5, 6, 7)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", V.as_double("embedding").alias("v"), (F.col("vec_id") % 20).alias("question_id"), (F.col("vec_id") % 4).cast("int").alias("step"), F.floor(F.col("vec_id") / 10).alias("seq"), (F.col("vec_id") % 10).alias("pos"))


def _long(df: DataFrame, keys: list[str], vec: str, value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("pos", "_x")).select(*keys, (F.col("pos") + 1).alias("pos"), F.round("_x", 6).alias(value))


def _axis(rows: DataFrame) -> DataFrame:
    return G.contrast(rows, [], "v", _default(), _contrast())


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its projections on the one axis."""
    rows = _vectors(spark, sf_dir)
    axis = _axis(rows)
    joined = rows.crossJoin(F.broadcast(axis))  # one row
    return joined.withColumn("raw", V.dot(F.col("v"), F.col("axis"))).withColumn("centred", F.col("raw") - V.dot(F.col("midpoint"), F.col("axis")))


def unit_vector(spark, sf_dir):
    return _long(_vectors(spark, sf_dir).select("vec_id", V.unit(F.col("v")).alias("u")), ["vec_id"], "u")


def vector_shape_check(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct(F.size("v")).alias("shapes"), F.min(F.size("v")).alias("dimension"), F.count_if(F.exists("v", lambda x: F.isnan(x) | x.isNull())).alias("bad"))


def dot_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", F.round("raw", 6).alias("dot"))


def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", F.round(V.cosine(F.col("v"), F.col("axis")), 6).alias("cosine"))


def group_mean_vectors(spark, sf_dir):
    return _long(G.mean_vectors(_vectors(spark, sf_dir), ["label"], "v"), ["label", "n"], "mean")


def axis_contrast(spark, sf_dir):
    return _long(_axis(_vectors(spark, sf_dir)).select(F.round("raw_norm", 6).alias("raw_norm"), "axis"), ["raw_norm"], "axis")


def axis_split(spark, sf_dir):
    """The axis from construction questions (< 10) and from evaluation questions, with the cosine of both."""
    rows = _vectors(spark, sf_dir).withColumn("split", F.when(F.col("question_id") < 10, "construction").otherwise("evaluation"))
    axes = G.contrast(rows, ["split"], "v", _default(), _contrast())
    pair = axes.agg(F.max(F.when(F.col("split") == "construction", F.col("axis"))).alias("a"), F.max(F.when(F.col("split") == "evaluation", F.col("axis"))).alias("b"))
    both = axes.select("split", F.round("raw_norm", 6).alias("raw_norm")).crossJoin(F.broadcast(pair))  # one row
    return both.select("split", "raw_norm", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("cosine"))


def _axes_by_step(rows: DataFrame) -> DataFrame:
    return G.contrast(rows, ["step"], "v", _default(), _contrast())


def innovation(spark, sf_dir):
    """What the axis of the final revision has beyond that of the first: unit(e - (e.n) n)."""
    axes = _axes_by_step(_vectors(spark, sf_dir))
    pair = axes.agg(F.max(F.when(F.col("step") == FINAL, F.col("axis"))).alias("e"), F.max(F.when(F.col("step") == 0, F.col("axis"))).alias("n"))
    rest = pair.withColumn("r", V.residual(F.col("e"), F.col("n")))
    rows = rest.select(F.round(V.dot(F.col("e"), F.col("n")), 6).alias("along"), F.round(V.norm(F.col("r")), 6).alias("residual_norm"), F.when(V.norm(F.col("r")) > 1e-8, V.unit(F.col("r"))).alias("u"))
    return _long(rows, ["along", "residual_norm"], "u")


def pairwise_cosine(spark, sf_dir):
    """Cosines of the four revisions' axes, each pair once."""
    axes = _axes_by_step(_vectors(spark, sf_dir)).select("step", "axis")
    a, b = axes.alias("a"), axes.alias("b")
    met = a.join(F.broadcast(b), F.col("a.step") < F.col("b.step"))  # one row per revision
    return met.select(F.col("a.step").alias("step_a"), F.col("b.step").alias("step_b"), F.round(V.dot(F.col("a.axis"), F.col("b.axis")), 6).alias("cosine"))


def _summary(rows: DataFrame, score: str, k: int = 4) -> DataFrame:
    x = F.col(score)
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.avg(x), 6).alias("mean"), F.round(F.max(x), 6).alias("max"), F.round(S.top_mean(x, k), 6).alias("top_mean"), F.round(S.positive_share(x), 6).alias("positive_share"))


def vector_filter(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    norms = rows.groupBy("seq").agg(F.round(F.avg(V.norm(F.col("v"))), 6).alias("mean_norm"))
    return _summary(rows, "raw").join(norms, "seq")


def projection_summary(spark, sf_dir):
    return _summary(_scored(spark, sf_dir), "raw")


def centered_projection(spark, sf_dir):
    return _summary(_scored(spark, sf_dir), "centred")


def span_mean_pool(spark, sf_dir):
    """Mean vector of positions 2 to 6 of each sequence."""
    rows = _vectors(spark, sf_dir).where((F.col("pos") >= 2) & (F.col("pos") < 7))
    return _long(G.mean_vectors(rows, ["seq"], "v"), ["seq", "n"], "mean")


def group_loadings(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    loads = G.loadings(rows, [], "label", "v", _axis(rows).select("axis")).withColumn("loading", F.round("loading", 6))
    return loads.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("loading").desc(), "label"))).select("label", "n", "loading", "rank")  # one row per label


def update_pressure(spark, sf_dir):
    """u = minus the mean of a sequence's gradients, with its norm and dot with the axis."""
    rows = _vectors(spark, sf_dir)
    u = G.mean_vectors(rows, ["seq"], "v").withColumn("u", V.scaled(F.col("mean"), F.lit(-1.0)))
    scored = u.crossJoin(F.broadcast(_axis(rows).select("axis")))  # one row
    return scored.select("seq", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(V.dot(F.col("u"), F.col("axis")), 6).alias("dot"), F.round(V.cosine(F.col("u"), F.col("axis")), 6).alias("cosine"))


def token_diagnostics(spark, sf_dir):
    q = S.quantiles(F.col("raw"), [0.1, 0.5, 0.9])
    x = F.col("raw")
    rows = _scored(spark, sf_dir).groupBy("seq").agg(F.count(x).alias("count"), F.avg(x).alias("mean"), S.deviation(x).alias("std"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"), S.positive_share(x).alias("positive_share"))
    values = {"mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "p10": F.col("q")[0], "median": F.col("q")[1], "p90": F.col("q")[2], "max": F.col("max"), "positive_share": F.col("positive_share")}
    return rows.select("seq", "count", *(F.round(c, 6).alias(n) for n, c in values.items()))


def streamed_dot(spark, sf_dir):
    """-dot(g, q) and the cosine of a sequence's summed gradient with a query, added up over parameter blocks of 16 elements."""
    rows = _vectors(spark, sf_dir)
    query = rows.where(F.col("vec_id") == 0).select(F.col("v").alias("q")).limit(1)
    sums = G.sum_vectors(rows, ["seq"], "v", "g")
    blocks = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(16)), lambda i: F.slice(v, i, F.lit(16)))
    added = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    g, q = blocks(F.col("g")), blocks(F.col("q"))
    dots = lambda a, b: added(F.zip_with(a, b, V.dot))
    whole = sums.crossJoin(F.broadcast(query)).select("seq", (-dots(g, q)).alias("d"), F.sqrt(dots(g, g)).alias("g"), F.sqrt(dots(q, q)).alias("q"))  # one vector
    return whole.select("seq", F.round("d", 6).alias("negative_dot"), F.round("g", 6).alias("gradient_norm"), F.round(F.when(F.col("g") * F.col("q") > 0, F.col("d") / (F.col("g") * F.col("q"))), 6).alias("cosine"))


def signed_weighted_mean(spark, sf_dir):
    """Sum of +v/n over defaults and -v/n over the contrast, per element."""
    rows = _vectors(spark, sf_dir)
    counts = rows.agg(F.count_if(_default()).alias("nd"), F.count_if(_contrast()).alias("nc"))  # one row
    weighted = rows.where(_default() | _contrast()).crossJoin(F.broadcast(counts)).withColumn("w", F.when(_default(), 1.0 / F.col("nd")).otherwise(-1.0 / F.col("nc")))
    return weighted.select("w", F.posexplode("v").alias("pos", "x")).groupBy((F.col("pos") + 1).alias("pos")).agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("value"))


def component_split(spark, sf_dir):
    """Each vector's parts along and across the axis, and the norm of the vector with the part along it halved."""
    rows = _scored(spark, sf_dir)
    across = V.residual(F.col("v"), F.col("axis"))
    half = F.zip_with(F.col("across"), F.col("axis"), lambda x, a: x + 0.5 * F.col("raw") * a)
    return rows.withColumn("across", across).select("vec_id", F.round("raw", 6).alias("along"), F.round(V.norm(F.col("across")), 6).alias("across_norm"), F.round(V.norm(half), 6).alias("half_norm"))


def finite_guard(spark, sf_dir):
    """Per score of gradient_scores: values, missing, NaN, infinite and finite."""
    g = table(spark, sf_dir, "gradient_scores")
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in ("loss", "local_aa_score", "primary_axis_dot_score", "gradient_norm")))
    long = g.select(F.explode(pairs).alias("p")).select("p.*")
    x = F.col("x")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.count_if(V.is_finite(x)).alias("finite"))


def _loadings_by_step(rows: DataFrame) -> DataFrame:
    return G.loadings(rows, ["step"], "label", "v", _axes_by_step(rows).select("step", "axis"))


def loading_corr(spark, sf_dir):
    """Correlation of each revision's loadings with the final ones, over the labels both have."""
    loads = _loadings_by_step(_vectors(spark, sf_dir))
    final = loads.where(F.col("step") == FINAL).select("label", F.col("loading").alias("final"))
    return loads.join(final, "label").groupBy("step").agg(F.round(S.pearson(F.col("loading"), F.col("final")), 6).alias("corr"))


def _trajectory(rows: DataFrame) -> DataFrame:
    axes = _axes_by_step(rows).select("step", "axis")
    final = axes.where(F.col("step") == FINAL).select(F.col("axis").alias("final"))  # one row
    by = Window.orderBy(F.col("step").asc_nulls_first())  # one row per revision
    cos = axes.crossJoin(F.broadcast(final)).withColumn("before", F.lag("axis").over(by))
    cos = cos.select("step", V.cosine(F.col("axis"), F.col("final")).alias("final_cosine"), F.when(F.col("before").isNotNull(), V.cosine(F.col("axis"), F.col("before"))).alias("adjacent_cosine"))
    loads = _loadings_by_step(rows).select("step", "label", "loading")
    to_final = loads.join(loads.where(F.col("step") == FINAL).select("label", F.col("loading").alias("other")), "label").groupBy("step").agg(S.pearson(F.col("loading"), F.col("other")).alias("final_corr"))
    before = loads.withColumn("other", F.lag("loading").over(Window.partitionBy("label").orderBy("step")))
    adjacent = before.where(F.col("step") > 0).groupBy("step").agg(S.pearson(F.col("loading"), F.col("other")).alias("adjacent_corr"))
    return cos.join(to_final, "step", "left").join(adjacent, "step", "left")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in df.columns if c not in keys))


def trajectory(spark, sf_dir):
    return _rounded(_trajectory(_vectors(spark, sf_dir)), "step")


def transition_scores(spark, sf_dir):
    """(1 - adjacent cosine) + (1 - adjacent correlation) + |change of the cosine to the final axis|; missing terms add nothing."""
    t = _trajectory(_vectors(spark, sf_dir))
    by = Window.orderBy("step")  # one row per revision
    t = t.withColumn("from_step", F.lag("step").over(by)).withColumn("delta", F.col("final_cosine") - F.lag("final_cosine").over(by)).where("from_step IS NOT NULL")
    score = F.coalesce(1 - F.col("adjacent_cosine"), F.lit(0.0)) + F.coalesce(1 - F.col("adjacent_corr"), F.lit(0.0)) + F.coalesce(F.abs("delta"), F.lit(0.0))
    return t.select("from_step", F.col("step").alias("to_step"), F.round(score, 6).alias("score"), F.round("delta", 6).alias("delta"))


def moving_groups(spark, sf_dir):
    """Roles' labels (all but the defaults) whose loading moved most between the first and the final revision."""
    loads = _loadings_by_step(_vectors(spark, sf_dir)).where(~_default())
    first = loads.where(F.col("step") == 0).select("label", F.col("loading").alias("first_loading"))
    last = loads.where(F.col("step") == FINAL).select("label", F.col("loading").alias("final_loading"))
    rows = first.join(last, "label").withColumn("delta", F.round(F.col("final_loading") - F.col("first_loading"), 6))
    return rows.orderBy(F.abs("delta").desc(), "label").limit(5).select("label", F.round("first_loading", 6).alias("first_loading"), F.round("final_loading", 6).alias("final_loading"), "delta")


def trajectory_plot_data(spark, sf_dir):
    return _rounded(_trajectory(_vectors(spark, sf_dir)).select("step", F.log2(F.col("step") + 1).alias("x"), F.col("final_cosine").alias("y")), "step")


def role_pc1(spark, sf_dir):
    """First component of the centred label means, turned to the axis: share of variance, cosine with the axis, loadings' norm."""
    rows = _vectors(spark, sf_dir)
    means = G.mean_vectors(rows, ["label"], "v")
    pc = G.principal_components(means, [], "mean", 1, _axis(rows).select("axis"))
    return pc.select("component", "n", F.round("evr", 6).alias("evr"), F.round("axis_cosine", 6).alias("axis_cosine"))


def pca_components(spark, sf_dir, components=3, centred=True):
    """Components of each label's vectors, three unless told."""
    rows = _vectors(spark, sf_dir)
    pc = G.principal_components(rows, ["label"], "v", components, _axis(rows).select("axis"), centred)
    return pc.select("label", "component", "n", "reason", F.round("evr", 6).alias("evr"), F.round("cumulative", 6).alias("cumulative"), F.round("axis_cosine", 6).alias("axis_cosine"))


def scope_rollup(spark, sf_dir):
    """Counts and mean projection per label and over all."""
    rows = _scored(spark, sf_dir).rollup("label").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("raw"), 6).alias("mean_dot"), F.grouping("label").alias("_all"))
    return rows.select(F.when(F.col("_all") == 1, "global").otherwise("label").alias("scope"), F.col("label").cast("string").alias("scope_id"), "records", "mean_dot")


def geometry_gate(spark, sf_dir, cosine=(0.30, 0.15), evr=(0.20, 0.10)):
    """Bands of the axis-PC1 cosine and PC1 share, and the gate that follows; complete if all ten labels have vectors."""
    rows = _vectors(spark, sf_dir)
    pc = role_pc1(spark, sf_dir).select("axis_cosine", "evr")
    complete = rows.agg((F.count_distinct("label") == 10).alias("complete"))  # one row each
    m = pc.crossJoin(complete)
    m = m.withColumn("cosine_band", S.band(F.col("axis_cosine"), *cosine)).withColumn("evr_band", S.band(F.col("evr"), *evr))
    bands = F.array("cosine_band", "evr_band")
    gate = F.when(~F.col("complete") | F.array_contains(bands, "fail"), "stop").when(F.array_contains(bands, "caution"), "caution").when((F.col("cosine_band") == "pass") & (F.col("evr_band") == "pass"), "proceed").otherwise("caution")
    return m.select("cosine_band", "evr_band", "complete", gate.alias("gate"))


QUERIES = {f.__name__: f for f in (
    unit_vector, vector_shape_check, dot_scores, cosine_scores, group_mean_vectors, axis_contrast, axis_split, innovation, pairwise_cosine, vector_filter, projection_summary, centered_projection, span_mean_pool, group_loadings,
    update_pressure, token_diagnostics, streamed_dot, signed_weighted_mean, component_split, finite_guard, loading_corr, trajectory, transition_scores, moving_groups, trajectory_plot_data, role_pc1, pca_components, scope_rollup, geometry_gate,
)}

_E = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id % 20 AS question_id, vec_id % 4 AS step, vec_id // 10 AS seq, vec_id % 10 AS pos FROM embeddings),
long AS (SELECT vec_id, label, question_id, step, seq, pos AS place, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
sides AS (SELECT i, avg(x) FILTER (label IN (0, 1)) AS d, avg(x) FILTER (label IN (5, 6, 7)) AS c FROM long GROUP BY i),
axis AS (SELECT list((d - c) / nrm ORDER BY i) AS a, list((d + c) / 2 ORDER BY i) AS mid, max(nrm) AS nrm FROM sides, (SELECT sqrt(sum((d - c) * (d - c))) AS nrm FROM sides)),
scored AS (SELECT e.*, a, list_inner_product(v, a) AS raw, list_inner_product(v, a) - list_inner_product(mid, a) AS centred FROM e, axis)
"""
_STEPS = _E + """,
step_sides AS (SELECT step, i, avg(x) FILTER (label IN (0, 1)) - avg(x) FILTER (label IN (5, 6, 7)) AS r FROM long GROUP BY step, i),
step_axis AS (SELECT step, list(r / nrm ORDER BY i) AS a FROM step_sides JOIN (SELECT step, sqrt(sum(r * r)) AS nrm FROM step_sides GROUP BY step) USING (step) GROUP BY step),
step_means AS (SELECT step, label, list(m ORDER BY i) AS m FROM (SELECT step, label, i, avg(x) AS m FROM long GROUP BY ALL) GROUP BY ALL),
loads AS (SELECT step, label, list_inner_product(m, a) / sqrt(list_inner_product(m, m)) AS loading FROM step_means JOIN step_axis USING (step)),
to_final AS (SELECT l.step, corr(l.loading, f.loading) AS final_corr FROM loads l JOIN (SELECT * FROM loads WHERE step = 3) f USING (label) GROUP BY 1),
adjacent AS (SELECT l.step, corr(l.loading, b.loading) AS adjacent_corr FROM loads l JOIN loads b ON l.label = b.label AND l.step = b.step + 1 GROUP BY 1),
traj AS (
  SELECT s.step, list_inner_product(s.a, f.a) AS final_cosine, list_inner_product(s.a, p.a) AS adjacent_cosine, final_corr, adjacent_corr
  FROM step_axis s JOIN (SELECT a FROM step_axis WHERE step = 3) f ON true LEFT JOIN step_axis p ON p.step = s.step - 1 LEFT JOIN to_final t ON t.step = s.step LEFT JOIN adjacent d ON d.step = s.step)
"""
_SUM = """SELECT seq, count(*) AS tokens, round(avg({x}), 6) AS mean, round(max({x}), 6) AS max, round(list_avg(list_slice(list_reverse_sort(list({x})), 1, 4)), 6) AS top_mean,
round(avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share{more} FROM scored GROUP BY seq"""

#: The first component of the centred label means by iterating their Gram matrix.
_PC1 = _E.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """,
lm AS (SELECT label, i, avg(x) AS x FROM long GROUP BY ALL), ctr AS (SELECT label, list(x - c ORDER BY i) AS v FROM (SELECT label, i, x, avg(x) OVER (PARTITION BY i) AS c FROM lm) GROUP BY label),
gr AS (SELECT list(g ORDER BY label) AS g, max(n) AS n, sum(own) AS trace FROM (SELECT p.label, list(list_inner_product(p.v, q.v) ORDER BY q.label) AS g, count(*) AS n, max(list_inner_product(p.v, p.v)) AS own FROM ctr p, ctr q GROUP BY p.label)),
iter AS (SELECT 0 AS k, list_transform(range(n), lambda x: 1.0::DOUBLE + x * x) AS u FROM gr
  UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT k, list_transform(g, lambda r: list_inner_product(r, u)) AS w FROM iter, gr WHERE k < 400)),
top AS (SELECT u, list_inner_product(u, list_transform(g, lambda r: list_inner_product(r, u))) AS energy, trace, n FROM iter, gr WHERE k = 400),
along AS (SELECT list(list_inner_product(v, a) ORDER BY label) AS d FROM ctr, axis),
pc AS (SELECT n, energy / trace AS evr, abs(list_inner_product(u, d)) / sqrt(energy) AS axis_cosine FROM top, along)
"""

ORACLE = {
    "unit_vector": _E + "SELECT vec_id, i AS pos, round(x / nrm, 6) AS value FROM long JOIN (SELECT vec_id, sqrt(list_inner_product(v, v)) AS nrm FROM e) USING (vec_id)",
    "vector_shape_check": _E + "SELECT count(*) AS vectors, count(DISTINCT len(v)) AS shapes, min(len(v)) AS dimension, count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x))) > 0) AS bad FROM e",
    "dot_scores": _E + "SELECT vec_id, label, round(raw, 6) AS dot FROM scored",
    "cosine_scores": _E + "SELECT vec_id, round(raw / sqrt(list_inner_product(v, v) * list_inner_product(a, a)), 6) AS cosine FROM scored",
    "group_mean_vectors": _E + "SELECT label, count(*) AS n, i AS pos, round(avg(x), 6) AS value FROM long GROUP BY label, i",
    "axis_contrast": _E + "SELECT round(nrm, 6) AS raw_norm, generate_subscripts(a, 1) AS pos, round(unnest(a), 6) AS value FROM axis",
    "axis_split": _E + """, s2 AS (SELECT CASE WHEN question_id < 10 THEN 'construction' ELSE 'evaluation' END AS split, i, avg(x) FILTER (label IN (0, 1)) - avg(x) FILTER (label IN (5, 6, 7)) AS r FROM long GROUP BY ALL),
n2 AS (SELECT split, sqrt(sum(r * r)) AS nrm FROM s2 GROUP BY split)
SELECT split, round(nrm, 6) AS raw_norm, round((SELECT sum(p.r * q.r) FROM s2 p JOIN s2 q USING (i) WHERE p.split = 'construction' AND q.split = 'evaluation') / (SELECT product(nrm) FROM n2), 6) AS cosine FROM n2""",
    "innovation": _STEPS + """, p AS (SELECT e.a AS e, n.a AS n, list_inner_product(e.a, n.a) AS along FROM step_axis e, step_axis n WHERE e.step = 3 AND n.step = 0),
r AS (SELECT along, generate_subscripts(e, 1) AS i, unnest(e) - along * unnest(n) AS x FROM p)
SELECT round(along, 6) AS along, round(nrm, 6) AS residual_norm, i AS pos, round(x / nrm, 6) AS value FROM r, (SELECT sqrt(sum(x * x)) AS nrm FROM r)""",
    "pairwise_cosine": _STEPS + "SELECT a.step AS step_a, b.step AS step_b, round(list_inner_product(a.a, b.a), 6) AS cosine FROM step_axis a JOIN step_axis b ON a.step < b.step",
    "vector_filter": _E + _SUM.format(x="raw", more=", round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm"),
    "projection_summary": _E + _SUM.format(x="raw", more=""),
    "centered_projection": _E + _SUM.format(x="centred", more=""),
    "span_mean_pool": _E + "SELECT seq, count(*) AS n, i AS pos, round(avg(x), 6) AS value FROM long WHERE place BETWEEN 2 AND 6 GROUP BY seq, i",
    "group_loadings": _E + """, m AS (SELECT label, list(m ORDER BY i) AS m, max(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM long GROUP BY ALL) GROUP BY label),
l AS (SELECT label, n, round(list_inner_product(m, a) / sqrt(list_inner_product(m, m)), 6) AS loading FROM m, axis) SELECT *, row_number() OVER (ORDER BY abs(loading) DESC, label) AS rank FROM l""",
    "update_pressure": _E + """, u AS (SELECT seq, list(-m ORDER BY i) AS u FROM (SELECT seq, i, avg(x) AS m FROM long GROUP BY ALL) GROUP BY seq)
SELECT seq, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(list_inner_product(u, a), 6) AS dot, round(list_inner_product(u, a) / sqrt(list_inner_product(u, u) * list_inner_product(a, a)), 6) AS cosine FROM u, axis""",
    "token_diagnostics": _E + """SELECT seq, count(*) AS count, round(avg(raw), 6) AS mean, round(coalesce(stddev_samp(raw), 0), 6) AS std, round(min(raw), 6) AS min, round(quantile_cont(raw, 0.1), 6) AS p10,
round(quantile_cont(raw, 0.5), 6) AS median, round(quantile_cont(raw, 0.9), 6) AS p90, round(max(raw), 6) AS max, round(avg(CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share FROM scored GROUP BY seq""",
    "streamed_dot": _E + """, g AS (SELECT seq, i, sum(x) AS g FROM long GROUP BY ALL), q AS (SELECT i, x AS q FROM long WHERE vec_id = 0),
t AS (SELECT seq, sum(-g * q) AS d, sqrt(sum(g * g)) AS gn, sqrt(sum(q * q)) AS qn FROM g JOIN q USING (i) GROUP BY seq)
SELECT seq, round(d, 6) AS negative_dot, round(gn, 6) AS gradient_norm, round(d / (gn * qn), 6) AS cosine FROM t""",
    "signed_weighted_mean": _E + "SELECT i AS pos, round(d - c, 6) AS value FROM sides",
    "component_split": _E + """SELECT vec_id, round(raw, 6) AS along, round(sqrt(greatest(list_inner_product(v, v) - raw * raw, 0)), 6) AS across_norm,
round(sqrt(greatest(list_inner_product(v, v) - 0.75::DOUBLE * raw * raw, 0)), 6) AS half_norm FROM scored""",
    "finite_guard": "\nUNION ALL\n".join(f"SELECT '{c}' AS metric, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infinite, count(*) FILTER (isfinite({c})) AS finite FROM gradient_scores" for c in ("loss", "local_aa_score", "primary_axis_dot_score", "gradient_norm")),
    "loading_corr": _STEPS + "SELECT step, round(final_corr, 6) AS corr FROM to_final",
    "trajectory": _STEPS + "SELECT step, round(final_cosine, 6) AS final_cosine, round(adjacent_cosine, 6) AS adjacent_cosine, round(final_corr, 6) AS final_corr, round(adjacent_corr, 6) AS adjacent_corr FROM traj",
    "transition_scores": _STEPS + """SELECT t.step - 1 AS from_step, t.step AS to_step, round(coalesce(1 - t.adjacent_cosine, 0) + coalesce(1 - t.adjacent_corr, 0) + coalesce(abs(t.final_cosine - b.final_cosine), 0), 6) AS score,
round(t.final_cosine - b.final_cosine, 6) AS delta FROM traj t JOIN traj b ON b.step = t.step - 1""",
    "moving_groups": _STEPS + """SELECT label, round(f.loading, 6) AS first_loading, round(l.loading, 6) AS final_loading, round(l.loading - f.loading, 6) AS delta
FROM (SELECT * FROM loads WHERE step = 0) f JOIN (SELECT * FROM loads WHERE step = 3) l USING (label) WHERE label NOT IN (0, 1) ORDER BY abs(round(l.loading - f.loading, 6)) DESC, label LIMIT 5""",
    "trajectory_plot_data": _STEPS + "SELECT step, round(log2(step + 1), 6) AS x, round(final_cosine, 6) AS y FROM traj",
    "role_pc1": _PC1 + "SELECT 1 AS component, n, round(evr, 6) AS evr, round(axis_cosine, 6) AS axis_cosine FROM pc",
    "geometry_gate": _PC1 + """, b AS (SELECT CASE WHEN axis_cosine >= 0.30 THEN 'pass' WHEN axis_cosine >= 0.15 THEN 'caution' ELSE 'fail' END AS cosine_band, CASE WHEN evr >= 0.20 THEN 'pass' WHEN evr >= 0.10 THEN 'caution' ELSE 'fail' END AS evr_band, n = 10 AS complete FROM pc)
SELECT cosine_band, evr_band, complete, CASE WHEN NOT complete OR 'fail' IN (cosine_band, evr_band) THEN 'stop' WHEN 'caution' IN (cosine_band, evr_band) THEN 'caution' ELSE 'proceed' END AS gate FROM b""",
    "scope_rollup": _E + "SELECT CASE WHEN grouping(label) = 1 THEN 'global' ELSE 'label' END AS scope, CAST(label AS VARCHAR) AS scope_id, count(*) AS records, round(avg(raw), 6) AS mean_dot FROM scored GROUP BY ROLLUP (label)",
}
