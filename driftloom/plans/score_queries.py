"""Score statistics, run comparisons and audits over ``gradient_scores``, ``rollouts`` and ``fixed_responses_validated``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions import vectors as V
from driftloom.operators import stats as S
from driftloom.session import cut, table

SCORES = ("local_aa_score", "primary_axis_dot_score", "loss")
TOLERANCE = 1e-3


def _scores(spark, sf_dir, *columns):
    """The wanted columns of each score row once; rows that share an identifier are equal."""
    return table(spark, sf_dir, "gradient_scores").select("score_id", *columns).distinct()


def _axis_rows(spark, sf_dir):
    """Score rows by axis name; a repeated score identifier counts once. Keys of a map are unique, so no axis counts twice in a row."""
    g = table(spark, sf_dir, "gradient_scores").groupBy("score_id").agg(F.any_value(F.struct("sample_id", "window_id", "checkpoint_revision", "layer", F.map_entries("axis_scores").alias("e"))).alias("x"))
    return g.select("score_id", "x.*").select("score_id", "sample_id", "window_id", "checkpoint_revision", "layer", F.explode("e").alias("e")).select("score_id", "sample_id", "window_id", "checkpoint_revision", "layer", F.col("e.key").alias("axis_name"), F.col("e.value").alias("score"))


def _r(**columns):
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def scalar_stats(spark, sf_dir):
    """Per layer: count, least, mean, upper median, greatest and deviation of the finite losses."""
    rows = _scores(spark, sf_dir, "layer", "loss").where(V.is_finite(F.col("loss")))
    x = F.col("loss")
    medians = S.value_at(rows, ["layer"], "loss", 0.5).withColumnRenamed("loss", "_median")
    rest = rows.groupBy("layer").agg(F.count(x).alias("count"), F.min(x).alias("least"), S.exact_mean(x).alias("mean"), F.max(x).alias("greatest"), S.deviation(x).alias("deviation"))
    return rest.join(medians, "layer").select("layer", "count", *_r(least=F.col("least"), mean=F.col("mean"), upper_median=F.col("_median"), greatest=F.col("greatest"), deviation=F.col("deviation")))


def _responses(spark, sf_dir, *columns):
    """The wanted columns of each response once: repeated rows are equal, so the key and these columns tell them apart."""
    return table(spark, sf_dir, "fixed_responses_validated").select("response_id", *columns).distinct()


def describe_median(spark, sf_dir):
    """Count, least, true median, mean and greatest response length per source; medians from counts of equal lengths."""
    v = _responses(spark, sf_dir, F.col("response_source.model").alias("model"), F.col("response_char_count").alias("x"))
    by = Window.partitionBy("model").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    lengths = v.groupBy("model", "x").agg(F.count("x").alias("n")).withColumn("upto", F.sum("n").over(by)).withColumn("all", F.sum("n").over(Window.partitionBy("model")))
    middle = F.when((F.col("upto") * 2 >= F.col("all")) & ((F.col("upto") - F.col("n")) * 2 <= F.col("all")) & (F.col("n") > 0), F.col("x"))
    x, n = F.col("x"), F.sum("n")
    return lengths.groupBy("model").agg(n.alias("count"), F.min(x).alias("least"), F.round((F.min(middle) + F.max(middle)) / 2, 6).alias("median"), F.round(F.sum(x * F.col("n")) / F.nullif(n, F.lit(0)), 6).alias("mean"), F.max(x).alias("greatest"))


def axis_summary(spark, sf_dir):
    rows = _axis_rows(spark, sf_dir).where(V.is_finite(F.col("score")))
    x = F.col("score")
    return rows.groupBy("axis_name").agg(F.count(x).alias("count"), *_r(least=F.min(x), mean=S.exact_mean(x), greatest=F.max(x), positive_share=S.positive_share(x)))


def window_score_summary(spark, sf_dir):
    """Per window and over all, for the finite cosines."""
    x = F.col("local_aa_score")
    rows = _scores(spark, sf_dir, "window_id", "local_aa_score").where(V.is_finite(x) & F.col("window_id").isNotNull())
    out = rows.cube("window_id").agg(F.count(x).alias("count"), *_r(least=F.min(x), mean=S.exact_mean(x), greatest=F.max(x), deviation=S.deviation(x)))
    return out.withColumn("window_id", F.coalesce("window_id", F.lit("(all)")))


def top_bottom(spark, sf_dir):
    """The 20 highest and the 20 lowest finite cosines, ties by identifier."""
    rows = _scores(spark, sf_dir, "local_aa_score").where(V.is_finite(F.col("local_aa_score")))
    top = rows.orderBy(F.col("local_aa_score").desc(), "score_id").limit(20).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy("local_aa_score", "score_id").limit(20).withColumn("side", F.lit("bottom")))


def _runs(spark, sf_dir):
    """Reference and candidate: the first and the last score of a sample, revision and layer, by axis."""
    rows = _axis_rows(spark, sf_dir).where(V.is_finite(F.col("score")) & F.col("sample_id").isNotNull())
    keys = ["sample_id", "checkpoint_revision", "layer", "axis_name"]
    return rows.groupBy(*keys).agg(F.min_by("score", "score_id").alias("reference"), F.max_by("score", "score_id").alias("candidate"), F.count(F.lit(1)).alias("runs"))


def score_agreement(spark, sf_dir, tolerance=TOLERANCE):
    """Agreement of both runs per axis over all keys that both have."""
    a, b = F.col("reference"), F.col("candidate")
    d = F.abs(b - a)
    rows = _runs(spark, sf_dir).groupBy("axis_name").agg(F.count(F.lit(1)).alias("records"), S.exact_mean(d).alias("mean_d"), F.max(d).alias("max_d"), F.sqrt(F.avg(d * d)).alias("rmse"), S.pearson(a, b).alias("pearson"), F.avg(((a >= 0) == (b >= 0)).cast("double")).alias("sign"), F.every(d <= tolerance).alias("passed"))
    return rows.select("axis_name", "records", *_r(mean_absolute_delta=F.col("mean_d"), max_absolute_delta=F.col("max_d"), rmse=F.col("rmse"), pearson=F.col("pearson"), sign_agreement=F.col("sign")), "passed")


def batch_invariance(spark, sf_dir, tolerance=TOLERANCE):
    """Reruns against first runs: per metric, greatest and mean difference and whether it is within the tolerance."""
    g = _scores(spark, sf_dir, "sample_id", "checkpoint_revision", "layer", *SCORES).where("sample_id IS NOT NULL")
    for c in SCORES:
        g = g.where(V.is_finite(F.col(c)))
    keys = ["sample_id", "checkpoint_revision", "layer"]
    both = g.groupBy(*keys).agg(*(F.abs(F.max_by(c, "score_id") - F.min_by(c, "score_id")).alias(c) for c in SCORES))
    long = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("d")) for c in SCORES))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("records"), *_r(max_delta=F.max("d"), mean_delta=S.exact_mean(F.col("d"))), F.every(F.col("d") <= tolerance).alias("passed"))


def method_comparison(spark, sf_dir):
    """Two scores of the same rows, per layer: Pearson, Spearman with average ranks, agreement of signs."""
    rows = _scores(spark, sf_dir, "layer", "local_aa_score", "primary_axis_dot_score").where(V.is_finite(F.col("local_aa_score")) & V.is_finite(F.col("primary_axis_dot_score"))).select("layer", "score_id", F.col("local_aa_score").alias("a"), F.col("primary_axis_dot_score").alias("b"))
    rows = S.average_ranks(cut(S.average_ranks(cut(rows), ["layer"], "a", "ra")), ["layer"], "b", "rb")
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("records"), *_r(pearson=S.pearson(a, b), spearman=S.pearson(F.col("ra"), F.col("rb")), sign_agreement=F.avg(((a >= 0) == (b >= 0)).cast("double"))))


#: The strata of an adaptive selection and how many samples each takes.
STRATA = (("concordant_high", 50), ("concordant_low", 50), ("first_above_second", 50), ("second_above_first", 50), ("target_disagreement", 25), ("near_zero", 25))


def adaptive_strata(spark, sf_dir, seed=1729):
    """Strata of the samples by rank percentiles of their mean scores: both methods high, both low, one above the other, both targets apart, both near the middle.

    Ties go by hash; a sample may be in several strata."""
    columns = ("local_aa_score", "primary_axis_dot_score", "final_aa_score")
    rows = _scores(spark, sf_dir, "sample_id", *columns).where(F.col("sample_id").isNotNull())
    for c in columns:
        rows = rows.where(V.is_finite(F.col(c)))
    means = cut(rows.groupBy("sample_id").agg(*(S.exact_mean(F.col(c)).alias(n) for n, c in zip("abc", columns))))
    for n in "abc":
        means = cut(S.average_ranks(means, [], n, f"r{n}"))
    total = means.agg(F.count(F.lit(1)).alias("total"))  # one row
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("fopci_adaptive"), "sample_id"), 256)
    p = {n: F.col(f"r{n}") / F.col("total") for n in "abc"}
    ranked = cut(means.crossJoin(F.broadcast(total)).select("sample_id", h.alias("_h"), *(p[n].alias(f"p{n}") for n in "abc")))
    a, b, c = F.col("pa"), F.col("pb"), F.col("pc")
    order = {
        "concordant_high": -F.least(a, b), "concordant_low": F.greatest(a, b), "first_above_second": b - a, "second_above_first": a - b, "target_disagreement": -F.abs(a - c), "near_zero": F.greatest(F.abs(a - 0.5), F.abs(b - 0.5)),
    }
    out = None
    for name, n in STRATA:
        best = ranked.withColumn("_by", F.round(order[name], 9)).orderBy("_by", "_h", "sample_id").limit(n)
        rank = F.row_number().over(Window.orderBy("_by", "_h", "sample_id"))  # n rows
        own = best.select(F.lit(name).alias("stratum"), rank.alias("rank"), "sample_id", *(F.round(x, 6).alias(x) for x in ("pa", "pb", "pc")))
        out = own if out is None else out.unionByName(own)
    return out


def axis_keys(spark, sf_dir):
    """The sorted union of axis names, with the rows that have each."""
    g = table(spark, sf_dir, "gradient_scores")
    return g.select(F.explode(F.map_keys("axis_scores")).alias("axis_name")).groupBy("axis_name").agg(F.count(F.lit(1)).alias("rows"))


def json_columns(spark, sf_dir):
    """A manifest's counts as JSON text, and a value read back from it."""
    m = table(spark, sf_dir, "import_manifests").select("import_id", "counts").distinct()
    j = F.to_json(F.struct(F.col("counts.rollout_records").alias("rollout_records"), F.col("counts.missing_rollout_ids").alias("missing_rollout_ids")))
    return m.select("import_id", j.alias("counts_json"), F.get_json_object(j, "$.missing_rollout_ids").try_cast("bigint").alias("missing"))


def safe_cast(spark, sf_dir):
    """Text to number: blanks, words and NaN give null."""
    w = table(spark, sf_dir, "window_plan").select("window_id", F.explode(F.array("priority", F.concat(F.lit(" "), "priority", F.lit(" ")), F.lit(""), F.lit("NaN"), F.lit("1e2"))).alias("text")).distinct()
    x = F.trim("text").try_cast("double")
    return w.select("window_id", "text", F.nanvl(x, F.lit(None).cast("double")).alias("number"))


def split_coverage(spark, sf_dir):
    """Categories of each half of the questions, and questions with more than one category."""
    r = table(spark, sf_dir, "rollouts").select("question_id", "question_category").distinct()
    split = F.when(F.col("question_id") % 2 == 0, "construction").otherwise("evaluation")
    mixed = r.groupBy("question_id").agg((F.count_distinct("question_category") > 1).alias("mixed"))
    return r.join(mixed, "question_id").groupBy(split.alias("split")).agg(F.count_distinct("question_category").alias("categories"), F.count_distinct("question_id").alias("questions"), F.count_distinct(F.when(F.col("mixed"), F.col("question_id"))).alias("mixed_questions"))


def single_context(spark, sf_dir):
    """Distinct models, revisions, layers and hooks of each window's rows (null counts as a value), and whether there is one of each."""
    g = table(spark, sf_dir, "gradient_scores").where("window_id IS NOT NULL")
    fields = ("model_id", "checkpoint_revision", "layer", "hook_name")
    rows = g.groupBy("window_id").agg(*((F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields))
    one = F.lit(True)
    for f in fields:
        one = one & (F.col(f) == 1)
    return rows.withColumn("single", one)


def audit_breakdowns(spark, sf_dir):
    """Counts by each of five fields in one pass; null is the value 'None'."""
    fields = ["record_type", "role_group", "default_prompt_id", "question_category"]
    v = _responses(spark, sf_dir, *fields)
    rows = v.select(*(F.coalesce(F.col(f), F.lit("None")).alias(f) for f in fields))
    out = rows.groupingSets([[F.col(f)] for f in fields], *(F.col(f) for f in fields)).agg(F.count(F.lit(1)).alias("rows"), *(F.grouping(f).alias(f"_{f}") for f in fields))
    field = F.coalesce(*(F.when(F.col(f"_{f}") == 0, f) for f in fields))
    return out.select(field.alias("field"), F.coalesce(*(F.when(F.col(f"_{f}") == 0, F.col(f)) for f in fields)).alias("value"), "rows")


def activation_audit(spark, sf_dir):
    """Checks of the score rows: repeated identifiers, missing keys, wrong token counts, values that are not finite."""
    g = table(spark, sf_dir, "gradient_scores")
    checks = {
        "sample_missing": F.col("sample_id").isNull(),
        "window_missing": F.col("window_id").isNull(),
        "target_count_wrong": F.col("target_token_count") != F.col("input_token_count"),
        "input_count_wrong": F.col("input_token_count") != F.col("token_count") - 1,
        "loss_not_finite": ~V.is_finite(F.col("loss")),
        "norm_not_positive": ~(F.coalesce("gradient_norm", F.lit(0.0)) > 0),
    }
    one = g.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks))).alias("x")).select("x.*")
    repeated = g.groupBy("score_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("score_repeated").alias("check"), "rows")
    return long.unionByName(repeated).withColumn("passed", F.col("rows") == 0)


def parameter_scope(spark, sf_dir):
    """Layers in scope 'upper half' and 'every second', with their row counts and the hash of their names."""
    layers = table(spark, sf_dir, "gradient_scores").select("layer", "hook_name").distinct()
    named = layers.select(F.concat(F.lit("layers."), "layer", F.lit(".weight")).alias("name")).distinct()
    index = F.regexp_extract("name", r"layers\.([0-9]+)\.", 1).cast("int")
    most = named.agg(F.max(index).alias("most"))  # one row
    rows = named.withColumn("index", index).crossJoin(F.broadcast(most))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("index") >= F.floor((F.col("most") + 1) / 2), "upper_half"), F.when(F.col("index") % 2 == 0, "every_second")))
    return rows.select("name", F.explode(scopes).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("parameters"), F.sha2(F.array_join(F.sort_array(F.collect_list("name")), "\n"), 256).alias("scope_hash"))  # one name per layer


def sequence_loss(spark, sf_dir):
    """Mean over a sequence's finite losses, and per window the sum of these means."""
    g = _scores(spark, sf_dir, "sample_id", "window_id", "loss").where("sample_id IS NOT NULL AND window_id IS NOT NULL")
    per = g.groupBy("window_id", "sample_id").agg((F.sum(F.when(V.is_finite(F.col("loss")), F.col("loss")).otherwise(0.0)) / F.greatest(F.count_if(V.is_finite(F.col("loss"))), F.lit(1))).alias("mean"))
    return per.groupBy("window_id").agg(F.count(F.lit(1)).alias("sequences"), F.sum(F.col("mean").cast("decimal(38,10)")).cast("double").alias("loss"))


QUERIES = {f.__name__: f for f in (
    scalar_stats, describe_median, axis_summary, window_score_summary, top_bottom, score_agreement, batch_invariance, method_comparison, adaptive_strata, axis_keys, json_columns, safe_cast, split_coverage, single_context, audit_breakdowns,
    activation_audit, parameter_scope, sequence_loss,
)}

_S = "WITH s AS (SELECT DISTINCT score_id, sample_id, window_id, checkpoint_revision, layer, local_aa_score, primary_axis_dot_score, loss, final_aa_score, gradient_norm FROM gradient_scores)"
_A = """WITH one AS (SELECT score_id, any_value(sample_id) AS sample_id, any_value(checkpoint_revision) AS checkpoint_revision, any_value(layer) AS layer, any_value(axis_scores) AS m FROM gradient_scores GROUP BY score_id),
ax AS (SELECT score_id, sample_id, checkpoint_revision, layer, unnest(map_keys(m)) AS axis_name, unnest(map_values(m)) AS score FROM one)"""
_CORR = "CASE WHEN count(*) >= 2 AND stddev_pop({0}) * stddev_pop({1}) > 1e-15 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"

ORACLE = {
    "scalar_stats": _S + """ SELECT layer, count(*) AS count, round(min(loss), 6) AS least, round(CAST(sum(CAST(loss AS DECIMAL(38,6))) AS DOUBLE) / count(loss), 6) AS mean, round(list_sort(list(loss))[count(*) // 2 + 1], 6) AS upper_median, round(max(loss), 6) AS greatest,
round(coalesce(stddev_samp(loss), 0), 6) AS deviation FROM s WHERE isfinite(loss) GROUP BY layer""",
    "describe_median": """SELECT response_source.model AS model, count(response_char_count) AS count, min(response_char_count) AS least, round(median(response_char_count), 6) AS median, round(avg(response_char_count), 6) AS mean, max(response_char_count) AS greatest
FROM (SELECT DISTINCT * FROM fixed_responses_validated) GROUP BY 1""",
    "axis_summary": _A + " SELECT axis_name, count(*) AS count, round(min(score), 6) AS least, round(CAST(sum(CAST(score AS DECIMAL(38,6))) AS DOUBLE) / count(score), 6) AS mean, round(max(score), 6) AS greatest, round(avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share FROM ax WHERE isfinite(score) GROUP BY 1",
    "window_score_summary": _S + """ SELECT coalesce(window_id, '(all)') AS window_id, count(*) AS count, round(min(local_aa_score), 6) AS least, round(CAST(sum(CAST(local_aa_score AS DECIMAL(38,6))) AS DOUBLE) / count(local_aa_score), 6) AS mean, round(max(local_aa_score), 6) AS greatest, round(coalesce(stddev_samp(local_aa_score), 0), 6) AS deviation
FROM s WHERE isfinite(local_aa_score) AND window_id IS NOT NULL GROUP BY CUBE (window_id)""",
    "top_bottom": _S + """, t AS (SELECT score_id, local_aa_score FROM s WHERE isfinite(local_aa_score))
SELECT * FROM (SELECT *, 'top' AS side FROM t ORDER BY local_aa_score DESC, score_id LIMIT 20) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM t ORDER BY local_aa_score, score_id LIMIT 20)""",
    "score_agreement": _A + """, r AS (SELECT axis_name, arg_min(score, score_id) AS a, arg_max(score, score_id) AS b FROM ax WHERE isfinite(score) AND sample_id IS NOT NULL GROUP BY sample_id, checkpoint_revision, layer, axis_name)
SELECT axis_name, count(*) AS records, round(CAST(sum(CAST(abs(b - a) AS DECIMAL(38,6))) AS DOUBLE) / count(abs(b - a)), 6) AS mean_absolute_delta, round(max(abs(b - a)), 6) AS max_absolute_delta, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse, round(""" + _CORR.format("a", "b") + """, 6) AS pearson,
round(avg(CASE WHEN (a >= 0) = (b >= 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS sign_agreement, bool_and(abs(b - a) <= 1e-3) AS passed FROM r GROUP BY 1""",
    "batch_invariance": _S + """, g AS (SELECT * FROM s WHERE sample_id IS NOT NULL AND isfinite(local_aa_score) AND isfinite(primary_axis_dot_score) AND isfinite(loss)),
d AS (SELECT """ + ", ".join(f"abs(arg_max({c}, score_id) - arg_min({c}, score_id)) AS {c}" for c in SCORES) + """ FROM g GROUP BY sample_id, checkpoint_revision, layer),
l AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS d FROM d" for c in SCORES) + """)
SELECT metric, count(*) AS records, round(max(d), 6) AS max_delta, round(CAST(sum(CAST(d AS DECIMAL(38,6))) AS DOUBLE) / count(d), 6) AS mean_delta, bool_and(d <= 1e-3) AS passed FROM l GROUP BY 1""",
    "method_comparison": _S + """, t AS (SELECT layer, local_aa_score AS a, primary_axis_dot_score AS b FROM s WHERE isfinite(local_aa_score) AND isfinite(primary_axis_dot_score)),
r AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY a) + (count(*) OVER (PARTITION BY layer, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY layer ORDER BY b) + (count(*) OVER (PARTITION BY layer, b) - 1) / 2.0::DOUBLE AS rb FROM t)
SELECT layer, count(*) AS records, round(""" + _CORR.format("a", "b") + ", 6) AS pearson, round(" + _CORR.format("ra", "rb") + """, 6) AS spearman, round(avg(CASE WHEN (a >= 0) = (b >= 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS sign_agreement FROM r GROUP BY layer""",
    "adaptive_strata": _S + """, m AS (SELECT sample_id, """ + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count({c}) AS {n}" for n, c in zip("abc", ("local_aa_score", "primary_axis_dot_score", "final_aa_score"))) + """
  FROM s WHERE isfinite(local_aa_score) AND isfinite(primary_axis_dot_score) AND isfinite(final_aa_score) AND sample_id IS NOT NULL GROUP BY 1),
p AS (SELECT sample_id, sha256('1729:fopci_adaptive:' || sample_id) AS h, """ + ", ".join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p{n}" for n in "abc") + """ FROM m),
o AS (SELECT *, unnest([""" + ", ".join(f"{{'stratum': '{name}', 'most': {n}, 'by': round({by}, 9)}}" for (name, n), by in zip(STRATA, ("-least(pa, pb)", "greatest(pa, pb)", "pb - pa", "pa - pb", "-abs(pa - pc)", "greatest(abs(pa - 0.5::DOUBLE), abs(pb - 0.5::DOUBLE))"))) + """]) AS x FROM p)
SELECT x.stratum AS stratum, row_number() OVER (PARTITION BY x.stratum ORDER BY x.by, h, sample_id) AS rank, sample_id, round(pa, 6) AS pa, round(pb, 6) AS pb, round(pc, 6) AS pc FROM o QUALIFY rank <= x.most""",
    "axis_keys": "SELECT axis_name, count(*) AS rows FROM (SELECT unnest(map_keys(axis_scores)) AS axis_name FROM gradient_scores) GROUP BY 1",
    "json_columns": """SELECT import_id, '{' || array_to_string(list_filter(['"rollout_records":' || counts.rollout_records, '"missing_rollout_ids":' || counts.missing_rollout_ids], lambda x: x IS NOT NULL), ',') || '}' AS counts_json, counts.missing_rollout_ids AS missing
FROM (SELECT DISTINCT import_id, counts FROM import_manifests)""",
    "safe_cast": """SELECT window_id, text, CASE WHEN isnan(x) THEN NULL ELSE x END AS number FROM (SELECT window_id, text, TRY_CAST(trim(text) AS DOUBLE) AS x
FROM (SELECT DISTINCT window_id, unnest([priority, ' ' || priority || ' ', '', 'NaN', '1e2']) AS text FROM window_plan))""",
    "split_coverage": """WITH r AS (SELECT DISTINCT question_id, question_category FROM rollouts), m AS (SELECT question_id FROM r GROUP BY 1 HAVING count(DISTINCT question_category) > 1)
SELECT CASE WHEN question_id % 2 = 0 THEN 'construction' ELSE 'evaluation' END AS split, count(DISTINCT question_category) AS categories, count(DISTINCT question_id) AS questions, count(DISTINCT question_id) FILTER (question_id IN (SELECT question_id FROM m)) AS mixed_questions FROM r GROUP BY 1""",
    "single_context": "SELECT *, model_id = 1 AND checkpoint_revision = 1 AND layer = 1 AND hook_name = 1 AS single FROM (SELECT window_id, " + ", ".join(f"count(DISTINCT {f}) + max(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS {f}" for f in ("model_id", "checkpoint_revision", "layer", "hook_name")) + " FROM gradient_scores WHERE window_id IS NOT NULL GROUP BY 1)",
    "audit_breakdowns": "WITH v AS (SELECT DISTINCT * FROM fixed_responses_validated) " + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, 'None') AS value, count(*) AS rows FROM v GROUP BY 2" for f in ("record_type", "role_group", "default_prompt_id", "question_category")),
    "activation_audit": """WITH c AS (SELECT unnest([
 {'check': 'sample_missing', 'rows': count(*) FILTER (sample_id IS NULL)}, {'check': 'window_missing', 'rows': count(*) FILTER (window_id IS NULL)}, {'check': 'target_count_wrong', 'rows': count(*) FILTER (target_token_count <> input_token_count)},
 {'check': 'input_count_wrong', 'rows': count(*) FILTER (input_token_count <> token_count - 1)}, {'check': 'loss_not_finite', 'rows': count(*) FILTER (loss IS NULL OR NOT isfinite(loss))}, {'check': 'norm_not_positive', 'rows': count(*) FILTER (NOT coalesce(gradient_norm, 0) > 0)},
 {'check': 'score_repeated', 'rows': count(*) - count(*)}]) AS x FROM gradient_scores)
SELECT x.check AS "check", CASE WHEN x.check = 'score_repeated' THEN r ELSE x.rows END AS rows, CASE WHEN x.check = 'score_repeated' THEN r ELSE x.rows END = 0 AS passed FROM c, (SELECT count(*) AS r FROM (SELECT score_id FROM gradient_scores GROUP BY 1 HAVING count(*) > 1))""",
    "parameter_scope": """WITH n AS (SELECT DISTINCT 'layers.' || layer || '.weight' AS name, layer AS i FROM gradient_scores), m AS (SELECT max(i) AS most FROM n),
s AS (SELECT name, 'all' AS scope FROM n UNION ALL SELECT name, 'upper_half' FROM n, m WHERE i >= (most + 1) // 2 UNION ALL SELECT name, 'every_second' FROM n WHERE i % 2 = 0)
SELECT scope, count(*) AS parameters, sha256(string_agg(name, chr(10) ORDER BY name)) AS scope_hash FROM s GROUP BY 1""",
    "sequence_loss": _S + """, p AS (SELECT window_id, sample_id, sum(CASE WHEN isfinite(loss) THEN loss ELSE 0 END) / greatest(count(*) FILTER (isfinite(loss)), 1) AS m FROM s WHERE sample_id IS NOT NULL AND window_id IS NOT NULL GROUP BY ALL)
SELECT window_id, count(*) AS sequences, CAST(sum(CAST(m AS DECIMAL(38,10))) AS DOUBLE) AS loss FROM p GROUP BY 1""",
}
