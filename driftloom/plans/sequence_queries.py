"""Scans of shards, pieces of sequences, pivots and short lists over ``sampled_sequences``, ``gradient_scores`` and ``rollouts``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions import vectors as V
from driftloom.session import table
from driftloom.sources import tables

SCAN = (20_000, 60_000)
#: Ids that a method reads of a sequence.
LONGEST = 2048


def shard_scan(spark, sf_dir):
    """Three columns of one half-open range, read with the range pushed into the scan."""
    rows = tables.read_shards(spark, [f"{sf_dir}/sampled_sequences.parquet"], ["uid", "batch_idx", "token_ids"], *SCAN)
    return rows.select("uid", "batch_idx", F.coalesce(F.size("token_ids"), F.lit(0)).alias("tokens")).distinct()


def filter_truncation(spark, sf_dir):
    """Ids that each method reads of a sequence: the filter drops the last id and then truncates, the gradient truncates to one more and then shifts."""
    ids = F.col("token_ids")
    rows = table(spark, sf_dir, "sampled_sequences").where(F.size(ids) >= 2)
    filtered = F.slice(F.slice(ids, 1, F.size(ids) - 1), 1, LONGEST)
    kept = F.slice(ids, 1, LONGEST + 1)
    inputs, targets = F.slice(kept, 1, F.size(kept) - 1), F.slice(kept, 2, F.size(kept) - 1)
    return rows.select("sample_id", F.size(filtered).alias("filter_ids"), F.size(inputs).alias("inputs"), F.element_at(inputs, -1).alias("last_input"), F.element_at(targets, -1).alias("last_target")).distinct()


def document_spans(spark, sf_dir):
    """Documents within sequences: the spans between end-of-document ids, with start and length; empty spans are none."""
    ids = F.col("token_ids")
    rows = table(spark, sf_dir, "sampled_sequences").where(F.size(ids) >= 1).select("sample_id", "token_ids", F.xxhash64("token_ids").alias("_h")).dropDuplicates(["sample_id", "_h"])
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x == 0, i + 1)), lambda x: x.isNotNull())
    bounds = F.concat(F.array(F.lit(0)), ends, F.array(F.size(ids) + 1))
    spans = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.struct(F.element_at(bounds, k).alias("start"), (F.element_at(bounds, k + 1) - F.element_at(bounds, k) - 1).alias("length")))
    return rows.select("sample_id", F.explode(spans).alias("s")).select("sample_id", "s.start", "s.length").where("length > 0")


def axis_pivot(spark, sf_dir):
    """Scores of every row, one column per axis: the sorted union of all axes that occur, layers aside. A row has each axis once at most."""
    g = table(spark, sf_dir, "gradient_scores").groupBy("score_id").agg(F.any_value(F.struct("layer", "axis_scores")).alias("x")).select("score_id", "x.*")
    bare = F.transform_keys("axis_scores", lambda k, v: F.regexp_replace(k, "_l[0-9]+$", ""))
    axes = table(spark, sf_dir, "gradient_scores").select(F.explode(F.map_keys("axis_scores")).alias("k")).select(F.regexp_replace("k", "_l[0-9]+$", "").alias("k")).distinct()
    names = sorted(r.k for r in axes.collect())  # one row per axis of the configuration
    held = g.select("score_id", "layer", bare.alias("m"))
    return held.select("score_id", "layer", *(F.try_element_at("m", F.lit(n)).alias(f"{n}__score") for n in names))


def legacy_axis_scores(spark, sf_dir):
    """Scores of rows by axis: the map where there is one, else made of the two old columns; missing values are left out."""
    old = F.map_filter(F.map_from_arrays(F.array(F.lit("local_aa"), F.lit("final_aa")), F.array("local_aa_score", "final_aa_score")), lambda k, v: v.isNotNull())
    scores = F.when(F.size(F.coalesce(F.map_keys("axis_scores"), F.array().cast("array<string>"))) > 0, F.col("axis_scores")).otherwise(old)
    g = table(spark, sf_dir, "gradient_scores").select(F.explode(F.map_keys(scores)).alias("axis_name"))
    return g.groupBy("axis_name").agg(F.count(F.lit(1)).alias("rows"))


def first_variants(spark, sf_dir):
    """The first instruction variant of each role."""
    r = table(spark, sf_dir, "rollouts").where("record_type = 'role'")
    first = r.groupBy("role_id").agg(F.min(F.struct("role_instruction_variant_id", "role_instruction")).alias("x"), F.count_distinct("role_instruction_variant_id").alias("variants"))
    return first.select("role_id", F.col("x.role_instruction_variant_id").alias("variant"), F.col("x.role_instruction").alias("instruction"), "variants")


def scope_top_samples(spark, sf_dir):
    """The ten samples of each window of highest cosine, a missing one counting as 0."""
    score = F.coalesce(F.when(V.is_finite(F.col("local_aa_score")), F.col("local_aa_score")), F.lit(0.0))
    rows = table(spark, sf_dir, "gradient_scores").where("window_id IS NOT NULL AND sample_id IS NOT NULL").groupBy("window_id", "sample_id").agg(F.max(score).alias("score"))
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy(F.col("score").desc(), "sample_id"))
    return rows.withColumn("rank", rank).where("rank <= 10")


def problem_list(spark, sf_dir):
    """The first 20 sampled rows with a wrong token count, as an audit report lists them."""
    s = table(spark, sf_dir, "sampled_sequences").where("sample_id IS NOT NULL")
    n = F.coalesce(F.size("token_ids"), F.lit(0))
    wrong = s.select("sample_id", F.col("token_count").alias("stated"), n.alias("found")).where("stated IS NULL OR stated <> found").distinct()
    return wrong.orderBy("sample_id", "stated", "found").limit(20)


QUERIES = {f.__name__: f for f in (shard_scan, filter_truncation, document_spans, axis_pivot, legacy_axis_scores, first_variants, scope_top_samples, problem_list)}

ORACLE = {
    "shard_scan": "SELECT DISTINCT uid, batch_idx, coalesce(len(token_ids), 0) AS tokens FROM sampled_sequences WHERE batch_idx >= 20000 AND batch_idx < 60000",
    "filter_truncation": """WITH k AS (SELECT DISTINCT sample_id, token_ids[1:len(token_ids) - 1][1:2048] AS f, token_ids[1:2049] AS t FROM sampled_sequences WHERE len(token_ids) >= 2)
SELECT DISTINCT sample_id, len(f) AS filter_ids, len(t) - 1 AS inputs, t[len(t) - 1] AS last_input, t[len(t)] AS last_target FROM k""",
    "document_spans": """WITH s AS (SELECT DISTINCT sample_id, token_ids FROM sampled_sequences WHERE len(token_ids) >= 1),
b AS (SELECT sample_id, list_concat([0], list_filter(range(1, len(token_ids) + 1), lambda i: token_ids[i] = 0), [len(token_ids) + 1]) AS b FROM s),
p AS (SELECT sample_id, unnest(b[1:len(b) - 1]) AS start, unnest(b[2:]) AS stop FROM b) SELECT sample_id, start, stop - start - 1 AS length FROM p WHERE stop - start - 1 > 0""",
    "axis_pivot": """WITH one AS (SELECT score_id, any_value(layer) AS layer, any_value(axis_scores) AS m FROM gradient_scores GROUP BY 1),
l AS (SELECT score_id, layer, regexp_replace(k.u, '_l[0-9]+$', '') AS axis, m[k.u] AS v FROM one LEFT JOIN unnest(map_keys(m)) AS k(u) ON true)
SELECT score_id, layer, any_value(v) FILTER (axis = 'aa_final') AS aa_final__score, any_value(v) FILTER (axis = 'aa_local') AS aa_local__score, any_value(v) FILTER (axis = 'emergent_residual') AS emergent_residual__score FROM l GROUP BY 1, 2""",
    "legacy_axis_scores": """WITH g AS (SELECT CASE WHEN axis_scores IS NOT NULL AND cardinality(axis_scores) > 0 THEN map_keys(axis_scores) ELSE list_filter([CASE WHEN local_aa_score IS NOT NULL THEN 'local_aa' END, CASE WHEN final_aa_score IS NOT NULL THEN 'final_aa' END], lambda x: x IS NOT NULL) END AS k FROM gradient_scores)
SELECT axis_name, count(*) AS rows FROM (SELECT unnest(k) AS axis_name FROM g) GROUP BY 1""",
    "first_variants": """SELECT role_id, min(role_instruction_variant_id) AS variant, arg_min(role_instruction, (role_instruction_variant_id, role_instruction)) AS instruction, count(DISTINCT role_instruction_variant_id) AS variants FROM rollouts WHERE record_type = 'role' GROUP BY 1""",
    "scope_top_samples": """WITH r AS (SELECT window_id, sample_id, max(CASE WHEN isfinite(local_aa_score) THEN local_aa_score ELSE 0 END) AS score FROM gradient_scores WHERE window_id IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, sample_id) AS rank FROM r QUALIFY rank <= 10""",
    "problem_list": """SELECT DISTINCT sample_id, token_count AS stated, coalesce(len(token_ids), 0) AS found FROM sampled_sequences WHERE sample_id IS NOT NULL AND (token_count IS NULL OR token_count <> coalesce(len(token_ids), 0)) ORDER BY sample_id, stated, found LIMIT 20""",
}
