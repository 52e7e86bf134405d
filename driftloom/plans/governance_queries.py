"""Resuming, verifying and model-backend queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as X

from driftloom.operators import attribution as A
from driftloom.sources import jsonl, tables
from driftloom.session import own_folder, table
from driftloom.streaming.resume import pending, tumbling_counts

MODEL = A.TinyCausalModel(vocabulary=512, width=16)


def _axes():
    basis = MODEL.weights[1]
    return {"first": (basis[1] - basis[2]).tolist(), "second": (basis[3] - basis[4]).tolist()}


def resume_pending(spark, sf_dir):
    """Sampled sequences without a finite score: still to be done, per window; the others are done."""
    s = table(spark, sf_dir, "sampled_sequences").where("sample_id IS NOT NULL AND window_id IS NOT NULL").select("window_id", "sample_id").distinct()
    done = table(spark, sf_dir, "gradient_scores").where("sample_id IS NOT NULL AND loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) < double('inf')").select("sample_id")
    todo = pending(s, done, ["sample_id"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("pending"))
    return s.groupBy("window_id").agg(F.count(F.lit(1)).alias("selected")).join(todo, "window_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def ordered_lookup(spark, sf_dir):
    """The 40 documents of least hash in that order, with their sizes; every one must be found."""
    from driftloom.operators.selection import hash_ranked

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    wanted = hash_ranked(docs.select("doc_id"), "doc_id", 40, 1729, "lookup").orderBy("stable_hash", "doc_id")
    order = wanted.selectExpr("collect_list(struct(stable_hash, doc_id)) AS l").select(F.posexplode(F.array_sort("l")).alias("ord", "x")).select((F.col("ord") + 1).alias("ord"), F.col("x.doc_id").alias("doc_id"))  # 40 rows
    return docs.join(F.broadcast(order), "doc_id").select("ord", "doc_id", "n_chars")


def dependency_expand(spark, sf_dir):
    """Paths of four stages of every window's end revision, each path once, the last window winning."""
    w = table(spark, sf_dir, "window_plan").select("window_id", "to_revision", "batch_idx_start")
    stages = F.explode(F.array(*map(F.lit, ("activations", "axis", "geometry", "report"))))
    rows = w.select("window_id", "batch_idx_start", "to_revision", stages.alias("stage")).withColumn("path", F.concat_ws("/", "stage", "to_revision"))
    return rows.groupBy("path").agg(F.max_by("window_id", F.struct("batch_idx_start", "window_id")).alias("window_id"), F.count(F.lit(1)).alias("uses"))


def artifact_inventory(spark, sf_dir):
    """Size and digest of all files of the tables."""
    return tables.inventory(spark, sf_dir)


def artifact_verify(spark, sf_dir):
    """Planned shard files that no sampled row is from."""
    planned = table(spark, sf_dir, "window_plan").select(F.explode("parquet_files").alias("file")).distinct()
    have = table(spark, sf_dir, "sampled_sequences").select(F.col("source_file").alias("file")).distinct()
    return planned.join(have, "file", "left_anti")


def pilot_preflight(spark, sf_dir):
    """Per window: drawn rows, rows outside of the window's range, rows with a wrong count of ids, and whether all is well."""
    s = table(spark, sf_dir, "sampled_sequences").select("window_id", "sample_id", "batch_idx", "token_count", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n")).distinct()
    w = table(spark, sf_dir, "window_plan").select("window_id", "batch_idx_start", "batch_idx_end_exclusive")
    rows = w.join(s, "window_id")
    outside = F.col("batch_idx").isNull() | (F.col("batch_idx") < F.col("batch_idx_start")) | (F.col("batch_idx") >= F.col("batch_idx_end_exclusive"))
    out = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(outside).alias("outside"), F.count_if(F.coalesce(F.col("token_count") != F.col("n"), F.lit(True))).alias("wrong_counts"))
    return out.withColumn("ready", (F.col("outside") == 0) & (F.col("wrong_counts") == 0))


def template_generate(spark, sf_dir):
    """Template responses to every rollout, as digests."""
    made = A.generated(table(spark, sf_dir, "rollouts"), "rollout_id", "prompt_text")
    return made.select("rollout_id", F.sha2("generated_response", 256).alias("digest"))


def token_decode(spark, sf_dir):
    """Every drawn sequence through the default codec, as length and digest."""
    text = A.decoded(table(spark, sf_dir, "sampled_sequences").where("token_ids IS NOT NULL"), "sample_id", "token_ids")
    return text.select("sample_id", F.length("decoded_text").alias("length"), F.sha2("decoded_text", 256).alias("digest")).distinct()


def _drawn(spark, sf_dir):
    return table(spark, sf_dir, "sampled_sequences").select("sample_id", "token_ids").dropDuplicates(["sample_id"])


def model_forward(spark, sf_dir):
    return A.project(_drawn(spark, sf_dir), "sample_id", "token_ids", MODEL, _axes())


def model_gradient(spark, sf_dir):
    return A.pressure(_drawn(spark, sf_dir), "sample_id", "token_ids", MODEL, _axes()["first"])


def parameter_influence(spark, sf_dir):
    return A.influence(_drawn(spark, sf_dir), "sample_id", "token_ids", MODEL, list(range(1, 34)))


def scan_jsonl_strict(spark, sf_dir):
    """The windows written as JSON lines and read again with an explicit schema, any bad line failing the read."""
    path = own_folder(spark, "scan_jsonl_strict")
    jsonl.write(table(spark, sf_dir, "window_plan").select("window_id", "batch_idx_start", "batch_idx_end_exclusive"), path)
    schema = X.StructType([X.StructField("window_id", X.StringType()), X.StructField("batch_idx_start", X.LongType()), X.StructField("batch_idx_end_exclusive", X.LongType())])
    return jsonl.read_checked(spark, path, schema)


def csv_typed(spark, sf_dir):
    """Score rows' numbers written as CSV and read again with types; NaN and blanks as they were."""
    path = own_folder(spark, "csv_typed")
    rows = table(spark, sf_dir, "window_plan").select("window_id", "batch_count", "row_filter")
    tables.write_csv(rows, path, ["window_id", "batch_count", "row_filter"], ["row_filter"])
    schema = X.StructType([X.StructField("window_id", X.StringType()), X.StructField("batch_count", X.LongType()), X.StructField("row_filter_json", X.StringType())])
    read = tables.read_csv(spark, path, schema)
    return read.select("window_id", "batch_count", F.get_json_object("row_filter_json", "$.batch_idx_gte").cast("bigint").alias("at_least"))


def event_windows(spark, sf_dir):
    """Events per hour and type (an extension: the batch form of the streaming counts)."""
    return tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")


QUERIES = {f.__name__: f for f in (
    resume_pending, ordered_lookup, dependency_expand, artifact_inventory, artifact_verify, pilot_preflight, template_generate, token_decode, model_forward, model_gradient, parameter_influence, scan_jsonl_strict, csv_typed, event_windows,
)}

ORACLE = {
    "resume_pending": """WITH s AS (SELECT DISTINCT window_id, sample_id FROM sampled_sequences WHERE sample_id IS NOT NULL AND window_id IS NOT NULL), d AS (SELECT DISTINCT sample_id FROM gradient_scores WHERE sample_id IS NOT NULL AND isfinite(loss))
SELECT window_id, count(*) AS selected, count(*) FILTER (sample_id NOT IN (SELECT sample_id FROM d)) AS pending FROM s GROUP BY 1""",
    "ordered_lookup": "SELECT row_number() OVER (ORDER BY sha256('1729:lookup:' || doc_id), doc_id) AS ord, doc_id, n_chars FROM documents QUALIFY ord <= 40",
    "dependency_expand": "WITH r AS (SELECT window_id, batch_idx_start, unnest(['activations', 'axis', 'geometry', 'report']) || '/' || to_revision AS path FROM window_plan) SELECT path, arg_max(window_id, (batch_idx_start, window_id)) AS window_id, count(*) AS uses FROM r GROUP BY 1",
    "artifact_verify": "SELECT DISTINCT f AS file FROM (SELECT unnest(parquet_files) AS f FROM window_plan) WHERE f NOT IN (SELECT source_file FROM sampled_sequences WHERE source_file IS NOT NULL)",
    "pilot_preflight": """WITH s AS (SELECT DISTINCT window_id, sample_id, batch_idx, token_count, coalesce(len(token_ids), 0) AS n FROM sampled_sequences),
r AS (SELECT w.window_id, count(*) AS rows, count(*) FILTER (batch_idx IS NULL OR batch_idx < batch_idx_start OR batch_idx >= batch_idx_end_exclusive) AS outside, count(*) FILTER (token_count IS DISTINCT FROM n) AS wrong_counts FROM window_plan w JOIN s USING (window_id) GROUP BY 1)
SELECT *, outside = 0 AND wrong_counts = 0 AS ready FROM r""",
    "template_generate": "SELECT rollout_id, sha256('Template answer to: ' || coalesce(string_split(prompt_text, chr(10))[-1], '(no prompt)')) AS digest FROM rollouts",
    "token_decode": "WITH t AS (SELECT sample_id, list_aggregate(list_transform(list_filter(token_ids, lambda x: x IS NOT NULL), lambda x: CASE WHEN x = 0 THEN chr(10) ELSE chr(CAST(x % 26 + 97 AS INTEGER)) END), 'string_agg', '') AS d FROM sampled_sequences WHERE token_ids IS NOT NULL) SELECT DISTINCT sample_id, length(coalesce(d, '')) AS length, sha256(coalesce(d, '')) AS digest FROM t",
    "scan_jsonl_strict": "SELECT window_id, batch_idx_start, batch_idx_end_exclusive FROM window_plan",
    "csv_typed": "SELECT window_id, batch_count, row_filter.batch_idx_gte AS at_least FROM window_plan",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
