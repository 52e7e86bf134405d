"""Planned shards, target bundles, fan-in of checkpoints, selections, resampling and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions import codec
from driftloom.functions import vectors as V
from driftloom.operators import geometry as G
from driftloom.operators import resampling, targets
from driftloom.operators import stats as S
from driftloom.plans import geometry_queries as Q
from driftloom.session import own_folder, table
from driftloom.sources import tables

REPLICATES, LEVELS, SEED = 100, (0.05, 0.95), 1729
#: The fields that an inspection keeps of a record, as far as the record has them.
COMPACT = ("rollout_id", "record_type", "role_id", "role_group", "question_id", "question_category", "not_there")


def planned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn sequences written as shard files, then read again through the plans: rows per window and file. Planned files that no row is in are skipped."""
    root = own_folder(spark, "shards")
    rows = table(spark, sf_dir, "sampled_sequences").where("source_file IS NOT NULL").select("sample_id", "uid", "batch_idx", "source_file")
    rows.repartition("source_file").write.partitionBy("source_file").parquet(root)
    plans = table(spark, sf_dir, "window_plan").select(F.col("window_id").alias("plan_id"), F.col("parquet_files").alias("files"), F.col("batch_idx_start").alias("start"), F.col("batch_idx_end_exclusive").alias("end"))
    read = tables.read_planned(spark, plans, root, ["sample_id", "uid", "batch_idx"], "skip", rows.schema)
    return read.groupBy("plan_id", "source_file").agg(F.count(F.lit(1)).alias("rows"), F.min("batch_idx").alias("first_batch"), F.max("batch_idx").alias("last_batch"))


def _bundle(rows: DataFrame) -> DataFrame:
    axes = G.contrast(rows, ["step"], "v", Q._default(), Q._contrast()).withColumn("name", F.concat(F.lit("aa_step"), "step"))
    return targets.bundle(axes, "name", f"aa_step{Q.FINAL}", "aa_step0")


def target_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes of all revisions and the innovation of the last over the first, with what describes them and their cosine with the first."""
    made = _bundle(Q._vectors(spark, sf_dir))
    first = made.where("axis_name = 'aa_step0'").select(F.col("vector").alias("_first"))
    rows = made.crossJoin(F.broadcast(first))  # one row
    cosine = F.round(V.dot(F.col("vector"), F.col("_first")), 6)
    return rows.select("axis_name", "kind", "dimension", F.round("raw_norm", 6).alias("raw_norm"), F.when(F.abs(cosine) < 1e-6, F.lit(0.0)).otherwise(cosine).alias("first_cosine"))


def multi_axis_filter(spark: SparkSession, sf_dir: str, axes=("aa_step0", "aa_step1", "aa_step2", "aa_step3", "innovation"), top_k: int = 4) -> DataFrame:
    """Every sequence with every wanted target of the bundle: mean, greatest, top mean and positive share of its tokens' projections."""
    rows = Q._vectors(spark, sf_dir)
    made = _bundle(rows)
    axes = targets.load(made, axes) if not rows.isEmpty() else made.select("axis_name", F.col("vector").alias("axis"))
    x = F.col("raw")
    scored = targets.projected(rows.select("seq", "v"), "v", axes).groupBy("seq", "axis_name")
    return scored.agg(F.count(x).alias("tokens"), F.round(F.avg(x), 6).alias("mean"), F.round(F.max(x), 6).alias("max"), F.round(S.top_mean(x, top_k), 6).alias("top_mean"), F.round(S.positive_share(x), 6).alias("positive_share"))


def checkpoint_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes written as one artifact per checkpoint with a summary of them; completed ones are read together and held against the last, in order of steps."""
    root, rows = own_folder(spark, "checkpoints"), Q._vectors(spark, sf_dir)
    axes = Q._axes_by_step(rows).select("step", "axis")
    axes.write.partitionBy("step").parquet(root)
    summary = spark.createDataFrame([(f"step{k}", k, "completed", f"{root}/step={k}") for k in range(4)] + [("main", None, "failed", f"{root}/none")], "revision string, step int, status string, path string")
    done = [r for r in summary.where("status = 'completed'").orderBy(F.col("step").asc_nulls_first()).collect() if tables.exists(spark, r.path)]  # one row per checkpoint
    if not done:
        return spark.createDataFrame([], "ord int, revision string, step int, final_cosine double")
    read = spark.read.option("basePath", root).parquet(*(r.path for r in done)).select(F.col("step").cast("int").alias("step"), "axis")
    final = read.where(F.col("step") == done[-1].step).select(F.col("axis").alias("final"))
    order = F.row_number().over(Window.orderBy(F.col("step").asc_nulls_first()))  # one row per checkpoint
    met = read.join(summary.where("status = 'completed'").select("step", "revision"), "step").crossJoin(F.broadcast(final))
    return met.select(order.alias("ord"), "revision", "step", F.round(V.cosine(F.col("axis"), F.col("final")), 6).alias("final_cosine"))


def select_revisions(df: DataFrame, column: str, wanted) -> DataFrame:
    """The rows of the wanted revisions, all rows if none are named; naming some of which none occurs is an error."""
    if not wanted:
        return df
    rows = df.where(F.col(column).isin(*wanted))
    if not df.isEmpty() and rows.isEmpty():
        raise ValueError(f"no rows of the revisions {sorted(wanted)}")
    return rows


def checkpoint_select(spark: SparkSession, sf_dir: str, revisions=()) -> DataFrame:
    """Score rows of the named revisions, counted; if none are named, of the five commonest."""
    g = table(spark, sf_dir, "gradient_scores").where("checkpoint_revision IS NOT NULL")
    names = g.groupBy("checkpoint_revision").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "checkpoint_revision").limit(5)
    wanted = revisions or [r.checkpoint_revision for r in names.collect()]  # five rows
    return select_revisions(g, "checkpoint_revision", wanted).groupBy("checkpoint_revision", "layer").agg(F.count(F.lit(1)).alias("rows"))


def split_filter(spark: SparkSession, sf_dir: str, splits=("primary", "secondary")) -> DataFrame:
    """Windows of the wanted splits only, by default primary and secondary, primary first, each split in the order of its steps."""
    w = table(spark, sf_dir, "window_plan").where(F.col("split").isin(*splits))
    by = Window.partitionBy("split").orderBy("batch_idx_start", "batch_idx_end_exclusive", "window_id")
    return w.select("split", "window_id", F.when(F.col("split") == "primary", 1).otherwise(2).alias("split_order"), F.row_number().over(by).alias("place"))


def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as integers, strictly: how many a row has, null where it has none or an element that is no id."""
    s = table(spark, sf_dir, "sampled_sequences").select("sample_id", F.size(codec.token_ids(F.col("token_ids"))).alias("n"))
    return s.select("sample_id", F.when(F.col("n") >= 0, F.col("n")).alias("ids")).distinct()


def compact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted fields of each rollout as far as the table has them."""
    r = table(spark, sf_dir, "rollouts")
    return r.select(*(c for c in COMPACT if c in r.columns))


def decoded_text(spark: SparkSession, sf_dir: str, vocabulary: str = codec.RANKS) -> DataFrame:
    """Every drawn sequence through the public vocabulary: characters, documents and a digest."""
    rows = table(spark, sf_dir, "sampled_sequences").where("token_ids IS NOT NULL AND sample_id IS NOT NULL").dropDuplicates(["sample_id"])
    text = rows.select("sample_id", codec.decoded("token_ids", vocabulary).alias("t"))
    return text.select("sample_id", F.length("t").alias("chars"), (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).alias("line_ends"), F.sha2("t", 256).alias("digest"))


def artifact_gate(spark: SparkSession, sf_dir: str, prefix: str = "runs/tables") -> DataFrame:
    """One row over all files of the tables: how many, their size, skipped and unready ones, and whether all may go."""
    held = tables.artifact_records(tables.inventory(spark, sf_dir), prefix)
    kept = ~F.col("skipped")
    one = held.agg(F.count_if(kept).alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"), F.count_if(F.col("skipped")).alias("skipped"), F.count_if(kept & ~F.col("ready")).alias("unready"))
    return one.withColumn("passed", (F.col("files") > 0) & (F.col("unready") == 0))


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples and uids per layer by sketch, told as whether the estimate lies within a tenth of the exact number."""
    g = table(spark, sf_dir, "gradient_scores").where("layer IS NOT NULL")
    rows = g.groupBy("layer").agg(*(f(c).alias(f"{p}_{c}") for c in ("sample_id", "uid") for p, f in (("near", lambda c: F.approx_count_distinct(c, 0.02)), ("exact", F.count_distinct))))
    long = rows.select("layer", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"exact_{c}").alias("exact"), (F.abs(F.col(f"near_{c}") - F.col(f"exact_{c}")) <= 0.1 * F.col(f"exact_{c}")).alias("within")) for c in ("sample_id", "uid")))).alias("x"))
    return long.select("layer", "x.*")


def sliding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite losses per day of scoring, with those of the seven days up to it (a range frame) and of the day before (a row frame)."""
    g = table(spark, sf_dir, "gradient_scores").where(V.is_finite(F.col("loss")) & F.col("scored_at").isNotNull())
    days = g.groupBy(F.datediff(F.to_date("scored_at"), F.lit("2000-01-01")).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.max("loss").alias("most"))  # one row per day
    by = Window.orderBy("day")
    return days.select("day", "rows", F.sum("rows").over(by.rangeBetween(-6, 0)).alias("week_rows"), F.max("most").over(by.rangeBetween(-6, 0)).alias("week_most"), F.sum("rows").over(by.rowsBetween(-1, -1)).alias("rows_before"))


def bootstrap_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of each layer with the interval of its bootstrap replicates."""
    g = table(spark, sf_dir, "gradient_scores").select("score_id", "layer", "loss").distinct()
    rows = resampling.bootstrap_means(g, "layer", "score_id", "loss", REPLICATES, SEED, LEVELS)
    return rows.select("layer", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


QUERIES = {f.__name__: f for f in (
    planned_scan, target_bundle, multi_axis_filter, checkpoint_fan_in, checkpoint_select, split_filter, normalize_ids, compact_record, decoded_text, artifact_gate, approx_distinct, sliding_scores, bootstrap_loss,
)}

_TARGETS = Q._STEPS + """,
inn AS (SELECT list_transform(list_zip(e.a, n.a), lambda p: p[1] - list_inner_product(e.a, n.a) * p[2]) AS r FROM step_axis e, step_axis n WHERE e.step = 3 AND n.step = 0),
tg AS (SELECT 'aa_step' || step AS axis_name, 'axis' AS kind, a AS vector, nrm AS raw_norm FROM step_axis JOIN (SELECT step, sqrt(sum(r * r)) AS nrm FROM step_sides GROUP BY step) USING (step)
  UNION ALL SELECT 'innovation', 'innovation', list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))), sqrt(list_inner_product(r, r)) FROM inn)
"""
_POISSON = " + ".join(f"CASE WHEN u >= {bound} THEN 1 ELSE 0 END" for bound in resampling.POISSON)

ORACLE = {
    "planned_scan": """SELECT window_id AS plan_id, source_file, count(*) AS rows, min(batch_idx) AS first_batch, max(batch_idx) AS last_batch
FROM (SELECT window_id, unnest(parquet_files) AS source_file, batch_idx_start AS a, batch_idx_end_exclusive AS b FROM window_plan) JOIN (SELECT source_file, batch_idx FROM sampled_sequences) USING (source_file) WHERE batch_idx >= a AND batch_idx < b GROUP BY 1, 2""",
    "target_bundle": _TARGETS + """SELECT axis_name, kind, len(vector) AS dimension, round(raw_norm, 6) AS raw_norm, CASE WHEN abs(c) < 1e-6 THEN 0.0::DOUBLE ELSE c END AS first_cosine
FROM (SELECT t.*, round(list_inner_product(t.vector, f.vector), 6) AS c FROM tg t, (SELECT vector FROM tg WHERE axis_name = 'aa_step0') f)""",
    "multi_axis_filter": _TARGETS + """, sc AS (SELECT seq, axis_name, list_inner_product(v, vector) AS raw FROM e, tg)
SELECT seq, axis_name, count(*) AS tokens, round(avg(raw), 6) AS mean, round(max(raw), 6) AS max, round(list_avg(list_slice(list_reverse_sort(list(raw)), 1, 4)), 6) AS top_mean, round(avg(CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_share FROM sc GROUP BY 1, 2""",
    "checkpoint_fan_in": Q._STEPS + "SELECT row_number() OVER (ORDER BY step) AS ord, 'step' || step AS revision, step, round(final_cosine, 6) AS final_cosine FROM traj",
    "checkpoint_select": """WITH top AS (SELECT checkpoint_revision, count(*) AS n FROM gradient_scores WHERE checkpoint_revision IS NOT NULL GROUP BY 1 ORDER BY n DESC, checkpoint_revision LIMIT 5)
SELECT checkpoint_revision, layer, count(*) AS rows FROM gradient_scores WHERE checkpoint_revision IN (SELECT checkpoint_revision FROM top) GROUP BY 1, 2""",
    "split_filter": "SELECT split, window_id, CASE split WHEN 'primary' THEN 1 ELSE 2 END AS split_order, row_number() OVER (PARTITION BY split ORDER BY batch_idx_start, batch_idx_end_exclusive, window_id) AS place FROM window_plan WHERE split IN ('primary', 'secondary')",
    "normalize_ids": "SELECT DISTINCT sample_id, CASE WHEN len(token_ids) > 0 AND len(list_filter(token_ids, lambda x: x IS NULL)) = 0 THEN len(token_ids) END AS ids FROM sampled_sequences",
    "compact_record": "SELECT rollout_id, record_type, role_id, role_group, question_id, question_category FROM rollouts",
    "approx_distinct": """SELECT layer, 'sample_id' AS field, count(DISTINCT sample_id) AS exact, true AS within FROM gradient_scores WHERE layer IS NOT NULL GROUP BY 1
UNION ALL SELECT layer, 'uid', count(DISTINCT uid), true FROM gradient_scores WHERE layer IS NOT NULL GROUP BY 1""",
    "sliding_scores": """WITH d AS (SELECT date_diff('day', DATE '2000-01-01', CAST(scored_at AS DATE)) AS day, count(*) AS rows, max(loss) AS most FROM gradient_scores WHERE isfinite(loss) AND scored_at IS NOT NULL GROUP BY 1)
SELECT day, rows, CAST(sum(rows) OVER r AS BIGINT) AS week_rows, max(most) OVER r AS week_most, lag(rows) OVER (ORDER BY day) AS rows_before FROM d WINDOW r AS (ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "bootstrap_loss": f"""WITH g AS (SELECT DISTINCT score_id, layer, loss FROM gradient_scores WHERE isfinite(loss)),
b AS (SELECT layer, ('0x' || sha256(CAST(score_id AS VARCHAR))[1:6])::BIGINT % 256 AS block, count(*) AS n, sum(CAST(loss AS DECIMAL(38,9))) AS s FROM g GROUP BY 1, 2),
r AS (SELECT *, ('0x' || sha256(concat_ws(':', '{SEED}', layer, block, b))[1:8])::BIGINT AS u FROM b, (SELECT unnest(range(1, {REPLICATES} + 1)) AS b)),
m AS (SELECT layer, b, CAST(sum(({_POISSON}) * s) AS DOUBLE) / nullif(sum(({_POISSON}) * n), 0) AS m FROM r GROUP BY 1, 2),
e AS (SELECT layer, list_sort(list(m)) AS ms FROM m GROUP BY 1)
SELECT layer, n, round(mean, 6) AS mean, round(ms[5], 6) AS low, round(ms[95], 6) AS high FROM e JOIN (SELECT layer, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS DOUBLE) / sum(n) AS mean FROM b GROUP BY 1) USING (layer)""",
}
