"""Queries on references between the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.orphans import Edge, cascade, count_mismatches, orphan_report
from driftloom.session import table

EDGES = (
    Edge("fixed_responses", "raw_row_id", "rollout_id", "rollouts", "rollout_id", "received_at", "created_at", "deleted_at"),
    Edge("sampled_sequences", "sample_id", "window_id", "window_plan", "window_id", "added_at"),
    Edge("gradient_scores", "score_id", "sample_id", "sampled_sequences", "sample_id", "scored_at", "added_at"),
)


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {e.child for e in EDGES} | {e.parent for e in EDGES}
    return cascade({n: table(spark, sf_dir, n) for n in sorted(names)}, EDGES)


def _mismatches(spark: SparkSession, sf_dir: str, orphans: DataFrame) -> DataFrame:
    direct = orphans.where((F.col("table_name") == "fixed_responses") & (F.col("kind") == "direct")).select(F.col("row_key").cast("long").alias("raw_row_id"))
    hit = table(spark, sf_dir, "fixed_responses").select("raw_row_id", "import_id").join(direct, "raw_row_id", "left_semi")
    return count_mismatches(table(spark, sf_dir, "import_manifests"), hit, "import_id", F.col("counts.missing_rollout_ids"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orphans = _cascade(spark, sf_dir)
    direct = orphans.where(F.col("kind") == "direct").select("table_name", "row_key", "reason")
    counts = _mismatches(spark, sf_dir, orphans).select(F.lit("import_manifests").alias("table_name"), "row_key", F.lit("count_mismatch").alias("reason")).distinct()
    return direct.unionByName(counts)


def p4_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, month, kind (direct, inherited) and reason; wrong manifests under the month of their creation."""
    orphans = _cascade(spark, sf_dir)
    made = table(spark, sf_dir, "import_manifests").groupBy(F.col("import_id").alias("row_key")).agg(F.min("created_at_utc").alias("at"))
    counts = _mismatches(spark, sf_dir, orphans).select("row_key").distinct().join(made, "row_key")
    counts = counts.select(F.lit("import_manifests").alias("table_name"), "row_key", F.col("at").cast("timestamp_ntz").alias("at"), F.lit("count_mismatch").alias("reason"), F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    return orphan_report(orphans.unionByName(counts))


_DIRECT = """
WITH fr AS (
  SELECT f.raw_row_id, f.import_id, f.received_at,
         CASE WHEN r.rollout_id IS NULL THEN 'missing' WHEN r.created_at > f.received_at THEN 'late' WHEN r.deleted_at <= f.received_at THEN 'deleted' END AS reason
  FROM fixed_responses f LEFT JOIN rollouts r USING (rollout_id) WHERE f.rollout_id IS NOT NULL),
ss AS (SELECT s.sample_id, min(s.added_at) AS made FROM sampled_sequences s LEFT JOIN window_plan w USING (window_id) WHERE s.window_id IS NOT NULL AND w.window_id IS NULL GROUP BY 1),
first_added AS (SELECT sample_id, min(added_at) AS added_at FROM sampled_sequences WHERE sample_id IS NOT NULL GROUP BY 1),
gs AS (
  SELECT g.score_id, min(g.scored_at) AS made, min(CASE WHEN a.sample_id IS NULL THEN '0missing' WHEN a.added_at > g.scored_at THEN '1late' END)[2:] AS reason
  FROM gradient_scores g LEFT JOIN first_added a USING (sample_id)
  WHERE g.sample_id IS NOT NULL AND (a.sample_id IS NULL OR a.added_at > g.scored_at) GROUP BY 1),
wrong AS (
  SELECT DISTINCT m.import_id FROM import_manifests m LEFT JOIN (SELECT import_id, count(*) AS n FROM fr WHERE reason IS NOT NULL GROUP BY 1) c USING (import_id)
  WHERE m.counts.missing_rollout_ids IS NOT NULL AND m.counts.missing_rollout_ids <> coalesce(c.n, 0)),
"""

P4_FOUND_SQL = _DIRECT.rstrip().rstrip(",") + """
SELECT 'fixed_responses' AS table_name, CAST(raw_row_id AS VARCHAR) AS row_key, reason FROM fr WHERE reason IS NOT NULL
UNION ALL SELECT 'sampled_sequences', sample_id, 'missing' FROM ss
UNION ALL SELECT 'gradient_scores', CAST(score_id AS VARCHAR), reason FROM gs
UNION ALL SELECT 'import_manifests', import_id, 'count_mismatch' FROM wrong
"""

P4_REPORT_SQL = _DIRECT + """
inherited AS (
  SELECT g.score_id, min(g.scored_at) AS made FROM gradient_scores g
  WHERE g.sample_id IN (SELECT sample_id FROM ss) AND g.score_id NOT IN (SELECT score_id FROM gs) GROUP BY 1),
found AS (
  SELECT 'fixed_responses' AS table_name, received_at AS made, reason, 'direct' AS kind FROM fr WHERE reason IS NOT NULL
  UNION ALL SELECT 'sampled_sequences', made, 'missing', 'direct' FROM ss
  UNION ALL SELECT 'gradient_scores', made, reason, 'direct' FROM gs
  UNION ALL SELECT 'gradient_scores', made, 'parent_orphaned', 'inherited' FROM inherited
  UNION ALL SELECT 'import_manifests', (SELECT min(created_at_utc) FROM import_manifests m WHERE m.import_id = wrong.import_id), 'count_mismatch', 'direct' FROM wrong)
SELECT table_name, strftime(made, '%Y-%m') AS month, kind, reason, count(*) AS orphans FROM found GROUP BY 1, 2, 3, 4
"""

QUERIES = {"p4_found": p4_found, "p4_orphans_by_month": p4_orphans_by_month}
ORACLE = {"p4_found": P4_FOUND_SQL, "p4_orphans_by_month": P4_REPORT_SQL}
