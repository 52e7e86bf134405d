"""Window plans, shard pruning, window scans, samples and subsets over ``window_plan``, ``sampled_sequences`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import selection as S
from driftloom.operators.ranges import range_join
from driftloom.session import table

SHARD = 1000
SUBSETS = (("master", 100), ("activation_gradient", 40), ("fopci_random", 10))
SEED = 1729
#: The size of a sample whose plan names none.
SAMPLE_SIZE = 1000


def window_plan(spark, sf_dir):
    """The plan made again from both revisions: bounds, width, order of splits."""
    w = table(spark, sf_dir, "window_plan").select("from_revision", "to_revision", "split", "window_id")
    start, end = T.step_of(F.col("from_revision")), T.step_of(F.col("to_revision"))
    order = F.when(F.col("split") == "primary", 1).when(F.col("split") == "secondary", 2).otherwise(3)
    rows = w.withColumn("batch_idx_start", start).withColumn("batch_idx_end_exclusive", end).withColumn("batch_count", end - start)
    return rows.select(F.concat_ws("_to_", "from_revision", "to_revision").alias("planned_id"), "window_id", "split", order.alias("split_order"), "batch_idx_start", "batch_idx_end_exclusive", "batch_count")


def parse_step(spark, sf_dir):
    """Steps of all revisions and sequence ids; null for what is no revision."""
    w = table(spark, sf_dir, "window_plan")
    texts = w.select(F.explode(F.array("from_revision", "to_revision", "window_id")).alias("revision")).distinct()
    return texts.select("revision", T.step_of(F.col("revision")).alias("step"))


def parse_window(spark, sf_dir):
    """Windows written in the four accepted ways and one that is none."""
    w = table(spark, sf_dir, "window_plan").select("from_revision", "to_revision")
    forms = F.array(*(F.concat(F.col("from_revision"), F.lit(x), F.col("to_revision")) for x in (" -> ", ":", "-", "_to_", " until ")))
    rows = w.select(F.explode(forms).alias("text"))
    a, b = T.window_parts(F.col("text"))
    return rows.select("text", a.alias("from_revision"), b.alias("to_revision"))


def shard_prune(spark, sf_dir):
    """One row per window and shard file that it needs: blocks of SHARD steps, named by their end."""
    w = table(spark, sf_dir, "window_plan").where("batch_idx_end_exclusive > batch_idx_start")
    blocks = F.sequence(F.floor(F.col("batch_idx_start") / SHARD), F.floor((F.col("batch_idx_end_exclusive") - 1) / SHARD))
    return w.select("window_id", F.explode(blocks).alias("_b")).select("window_id", ((F.col("_b") + 1) * SHARD).alias("shard_end"), F.format_string("train-%06d.parquet", (F.col("_b") + 1) * SHARD).alias("file"))


def window_scan(spark, sf_dir):
    """Sequences in each planned window's half-open range, whatever window they were drawn for; a range join, as windows overlap."""
    w = table(spark, sf_dir, "window_plan").select(F.col("window_id").alias("plan_id"), "batch_idx_start", "batch_idx_end_exclusive")
    s = table(spark, sf_dir, "sampled_sequences").select("sample_id", "uid", "batch_idx").distinct()
    met = range_join(s, w, "batch_idx", "batch_idx_start", "batch_idx_end_exclusive")
    return met.groupBy("plan_id").agg(F.count(F.lit(1)).alias("sequences"), F.min("batch_idx").alias("first_batch"), F.max("batch_idx").alias("last_batch"), F.count_distinct("uid").alias("uids"))


def sample_record(spark, sf_dir):
    s = table(spark, sf_dir, "sampled_sequences")
    tokens = F.when(F.col("token_ids").isNull(), 0).otherwise(F.size("token_ids"))
    return s.select(F.concat_ws("__", "window_id", "uid").alias("sample_id"), "uid", "batch_idx", tokens.alias("token_count"), "source_file", F.col("source.from_revision").alias("from_revision"), F.col("source.to_revision").alias("to_revision")).distinct()


def _uids(spark, sf_dir):
    return table(spark, sf_dir, "sampled_sequences").where("window_id IS NOT NULL").select("window_id", "uid").distinct()


def _policies(spark, sf_dir, sample_size=None):
    planned = F.coalesce(F.lit(sample_size).cast("bigint"), F.col("sample_policy.sample_size"), F.lit(SAMPLE_SIZE))
    return table(spark, sf_dir, "window_plan").select("window_id", planned.alias("size"), F.col("sample_policy.seed").alias("seed"))


def seeded_sample(spark, sf_dir, sample_size=None):
    """As many sequences of each window as its plan asks for, or ``sample_size``, by the plan's seed and hash rank."""
    rows = _uids(spark, sf_dir).join(_policies(spark, sf_dir, sample_size), "window_id")
    return S.sampled_per_group(rows, "window_id", "uid", "size", "seed").select("window_id", "uid", "rank")


def sample_summary(spark, sf_dir, sample_size=None):
    """Planned and existing sequences per window, and whether the sample is complete."""
    have = _uids(spark, sf_dir).groupBy("window_id").agg(F.count(F.lit(1)).alias("existing"))
    rows = _policies(spark, sf_dir, sample_size).join(have, "window_id", "left").withColumn("existing", F.coalesce("existing", F.lit(0)))
    missing = F.greatest(F.col("size") - F.col("existing"), F.lit(0))
    return rows.select("window_id", F.col("size").alias("planned"), "existing", missing.alias("missing"), F.when(missing == 0, "completed").otherwise("partial").alias("status"))


def prefix_limit(spark, sf_dir):
    """The first 100 score rows by identifier."""
    return table(spark, sf_dir, "gradient_scores").select("score_id", "sample_id", "layer").distinct().orderBy("score_id").limit(100)


def count_by(spark, sf_dir):
    r = table(spark, sf_dir, "rollouts")
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("role_group", "question_category", "default_prompt_id", "role_source_status")))
    return r.select(F.explode(keys).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("key", "value").agg(F.count(F.lit(1)).alias("rows"))


def latest_by_id(spark, sf_dir):
    """The last score of each sample, revision and layer, by load time and identifier, with the first load time of its key."""
    g = table(spark, sf_dir, "gradient_scores").where("sample_id IS NOT NULL").select("sample_id", "checkpoint_revision", "layer", "score_id", "loaded_at", "local_aa_score")
    rows = S.latest(g, ["sample_id", "checkpoint_revision", "layer"], [F.col("loaded_at"), F.col("score_id")], [F.col("loaded_at")])
    return rows.withColumnRenamed("first_0", "first_loaded_at")


def hash_rank_subset(spark, sf_dir):
    rows = S.hash_ranked(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, SEED, "master")
    return rows.select("doc_id", "stable_hash")


def nested_subsets(spark, sf_dir, seed=SEED):
    return S.nested(table(spark, sf_dir, "documents"), "doc_id", SUBSETS, seed)


def subset_membership(spark, sf_dir):
    """Flags of every document for the nested subsets."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    flags = S.nested(docs, "doc_id", SUBSETS, SEED)
    return docs.join(flags, "doc_id", "left").select("doc_id", *(F.coalesce(F.col(n), F.lit(False)).alias(n) for n, _ in SUBSETS))


def split_hash(spark, sf_dir):
    """SHA-256 of the compact JSON list of each split's question ids."""
    q = table(spark, sf_dir, "rollouts").select("question_id").distinct()
    split = F.when(F.col("question_id") % 2 == 0, "construction").otherwise("evaluation")
    lists = q.groupBy(split.alias("split")).agg(F.sort_array(F.collect_list("question_id")).alias("ids"))  # one id per question
    return lists.select("split", F.size("ids").alias("questions"), T.list_hash(F.col("ids")).alias("hash"))


def stratified_sample(spark, sf_dir):
    rows = S.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50)
    return rows.select("doc_id", "lang", "turn")


QUERIES = {f.__name__: f for f in (
    window_plan, parse_step, parse_window, shard_prune, window_scan, sample_record, seeded_sample, sample_summary, prefix_limit, count_by, latest_by_id, hash_rank_subset, nested_subsets, subset_membership, split_hash, stratified_sample,
)}

_STEP = "TRY_CAST(nullif(regexp_extract({0}, '^step([0-9]+)$', 1), '') AS BIGINT)"
_UIDS = "WITH u AS (SELECT DISTINCT window_id, uid FROM sampled_sequences WHERE window_id IS NOT NULL), p AS (SELECT window_id, coalesce(sample_policy.sample_size, 1000) AS size, sample_policy.seed AS seed FROM window_plan)"
_NESTED = """WITH m AS (SELECT doc_id FROM documents ORDER BY sha256('1729:master:' || doc_id), doc_id LIMIT 100),
a AS (SELECT doc_id FROM m ORDER BY sha256('1729:activation_gradient:' || doc_id), doc_id LIMIT 40),
f AS (SELECT doc_id FROM a ORDER BY sha256('1729:fopci_random:' || doc_id), doc_id LIMIT 10)
"""

ORACLE = {
    "window_plan": f"""SELECT from_revision || '_to_' || to_revision AS planned_id, window_id, split, CASE split WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END AS split_order,
{_STEP.format('from_revision')} AS batch_idx_start, {_STEP.format('to_revision')} AS batch_idx_end_exclusive, {_STEP.format('to_revision')} - {_STEP.format('from_revision')} AS batch_count FROM window_plan""",
    "parse_step": f"SELECT revision, {_STEP.format('revision')} AS step FROM (SELECT DISTINCT unnest([from_revision, to_revision, window_id]) AS revision FROM window_plan)",
    "parse_window": r"""WITH t AS (SELECT from_revision || unnest([' -> ', ':', '-', '_to_', ' until ']) || to_revision AS text FROM window_plan),
b AS (SELECT text, replace(text, ' ', '') AS s FROM t)
SELECT text, nullif(regexp_extract(s, '^(step[0-9]+)(?:->|:|-|_to_)(step[0-9]+)$', 1), '') AS from_revision, nullif(regexp_extract(s, '^(step[0-9]+)(?:->|:|-|_to_)(step[0-9]+)$', 2), '') AS to_revision FROM b""",
    "shard_prune": """SELECT window_id, (b + 1) * 1000 AS shard_end, printf('train-%06d.parquet', (b + 1) * 1000) AS file
FROM (SELECT window_id, unnest(range(batch_idx_start // 1000, (batch_idx_end_exclusive - 1) // 1000 + 1)) AS b FROM window_plan WHERE batch_idx_end_exclusive > batch_idx_start)""",
    "window_scan": """SELECT w.window_id AS plan_id, count(*) AS sequences, min(s.batch_idx) AS first_batch, max(s.batch_idx) AS last_batch, count(DISTINCT uid) AS uids
FROM window_plan w JOIN (SELECT DISTINCT sample_id, uid, batch_idx FROM sampled_sequences) s ON s.batch_idx >= w.batch_idx_start AND s.batch_idx < w.batch_idx_end_exclusive GROUP BY 1""",
    "sample_record": """SELECT DISTINCT concat_ws('__', window_id, uid) AS sample_id, uid, batch_idx, coalesce(len(token_ids), 0) AS token_count, source_file, source.from_revision AS from_revision, source.to_revision AS to_revision FROM sampled_sequences""",
    "seeded_sample": _UIDS + """ SELECT window_id, uid, rank FROM (SELECT window_id, uid, size, row_number() OVER (PARTITION BY window_id ORDER BY sha256(concat_ws(':', CAST(seed AS VARCHAR), 'sample', window_id, uid)), uid) AS rank FROM u JOIN p USING (window_id)) WHERE rank <= size""",
    "sample_summary": _UIDS + """ SELECT window_id, size AS planned, coalesce(n, 0) AS existing, greatest(size - coalesce(n, 0), 0) AS missing, CASE WHEN coalesce(n, 0) >= size THEN 'completed' ELSE 'partial' END AS status
FROM p LEFT JOIN (SELECT window_id, count(*) AS n FROM u GROUP BY 1) USING (window_id)""",
    "prefix_limit": "SELECT DISTINCT score_id, sample_id, layer FROM gradient_scores ORDER BY score_id LIMIT 100",
    "count_by": "\nUNION ALL\n".join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS rows FROM rollouts WHERE {k} IS NOT NULL GROUP BY 2" for k in ("role_group", "question_category", "default_prompt_id", "role_source_status")),
    "latest_by_id": """SELECT sample_id, checkpoint_revision, layer, score_id, loaded_at, local_aa_score, first_loaded_at FROM (
SELECT *, row_number() OVER (PARTITION BY sample_id, checkpoint_revision, layer ORDER BY loaded_at DESC, score_id DESC) AS r, min(loaded_at) OVER (PARTITION BY sample_id, checkpoint_revision, layer) AS first_loaded_at
FROM gradient_scores WHERE sample_id IS NOT NULL) WHERE r = 1""",
    "hash_rank_subset": "SELECT doc_id, sha256('1729:master:' || doc_id) AS stable_hash FROM documents ORDER BY stable_hash, doc_id LIMIT 100",
    "nested_subsets": _NESTED + "SELECT doc_id, true AS master, doc_id IN (SELECT doc_id FROM a) AS activation_gradient, doc_id IN (SELECT doc_id FROM f) AS fopci_random FROM m",
    "subset_membership": _NESTED + "SELECT doc_id, doc_id IN (SELECT doc_id FROM m) AS master, doc_id IN (SELECT doc_id FROM a) AS activation_gradient, doc_id IN (SELECT doc_id FROM f) AS fopci_random FROM documents",
    "split_hash": """SELECT split, count(*) AS questions, sha256('[' || string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) || ']') AS hash
FROM (SELECT DISTINCT question_id, CASE WHEN question_id % 2 = 0 THEN 'construction' ELSE 'evaluation' END AS split FROM rollouts WHERE question_id IS NOT NULL) GROUP BY split""",
    "stratified_sample": "SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang NULLS LAST LIMIT 50",
}
