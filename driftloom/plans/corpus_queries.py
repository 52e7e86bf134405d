"""Text, prompt, response and rollout queries over ``documents``, ``rollouts``, ``fixed_responses`` and ``fixed_responses_validated``."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import corpus as C
from driftloom.session import table


def text_normalize(spark, sf_dir):
    """Every document with its white space collapsed, as length and digest."""
    c = T.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("length"), F.sha2(c, 256).alias("digest"))


def text_preview(spark, sf_dir, chars=40):
    """Start, middle and end of every document, 40 characters each unless told."""
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in T.previews(F.col("text"), chars).items()))


def token_count(spark, sf_dir):
    """Ids and end-of-document ids (0) of every sampled row."""
    ids = F.col("token_ids")
    return table(spark, sf_dir, "sampled_sequences").select("sample_id", F.when(ids.isNull(), 0).otherwise(F.size(ids)).alias("tokens"), F.coalesce(F.size(F.filter(ids, lambda x: x == 0)), F.lit(0)).alias("ends")).distinct()


def next_token_pairs(spark, sf_dir):
    """Every pair of an id and the id after it with its count, over all sequences drawn."""
    s = table(spark, sf_dir, "sampled_sequences").select("sample_id", "token_ids").where(F.size("token_ids") >= 2)
    n = F.size("token_ids")
    pairs = F.arrays_zip(F.slice("token_ids", 1, n - 1).alias("input"), F.slice("token_ids", 2, n - 1).alias("target"))
    rows = s.select(F.explode(pairs).alias("p")).groupBy("p.input", "p.target").agg(F.count(F.lit(1)).alias("pairs"))
    return rows


def sanitize_id(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "run_id", F.col("doc_id").cast("string")).alias("raw_id"))
    return ids.select("raw_id", T.sanitized(F.col("raw_id")).alias("clean_id")).distinct()


def clean_response(spark, sf_dir, strip_lists=True, trim_to_sentence=True):
    f = table(spark, sf_dir, "fixed_responses")
    c = T.cleaned_response(F.col("generated_response"), strip_lists, trim_to_sentence)
    return f.select("raw_row_id", F.length(c).alias("length"), F.sha2(c, 256).alias("digest"))


def prompt_assembly(spark, sf_dir):
    """System text, prompt and response joined; rows without a response have none."""
    f = table(spark, sf_dir, "fixed_responses")
    prefix = F.concat_ws("\n\n", F.lit("Answer as asked."), "prompt_text")
    response = T.strip(F.col("generated_response"))
    full = F.when(response != "", F.concat(prefix, F.lit("\n\n"), response))
    return f.select("raw_row_id", F.length(prefix).alias("prefix_length"), F.length(full).alias("full_length"), F.sha2(full, 256).alias("digest"))


def rollout_grid(spark, sf_dir):
    return C.role_grid(*C.parts_of(table(spark, sf_dir, "rollouts")))


def default_grid(spark, sf_dir):
    _, defaults, questions = C.all_parts_of(table(spark, sf_dir, "rollouts"))
    return C.default_grid(defaults, questions)


def rollout_union(spark, sf_dir):
    """Rows of both grids by type, and how many of them the table really has."""
    r = table(spark, sf_dir, "rollouts")
    roles, defaults, questions = C.all_parts_of(r)
    grid = C.role_grid(roles, questions).unionByName(C.default_grid(defaults, questions), allowMissingColumns=True)
    have = r.select("rollout_id", F.lit(1).alias("have"))
    return grid.join(have, "rollout_id", "left").groupBy("record_type").agg(F.count(F.lit(1)).alias("planned"), F.count("have").alias("present"))


def validate_rollouts(spark, sf_dir):
    return C.rollout_violations(table(spark, sf_dir, "rollouts"))


def import_normalize(spark, sf_dir):
    """Raw responses with their rollout's fields: stripped text, characters, words."""
    return C.imported(table(spark, sf_dir, "fixed_responses"), table(spark, sf_dir, "rollouts"))


def import_validate(spark, sf_dir):
    return C.import_violations(table(spark, sf_dir, "fixed_responses"), table(spark, sf_dir, "rollouts"))


def inspect_slice(spark, sf_dir, question_id=3, role_group="assistant_like"):
    """The rollouts of one question in one group."""
    r = table(spark, sf_dir, "rollouts").where((F.col("question_id") == question_id) & (F.col("role_group") == role_group))
    return r.select("rollout_id", "role_id", "question_category", F.length("prompt_text").alias("prompt_length"))


def duplicates(spark, sf_dir):
    """Responses delivered more than once, by rollout and model."""
    f = table(spark, sf_dir, "fixed_responses").where("rollout_id IS NOT NULL")
    return f.groupBy("rollout_id", F.col("response_source.model").alias("model")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def set_ops(spark, sf_dir):
    """Rollout identifiers planned and answered: in both, only planned, only answered."""
    a = table(spark, sf_dir, "rollouts").select("rollout_id").distinct()
    b = table(spark, sf_dir, "fixed_responses").where("rollout_id IS NOT NULL").select("rollout_id").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "rollout_id", "full")
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("b").isNull(), "only_planned").otherwise("only_answered")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("ids"))


def target_check(spark, sf_dir):
    """Wanted axis names that no score row has."""
    names = table(spark, sf_dir, "gradient_scores").select(F.explode(F.map_keys("axis_scores")).alias("axis_name")).distinct()
    wanted = table(spark, sf_dir, "gradient_scores").select(F.col("primary_axis_name").alias("axis_name")).unionByName(table(spark, sf_dir, "gradient_scores").select(F.col("final_axis_name").alias("axis_name"))).where("axis_name IS NOT NULL").distinct()
    wanted = wanted.unionByName(spark.createDataFrame([("aa_missing",)], "axis_name string"))
    return wanted.join(names.withColumn("known", F.lit(True)), "axis_name", "left").select("axis_name", F.coalesce("known", F.lit(False)).alias("known"))


QUERIES = {f.__name__: f for f in (
    text_normalize, text_preview, token_count, next_token_pairs, sanitize_id, clean_response, prompt_assembly, rollout_grid, default_grid, rollout_union, validate_rollouts, import_normalize, import_validate, inspect_slice, duplicates, set_ops, target_check,
)}

_WS = r"regexp_replace({0}, '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+', ' ', 'g')"
_COLLAPSED = f"trim({_WS.format('text')})"
_STRIPPED = r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}\x1c-\x1f]+', ''), '[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}\x1c-\x1f]+$', '')"
_CLIP = "CASE WHEN length({0}) > 40 THEN left({0}, 37) || '...' ELSE {0} END"
_QUESTIONS = "q AS (SELECT question_id, min(question) AS question, min(question_category) AS question_category FROM rollouts WHERE question_id IS NOT NULL GROUP BY 1)"
_ROLES = "r AS (SELECT role_id, role_instruction_variant_id AS variant, min(role_group) AS role_group, min(role_instruction) AS instruction FROM rollouts WHERE record_type = 'role' GROUP BY 1, 2)"
_DEFAULTS = "d AS (SELECT default_prompt_id, min(default_prompt) AS default_prompt FROM rollouts WHERE record_type = 'default' GROUP BY 1)"
_ROLE_GRID = "SELECT printf('role__%s__q%03d__%s', role_id, question_id, variant) AS rollout_id, 'role' AS record_type, role_id, role_group, question_id, question_category, sha256('Role instruction:' || chr(10) || instruction || chr(10) || chr(10) || 'Question:' || chr(10) || question) AS prompt_digest FROM r, q"
_DEFAULT_GRID = "SELECT printf('default__%s__q%03d', default_prompt_id, question_id) AS rollout_id, 'default' AS record_type, default_prompt_id, question_id, question_category, sha256(CASE WHEN default_prompt IS NULL OR default_prompt = '' THEN question ELSE default_prompt || chr(10) || chr(10) || question END) AS prompt_digest FROM d, q"
_RESP = _STRIPPED.format("generated_response")
_BEFORE_LIST = r"regexp_replace(generated_response, '(?s)\n\s*(?:[-*]|[0-9]+[.)])\s+.*$', '')"

ORACLE = {
    "text_normalize": f"SELECT doc_id, length({_COLLAPSED}) AS length, sha256({_COLLAPSED}) AS digest FROM documents",
    "text_preview": "WITH p AS (SELECT doc_id, text[1:40] AS a, substr(text, CAST(greatest(0, length(text) // 2 - 20) AS BIGINT) + 1, 40) AS b, right(text, 40) AS c FROM documents) SELECT doc_id, " + ", ".join(f"{_CLIP.format('trim(' + _WS.format(k) + ')')} AS {n}" for k, n in (("a", "preview_start"), ("b", "preview_middle"), ("c", "preview_end"))) + " FROM p",
    "token_count": "SELECT DISTINCT sample_id, coalesce(len(token_ids), 0) AS tokens, coalesce(len(list_filter(token_ids, lambda x: x = 0)), 0) AS ends FROM sampled_sequences",
    "next_token_pairs": "WITH p AS (SELECT unnest(token_ids[1:len(token_ids) - 1]) AS input, unnest(token_ids[2:]) AS target FROM sampled_sequences WHERE len(token_ids) >= 2) SELECT input, target, count(*) AS pairs FROM p GROUP BY 1, 2",
    "sanitize_id": "SELECT DISTINCT raw_id, regexp_replace(raw_id, '[^a-zA-Z0-9_.-]+', '_', 'g') AS clean_id FROM (SELECT concat_ws('/', source, run_id, CAST(doc_id AS VARCHAR)) AS raw_id FROM documents)",
    "clean_response": rf"""WITH h AS (SELECT raw_row_id, regexp_replace({_STRIPPED.format(_BEFORE_LIST)}, '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]*:$', '.') AS t FROM fixed_responses),
s AS (SELECT raw_row_id, CASE WHEN regexp_extract(t, '(?s)^(.*[.?!]).*$', 1) <> '' THEN regexp_extract(t, '(?s)^(.*[.?!]).*$', 1) ELSE t END AS c FROM h)
SELECT raw_row_id, length(c) AS length, sha256(c) AS digest FROM s""",
    "prompt_assembly": f"""WITH p AS (SELECT raw_row_id, concat_ws(chr(10) || chr(10), 'Answer as asked.', prompt_text) AS prefix, {_RESP} AS response FROM fixed_responses),
f AS (SELECT *, CASE WHEN response <> '' THEN prefix || chr(10) || chr(10) || response END AS body FROM p) SELECT raw_row_id, length(prefix) AS prefix_length, length(body) AS full_length, sha256(body) AS digest FROM f""",
    "rollout_grid": f"WITH {_QUESTIONS}, {_ROLES} {_ROLE_GRID}",
    "default_grid": f"WITH {_QUESTIONS}, {_DEFAULTS} {_DEFAULT_GRID}",
    "rollout_union": f"WITH {_QUESTIONS}, {_ROLES}, {_DEFAULTS}, g AS (SELECT rollout_id, record_type FROM ({_ROLE_GRID}) UNION ALL SELECT rollout_id, record_type FROM ({_DEFAULT_GRID})) SELECT g.record_type, count(*) AS planned, count(t.rollout_id) AS present FROM g LEFT JOIN rollouts t USING (rollout_id) GROUP BY 1",
    "validate_rollouts": """WITH r AS (SELECT * FROM rollouts), c AS (
SELECT 'duplicate_ids' AS rule, count(*) AS violations FROM (SELECT rollout_id FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'empty_prompts', count(*) FROM r WHERE trim(coalesce(prompt_text, '')) = ''
UNION ALL SELECT 'roles_without_group', count(*) FROM r WHERE record_type = 'role' AND role_group IS NULL
UNION ALL SELECT 'roles_with_default', count(*) FROM r WHERE record_type = 'role' AND default_prompt_id IS NOT NULL
UNION ALL SELECT 'defaults_with_role', count(*) FROM r WHERE record_type = 'default' AND role_id IS NOT NULL
UNION ALL SELECT 'unknown_record_types', count(*) FROM r WHERE record_type IS NULL OR record_type NOT IN ('role', 'default')
UNION ALL SELECT 'groups_per_role', count(*) FROM (SELECT role_id FROM r WHERE role_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role_group) > 1)
UNION ALL SELECT 'questions_uncovered', count(*) FROM (SELECT q.question_id, d.default_prompt_id FROM (SELECT DISTINCT question_id FROM r WHERE question_id IS NOT NULL) q, (SELECT DISTINCT default_prompt_id FROM r WHERE default_prompt_id IS NOT NULL) d
  EXCEPT SELECT question_id, default_prompt_id FROM r)) SELECT rule, violations, violations = 0 AS passed FROM c""",
    "import_normalize": f"""WITH f AS (SELECT raw_row_id, rollout_id, {_RESP} AS t, response_source.model AS model FROM fixed_responses)
SELECT f.raw_row_id, f.rollout_id, r.record_type, r.role_group, r.question_id, f.model, length(t) AS response_char_count, CASE WHEN t = '' THEN 0 ELSE len(string_split({_WS.format('t')}, ' ')) END AS response_word_count FROM f JOIN rollouts r USING (rollout_id)""",
    "import_validate": f"""WITH f AS (SELECT *, {_RESP} AS t, {_STRIPPED.format('prompt_text')} AS p FROM fixed_responses), c AS (
SELECT 'duplicate_rollouts' AS rule, count(*) AS violations FROM (SELECT rollout_id FROM f WHERE rollout_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unknown_rollouts', count(*) FROM f WHERE rollout_id IS NOT NULL AND rollout_id NOT IN (SELECT rollout_id FROM rollouts)
UNION ALL SELECT 'missing_rollout_id', count(*) FROM f WHERE rollout_id IS NULL
UNION ALL SELECT 'empty_responses', count(*) FROM f WHERE coalesce(t, '') = ''
UNION ALL SELECT 'unknown_source', count(*) FROM f WHERE response_source.model IS NULL OR response_source.model = 'unknown'
UNION ALL SELECT 'prompt_mismatch', count(*) FROM f JOIN rollouts r USING (rollout_id) WHERE f.p <> {_STRIPPED.format('r.prompt_text')}
UNION ALL SELECT 'rollouts_without_response', count(*) FROM rollouts WHERE rollout_id NOT IN (SELECT rollout_id FROM f WHERE rollout_id IS NOT NULL)) SELECT rule, violations, violations = 0 AS passed FROM c""",
    "inspect_slice": "SELECT rollout_id, role_id, question_category, length(prompt_text) AS prompt_length FROM rollouts WHERE question_id = 3 AND role_group = 'assistant_like'",
    "duplicates": "SELECT rollout_id, response_source.model AS model, count(*) AS rows FROM fixed_responses WHERE rollout_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "set_ops": """WITH a AS (SELECT DISTINCT rollout_id FROM rollouts), b AS (SELECT DISTINCT rollout_id FROM fixed_responses WHERE rollout_id IS NOT NULL)
SELECT CASE WHEN a.rollout_id IS NOT NULL AND b.rollout_id IS NOT NULL THEN 'both' WHEN b.rollout_id IS NULL THEN 'only_planned' ELSE 'only_answered' END AS side, count(*) AS ids FROM a FULL JOIN b ON a.rollout_id = b.rollout_id GROUP BY 1""",
    "target_check": """WITH n AS (SELECT DISTINCT unnest(map_keys(axis_scores)) AS axis_name FROM gradient_scores), w AS (SELECT primary_axis_name AS axis_name FROM gradient_scores UNION SELECT final_axis_name FROM gradient_scores UNION SELECT 'aa_missing')
SELECT axis_name, axis_name IN (SELECT axis_name FROM n) AS known FROM w WHERE axis_name IS NOT NULL""",
}
