"""Prompt corpora: grids of roles, default prompts and questions; import and validation of responses.

Grids are products of configuration lists (roles, default prompts, questions), each far smaller than what is made of them. Validators return one row per rule with the number of violations, so that a
writer can refuse to write before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import text as T


def all_parts_of(rollouts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles with their variants, default prompts, and questions that a corpus was made of."""
    questions = rollouts.where("question_id IS NOT NULL").groupBy("question_id").agg(F.min("question").alias("question"), F.min("question_category").alias("question_category"))
    roles = rollouts.where("record_type = 'role'").groupBy("role_id", F.col("role_instruction_variant_id").alias("variant")).agg(F.min("role_group").alias("role_group"), F.min("role_instruction").alias("instruction"))
    defaults = rollouts.where("record_type = 'default'").groupBy("default_prompt_id").agg(F.min("default_prompt").alias("default_prompt"))
    return roles, defaults, questions


def parts_of(rollouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    roles, _, questions = all_parts_of(rollouts)
    return roles, questions


def _crossed(left: DataFrame, questions: DataFrame) -> DataFrame:
    """Every row with every question: the grid itself is the result asked for. The planner sends the smaller side round or makes blocks of both."""
    return left.crossJoin(questions)


def role_grid(roles: DataFrame, questions: DataFrame) -> DataFrame:
    prompt = F.concat(F.lit("Role instruction:\n"), "instruction", F.lit("\n\nQuestion:\n"), "question")
    rows = _crossed(roles, questions)
    return rows.select(F.format_string("role__%s__q%03d__%s", "role_id", "question_id", "variant").alias("rollout_id"), F.lit("role").alias("record_type"), "role_id", "role_group", "question_id", "question_category", F.sha2(prompt, 256).alias("prompt_digest"))


def default_grid(defaults: DataFrame, questions: DataFrame) -> DataFrame:
    prompt = F.when(F.coalesce("default_prompt", F.lit("")) == "", F.col("question")).otherwise(F.concat("default_prompt", F.lit("\n\n"), "question"))
    rows = _crossed(defaults, questions)
    return rows.select(F.format_string("default__%s__q%03d", "default_prompt_id", "question_id").alias("rollout_id"), F.lit("default").alias("record_type"), "default_prompt_id", "question_id", "question_category", F.sha2(prompt, 256).alias("prompt_digest"))


def _report(rules: dict[str, DataFrame]) -> DataFrame:
    counted = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, d in rules.items()]
    return reduce(DataFrame.unionByName, counted).withColumn("passed", F.col("violations") == 0)


def _counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row rules in one pass."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("x")).select("x.*")
    return long.withColumn("passed", F.col("violations") == 0)


def rollout_violations(r: DataFrame) -> DataFrame:
    rows = _counts(
        r,
        {
            "empty_prompts": F.trim(F.coalesce("prompt_text", F.lit(""))) == "",
            "roles_without_group": (F.col("record_type") == "role") & F.col("role_group").isNull(),
            "roles_with_default": (F.col("record_type") == "role") & F.col("default_prompt_id").isNotNull(),
            "defaults_with_role": (F.col("record_type") == "default") & F.col("role_id").isNotNull(),
            "unknown_record_types": F.col("record_type").isNull() | ~F.col("record_type").isin("role", "default"),
        },
    )
    questions, defaults = r.where("question_id IS NOT NULL").select("question_id").distinct(), r.where("default_prompt_id IS NOT NULL").select("default_prompt_id").distinct()
    groups = _report(
        {
            "duplicate_ids": r.groupBy("rollout_id").count().where("count > 1"),
            "groups_per_role": r.where("role_id IS NOT NULL").groupBy("role_id").agg(F.count_distinct("role_group").alias("n")).where("n > 1"),
            "questions_uncovered": _crossed(defaults, questions).join(r, ["question_id", "default_prompt_id"], "left_anti"),
        }
    )
    return rows.unionByName(groups)


def imported(responses: DataFrame, rollouts: DataFrame) -> DataFrame:
    t = T.strip(F.col("generated_response"))
    rows = responses.select("raw_row_id", "rollout_id", t.alias("_t"), F.col("response_source.model").alias("model"))
    joined = rows.join(rollouts.select("rollout_id", "record_type", "role_group", "question_id"), "rollout_id")
    return joined.select("raw_row_id", "rollout_id", "record_type", "role_group", "question_id", "model", F.length("_t").alias("response_char_count"), T.word_count(F.col("_t")).alias("response_word_count"))


def import_violations(responses: DataFrame, rollouts: DataFrame) -> DataFrame:
    f = responses
    rows = _counts(
        f,
        {
            "missing_rollout_id": F.col("rollout_id").isNull(),
            "empty_responses": F.coalesce(T.strip(F.col("generated_response")), F.lit("")) == "",
            "unknown_source": F.col("response_source.model").isNull() | (F.col("response_source.model") == "unknown"),
        },
    )
    known = f.where("rollout_id IS NOT NULL")
    prompts = rollouts.select("rollout_id", T.strip(F.col("prompt_text")).alias("_planned"))
    groups = _report(
        {
            "duplicate_rollouts": known.groupBy("rollout_id").count().where("count > 1"),
            "unknown_rollouts": known.join(rollouts, "rollout_id", "left_anti"),
            "prompt_mismatch": known.select("rollout_id", T.strip(F.col("prompt_text")).alias("_p")).join(prompts, "rollout_id").where("_p <> _planned"),
            "rollouts_without_response": rollouts.join(known, "rollout_id", "left_anti"),
        }
    )
    return rows.unionByName(groups)
