"""Record contracts as DDL, and validation of a table against one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROW_FILTER = "STRUCT<batch_idx_gte: BIGINT, batch_idx_lt: BIGINT>"
_IDENTITY = "sample_id STRING, window_id STRING, uid STRING, source_file STRING, batch_idx BIGINT, model_id STRING, checkpoint_revision STRING, hook_name STRING, layer BIGINT"
_DIAGNOSTICS = "MAP<STRING, STRUCT<count: BIGINT, mean: DOUBLE, std: DOUBLE, min: DOUBLE, p10: DOUBLE, median: DOUBLE, p90: DOUBLE, max: DOUBLE, positive_fraction: DOUBLE>>"
_RESPONSE_SOURCE = "STRUCT<mode: STRING, model: STRING>"

# The columns of each contract.
CONTRACTS = {
    "packed_stream": "uid STRING, batch_idx BIGINT, token_ids ARRAY<INT>",
    "window_plan": f"schema_version STRING, window_id STRING, from_revision STRING, to_revision STRING, split STRING, rationale STRING, priority STRING, batch_idx_start BIGINT, batch_idx_end_exclusive BIGINT, batch_count BIGINT, parquet_files ARRAY<STRING>, row_filter {_ROW_FILTER}, sample_policy STRUCT<sample_size: BIGINT, seed: BIGINT, mode: STRING, note: STRING>, source STRUCT<dataset_config: STRING, repo_id: STRING, repo_type: STRING, format: STRING, data_dir: STRING, file_pattern: STRING, official_fallback_repo_id: STRING>",
    "sampled_sequence": f"schema_version STRING, sample_id STRING, window_id STRING, uid STRING, source_file STRING, batch_idx BIGINT, token_count BIGINT, token_ids ARRAY<INT>, source STRUCT<sampler_run_dir: STRING, window_plan_id: STRING, from_revision: STRING, to_revision: STRING, repo_id: STRING, row_filter: {_ROW_FILTER}>",
    "decoded_preview": "schema_version STRING, sample_id STRING, window_id STRING, uid STRING, source_file STRING, tokenizer_id STRING, tokenizer_revision STRING, decoded_text STRING, batch_idx BIGINT, token_count BIGINT, eos_token_count BIGINT, decoded_char_count BIGINT, eos_token_id INT, preview_start STRING, preview_middle STRING, preview_end STRING",
    "subset": "schema_version STRING, sample_id STRING, window_id STRING, adaptive_selection_status STRING, stable_hash STRING, master_sample_member BOOLEAN, vector_filter_member BOOLEAN, activation_gradient_member BOOLEAN, fopci_member BOOLEAN, fopci_subset_kind STRING, fopci_stratum STRING, selection_seed BIGINT, source STRUCT<sample_jsonl: STRING, sample_jsonl_sha256: STRING, experiment_config: STRING>",
    "rollout": "rollout_id STRING, record_type STRING, question_category STRING, question STRING, prompt_text STRING, readout_policy STRING, role_id STRING, role_group STRING, role_instruction_variant_id STRING, role_instruction STRING, role_source_status STRING, default_prompt_id STRING, default_prompt STRING, question_id INT",
    "response": f"rollout_id STRING, prompt_text STRING, generated_response STRING, response_source {_RESPONSE_SOURCE}",
    "imported_response": f"response_id STRING, rollout_id STRING, record_type STRING, question_category STRING, role_id STRING, role_group STRING, default_prompt_id STRING, question_id INT, prompt_text STRING, generated_response STRING, response_char_count INT, response_word_count INT, response_source {_RESPONSE_SOURCE}, validation_tags ARRAY<STRING>",
    "activation": "schema_version STRING, activation_id STRING, rollout_id STRING, record_type STRING, model_id STRING, model_repo_id STRING, checkpoint_revision STRING, hook_name STRING, pooling_policy STRING, padding_side STRING, activation_path STRING, role_id STRING, role_group STRING, default_prompt_id STRING, question_category STRING, question_id INT, checkpoint_step INT, layer INT, prompt_token_count INT, full_token_count INT, response_token_count INT, response_token_start INT, response_token_end INT, activation_shape ARRAY<INT>, pooled_shape ARRAY<INT>, vec ARRAY<DOUBLE>",
    "axis": "axis_id STRING, variant_id STRING, model_id STRING, checkpoint_revision STRING, pooling_policy STRING, layer INT, norm DOUBLE, source_record_count INT, default_prompt_ids ARRAY<STRING>, contrast_role_groups ARRAY<STRING>, vec ARRAY<DOUBLE>",
    "loading": "group_type STRING, group_id STRING, source_record_count INT, pc1_loading DOUBLE, aa_loading DOUBLE, pc1_abs_loading_rank INT, aa_abs_loading_rank INT",
    "trajectory": "revision STRING, step BIGINT, aa_to_final_cosine DOUBLE, aa_adjacent_cosine DOUBLE, pc1_to_final_cosine DOUBLE, pc1_adjacent_cosine DOUBLE, aa_pc1_cosine DOUBLE, pc1_explained_variance_ratio DOUBLE, aa_loading_to_final_corr DOUBLE, pc1_loading_to_final_corr DOUBLE, aa_loading_adjacent_corr DOUBLE, pc1_loading_adjacent_corr DOUBLE",
    "transition": "from_revision STRING, to_revision STRING, from_step BIGINT, to_step BIGINT, transition_score DOUBLE, aa_adjacent_cosine DOUBLE, pc1_adjacent_cosine DOUBLE, aa_loading_adjacent_corr DOUBLE, pc1_loading_adjacent_corr DOUBLE, aa_pc1_cosine_delta DOUBLE, pc1_evr_delta DOUBLE",
    "filter_score": f"{_IDENTITY}, token_scope STRING, valid_token_count BIGINT, axis_scores MAP<STRING, STRUCT<mean_raw_projection: DOUBLE, max_raw_projection: DOUBLE, top_k_mean_raw_projection: DOUBLE, positive_token_fraction: DOUBLE, top_k_tokens: INT>>, mean_hidden_norm DOUBLE",
    "gradient_score": f"{_IDENTITY}, token_count BIGINT, input_token_count BIGINT, target_token_count BIGINT, loss DOUBLE, local_aa_score DOUBLE, primary_axis_dot_score DOUBLE, gradient_norm DOUBLE, update_pressure_norm DOUBLE, final_aa_score DOUBLE, final_axis_dot_score DOUBLE, primary_axis_name STRING, final_axis_name STRING, axis_scores MAP<STRING, DOUBLE>, axis_dot_scores MAP<STRING, DOUBLE>, token_axis_diagnostics {_DIAGNOSTICS}",
    "influence_score": "sample_id STRING, window_id STRING, uid STRING, checkpoint_revision STRING, parameter_scope_id STRING, subset_kind STRING, subset_stratum STRING, curvature STRING, batch_idx BIGINT, parameter_count BIGINT, loss DOUBLE, sequence_gradient_norm DOUBLE, axis_scores MAP<STRING, STRUCT<query_gradient_norm: DOUBLE, negative_gradient_dot: DOUBLE, gradient_cosine: DOUBLE>>",
    "pressure_component": "scope STRING, scope_id STRING, component_index INT, records INT, vector_dim INT, centered BOOLEAN, singular_value DOUBLE, explained_variance_ratio DOUBLE, cumulative_explained_variance_ratio DOUBLE, local_aa_cosine DOUBLE, final_aa_cosine DOUBLE, top_local_aa_score_samples ARRAY<STRING>",
    "agreement": "axis_name STRING, records BIGINT, mean_absolute_delta DOUBLE, max_absolute_delta DOUBLE, rmse DOUBLE, pearson DOUBLE, sign_agreement DOUBLE, passed BOOLEAN",
}


def schema_of(contract: str) -> StructType:
    return StructType.fromDDL(CONTRACTS[contract])


@dataclass(frozen=True)
class Rules:
    """What a table must keep: a unique key, columns without null, allowed values, and named conditions."""

    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple] = field(default_factory=dict)
    conditions: dict[str, Column] = field(default_factory=dict)


def missing_columns(df: DataFrame, contract: str) -> list[str]:
    """Columns of the contract that the table lacks or has with another type."""
    have = dict(df.dtypes)
    return [f.name for f in schema_of(contract).fields if have.get(f.name) != f.dataType.simpleString()]


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, violations): one row per rule; row rules in one pass. A condition that is null is a violation."""
    checks = {f"required:{c}": F.col(c).isNull() for c in rules.required}
    checks |= {f"allowed:{c}": F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in rules.allowed.items()}
    checks |= {f"condition:{n}": ~F.coalesce(c, F.lit(False)) for n, c in rules.conditions.items()}
    parts = []
    if checks:
        one = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in checks))).alias("x")).select("x.*"))
    if rules.key:
        repeated = df.groupBy(*rules.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("key:" + ",".join(rules.key)).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)
