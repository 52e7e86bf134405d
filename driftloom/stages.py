"""The pipeline's stages: which tables each makes, its options, and its exit codes.

A stage makes one or more registered queries; its options are passed on to those that take them. Exit codes: 0 done, skipped or listed; 1 a failed check before
anything is written, an unknown stage, or a dry run of the sweep; 2 a result that is out of its tolerance or incomplete.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def _band(text: str) -> tuple[float, float]:
    high, low = map(float, text.split(","))
    return high, low


def _yes(text: str) -> bool:
    return text.lower() in ("1", "true", "yes", "on")


def _failed(rows: DataFrame) -> bool:
    return "passed" in rows.columns and not rows.where("NOT passed").isEmpty()


def _incomplete(rows: DataFrame) -> bool:
    return not rows.where("gradient_norm IS NULL").isEmpty()


@dataclass(frozen=True)
class Stage:
    """``options``: name to (type, help). ``refuse``: a query whose failed checks forbid writing. ``exit2``: a test of the results, by table."""

    kind: str
    tables: tuple[str, ...]
    options: dict[str, tuple[Callable, str]] = field(default_factory=dict)
    refuse: str | None = None
    exit2: dict[str, Callable[[DataFrame], bool]] = field(default_factory=dict)
    dry_run_code: int = 0


_TOLERANCE = {"tolerance": (float, "greatest difference that passes")}

STAGES = {
    "window-planner": Stage("TrainingWindowPlanner", ("window_plan", "split_filter", "shard_prune"), {"splits": (_names, "splits to keep, by comma")}),
    "sequence-sampler": Stage("TrainingSequenceSampler", ("seeded_sample", "sample_summary", "planned_scan"), {"sample_size": (int, "instead of the plan's size")}),
    "sequence-decoder": Stage("TrainingSequenceDecoder", ("decoded_text", "token_count", "text_preview"), {"vocabulary": (str, "rank file of the tokenizer"), "chars": (int, "characters of a preview")}),
    "subset-builder": Stage("ConceptAttributionSubsetBuilder", ("nested_subsets", "subset_membership", "adaptive_strata"), {"seed": (int, "of the selection")}),
    "rollout-builder": Stage("RolloutCorpusBuilder", ("rollout_grid", "default_grid", "rollout_union")),
    "response-generator": Stage("FixedResponseGenerator", ("template_generate", "prompt_assembly", "clean_response"), {"strip_lists": (_yes, "cut at the first list item"), "trim_to_sentence": (_yes, "cut after the last sentence")}),
    "response-importer": Stage("FixedResponseImporter", ("import_normalize",), refuse="import_validate"),
    "rollout-inspector": Stage("RolloutInspector", ("inspect_slice", "count_by", "compact_record"), {"question_id": (int, "question to show"), "role_group": (str, "group to show")}),
    "activation-cache": Stage("ActivationCacheRunner", ("model_forward", "normalize_ids")),
    "activation-inspector": Stage("ActivationInspector", ("activation_audit", "finite_guard", "problem_list"), exit2={"activation_audit": _failed}),
    "axis-builder": Stage("AssistantAxisBuilder", ("axis_contrast", "axis_split", "vector_shape_check")),
    "role-geometry": Stage("RoleGeometryBuilder", ("group_mean_vectors", "group_loadings", "role_pc1")),
    "geometry-report": Stage("GeometryReportBuilder", ("geometry_gate",), {"cosine": (_band, "pass,caution"), "evr": (_band, "pass,caution")}),
    "checkpoint-sweep": Stage("CheckpointSweepRunner", ("checkpoint_fan_in", "checkpoint_select", "artifact_verify"), {"revisions": (_names, "revisions to take, by comma")}, dry_run_code=1),
    "trajectory-analyzer": Stage("AxisTrajectoryAnalyzer", ("trajectory", "transition_scores", "moving_groups", "loading_corr")),
    "trajectory-plots": Stage("AxisTrajectoryPlotter", ("trajectory_plot_data",)),
    "target-bundle": Stage("ConceptTargetBundleBuilder", ("target_bundle", "split_hash", "split_coverage")),
    "vector-filter": Stage("VectorFilterRunner", ("multi_axis_filter", "vector_filter", "centered_projection"), {"axes": (_names, "targets to score, by comma"), "top_k": (int, "tokens of the top mean")}),
    "gradient-scorer": Stage("TrainingSequenceGradientScorer", ("model_gradient", "update_pressure", "token_diagnostics")),
    "fopci": Stage("FirstOrderConceptInfluenceRunner", ("parameter_influence", "parameter_scope", "axis_pivot"), exit2={"parameter_influence": _incomplete}),
    "gradient-pca": Stage("GradientPressurePCAAnalyzer", ("pca_components", "scope_rollup", "scope_top_samples"), {"components": (int, "components to keep"), "centred": (_yes, "subtract the mean")}),
    "run-comparator": Stage("GradientAttributionRunComparator", ("score_agreement", "method_comparison"), _TOLERANCE, exit2={"score_agreement": _failed}),
    "batch-invariance": Stage("ActivationGradientBatchInvarianceValidator", ("batch_invariance", "single_context"), _TOLERANCE, exit2={"batch_invariance": _failed}),
    "pilot": Stage("ConceptAttributionPilotOrchestrator", ("pilot_preflight", "resume_pending", "dependency_expand")),
    "uploader": Stage("ArtifactUploader", ("artifact_inventory", "artifact_gate"), {"prefix": (str, "folder in the repository")}, exit2={"artifact_gate": _failed}),
}


def made(stage: Stage, queries: dict, spark: SparkSession, tables: str, options: dict) -> dict[str, DataFrame]:
    """The stage's tables; each query gets the options that it has a parameter for."""
    out = {}
    for name in stage.tables:
        taken = inspect.signature(queries[name]).parameters
        out[name] = queries[name](spark, tables, **{k: v for k, v in options.items() if k in taken})
    return out


def preflight() -> dict[str, bool]:
    """Which libraries the stages and backends can use here."""
    from importlib.util import find_spec

    return {name: find_spec(name) is not None for name in ("pyspark", "pyarrow", "pandas", "numpy", "yaml", "tiktoken", "torch", "transformers")}
