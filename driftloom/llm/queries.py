"""Queries of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import ledger, mixing, packing, pairs, percentiles, pii, spans, topn, truncation
from driftloom.llm.sql import ORACLE
from driftloom.llm.tokens import token_count
from driftloom.session import cut, own_folder, spread, table

SHARED_IDS = 32
SAMPLE_PARTS, SAMPLE_SHARE, SAMPLE_SEED = ("sample_id", "batch_idx", "window_id"), 0.2, 1729
#: Ends of the first two generations; the third knows all rows.
GENERATIONS = ("2025-07-01", "2025-10-01", None)
#: The session's setting for the shared folder of selection ledgers.
LEDGER_FOLDER = "spark.driftloom.ledgers"
#: The relative error stated for percentiles, and the little less that the sketch itself takes.
ALPHA, SKETCH_ALPHA = 0.01, 0.01 * (1 - 1e-6)
LEVELS, METRICS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), ("local_aa_score", "loss")
TOP_N, TOP_SCORES = 10, ("local_aa_score", "primary_axis_dot_score")
CAPACITY = 2049


SOURCE = ("source_1", "source_2")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fixed_responses_validated")
    source = [F.col("response_source.mode"), F.col("response_source.model")]
    return cut(truncation.features(rows, "response_id", "generated_response", "prompt_text", "response_word_count", source))


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "fixed_responses_validated"), _features(spark, sf_dir), "generated_response", SOURCE)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"source_1": "mode", "source_2": "model"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir).where("cut").select(F.col("key").alias("response_id"))


def p1_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(truncation.cut_shares(_truncated(spark, sf_dir), SOURCE))


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(truncation.significant_lengths(_features(spark, sf_dir), SOURCE))


def p2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal repeat of two sequences, with both starts and its length."""
    found = spans.repeats(table(spark, sf_dir, "sampled_sequences"), "sample_id", "token_ids", SHARED_IDS)
    return found.withColumnsRenamed({"key_a": "sample_id_a", "key_b": "sample_id_b"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repeats(spark, sf_dir).select("sample_id_a", "sample_id_b").distinct()


def p2_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of each sequence, with how many sequences and places hold the same ids."""
    found = spans.classes(table(spark, sf_dir, "sampled_sequences"), "sample_id", "token_ids", SHARED_IDS)
    return found.select(F.col("key").alias("sample_id"), "start", "n_ids", "records", "places")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(table(spark, sf_dir, "sampled_sequences"), "sample_id", "token_ids", SHARED_IDS).withColumnRenamed("key", "sample_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fixed_responses_validated")
    found = pairs.defects(rows, _truncated(spark, sf_dir), "response_id", "prompt_text", "generated_response")
    return found.withColumnRenamed("key", "response_id")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("responses"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three generations of the table.

    It lies in the folder that LEDGER_FOLDER names in the session, and what a run finds there it keeps: generations that are written are read, not
    drawn again. Where the session names none, the run has a folder of its own beneath the checkpoints."""
    named = spark.conf.get(LEDGER_FOLDER, None)
    path = f"{named or own_folder(spark, 'ledgers')}/sampled_sequences"
    keys = cut(ledger.distinct_keys(table(spark, sf_dir, "sampled_sequences"), SAMPLE_PARTS, SAMPLE_SEED, ("added_at", "loaded_at")))
    for generation, end in enumerate(GENERATIONS, 1):
        known = keys if end is None else keys.where(F.col("seen_at") < F.lit(end).cast("timestamp_ntz"))
        ledger.extend(known, path, SAMPLE_PARTS, SAMPLE_SHARE, SAMPLE_SEED, generation)
    return ledger.load(spark, path).select(*SAMPLE_PARTS, "generation")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gradient_scores").where(F.col("window_id").isNotNull())


def _estimates(counts: DataFrame) -> DataFrame:
    """Estimates to nine significant digits, which costs a relative 5e-10 of the stated error; the sketch keeps that much below it."""
    rows = percentiles.percentiles(counts, ["window_id"], LEVELS, SKETCH_ALPHA)
    return rows.withColumn("estimate", F.format_string("%.8e", "estimate").cast("double"))


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(percentiles.sketch(_scores(spark, sf_dir), ["window_id"], METRICS, SKETCH_ALPHA))


def p6_percentiles_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles, put together from the sketches of single days."""
    days = percentiles.sketch(_scores(spark, sf_dir).withColumn("day", F.to_date("scored_at")), ["window_id", "day"], METRICS, SKETCH_ALPHA)
    return _estimates(percentiles.merge(days, ["window_id"]))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf_dir, "gradient_scores"), "window_id", TOP_SCORES, "score_id", TOP_N).select("window_id", "score_id")


def p7_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, sf_dir, "gradient_scores"), "window_id", TOP_SCORES, "score_id", TOP_N)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", token_count("text").alias("n"))
    return packing.place(sizes, "doc_id", "n", CAPACITY)


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_placed(spark, sf_dir), CAPACITY)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = mixing.texts_of(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mix(spark, texts, table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("doc_id", "source", "n_tokens", "uses")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.learn(spark, table(spark, sf_dir, "documents"), "text", table(spark, sf_dir, "given_names"), "given_name")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    found = pii.mentions(spark, table(spark, sf_dir, "documents"), "doc_id", "text", lexicon)
    return pii.confirmed(cut(found), lexicon).select("doc_id", "pii_type", "pii_text").distinct()


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p10_found(spark, sf_dir)
    return found.groupBy("pii_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(spark, table(spark, sf_dir, "documents"), "doc_id", "text", _lexicon(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_source_shares, p1_limits, p2_found, p2_repeats, p2_stretches, p2_coverage, p3_found, p3_counts, p5_sample, p6_percentiles, p6_percentiles_of_days, p7_found, p7_top_rows, p8_bins, p8_fill, p9_mix, p9_shares, p10_found, p10_counts, p10_redacted)}
