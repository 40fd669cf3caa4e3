"""Nested utterance records from manifest rows and decoded beams."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.functions.jsoncanon import config_sha256
from hypomill.functions.text import conservative_english_unicode
from hypomill.operators.selection import rank_candidates

# Settings that decide what a decoder returns.
DECODE_KEYS = ("beam_size", "condition_on_previous_text", "language", "nbest", "score_type", "stochastic_fallback", "task", "temperature")


def build_records(manifest: DataFrame, beams: DataFrame, nbest: int, config: Mapping[str, Any], normalize=conservative_english_unicode, normalizer_id: str = "conservative-english@v1") -> DataFrame:
    """One nested record per manifest row, its beams ranked by score.

    ``beams``: utt_id, original_index, token_ids, sum_logprob, text. Both ranks are kept, the
    new one and the beam's place in the decoder. A row with other than ``nbest`` beams is an error.
    """
    system = f"whisper-{config.get('model', 'unknown')}"
    ranked = rank_candidates(beams.withColumn("tokens", F.size("token_ids")), "utt_id")
    hypothesis = F.struct(
        F.col("rank"), F.col("text").alias("text_raw"), normalize(F.col("text")).alias("text_normalized"), "token_ids", F.array().cast("array<double>").alias("token_logprobs"),
        F.col("sum_logprob").alias("sequence_logscore"), F.lit("sum_logprob").alias("score_type"), F.lit(None).cast("double").alias("length_penalty"),
        F.lit(system).alias("source_system_id"), (F.col("original_index") + 1).cast("int").alias("source_original_rank"),
        F.to_json(F.struct("ranking_score", F.lit(False).alias("token_logprobs_available"))).alias("metadata"))
    lists = ranked.select("utt_id", hypothesis.alias("h")).groupBy("utt_id").agg(F.array_sort(F.collect_list("h")).alias("hypotheses"))  # nbest a list
    joined = manifest.join(lists, "utt_id", "left")
    full = F.when(F.coalesce(F.size("hypotheses"), F.lit(0)) == nbest, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong number of candidates for "), F.col("utt_id"))).cast("boolean"))
    return joined.where(full).select(
        F.lit("1.0").alias("schema_version"), "utt_id", "dataset", "split", "audio_path",
        F.struct(F.col("reference_raw").alias("raw"), F.col("reference_normalized").alias("normalized")).alias("reference"),
        F.struct(F.lit(system).alias("system_id"), F.lit(str(config.get("model_sha256", "unknown"))).alias("checkpoint"), F.lit(str(config.get("package_version", "unknown"))).alias("code_revision"),
                 F.lit(config_sha256({k: config.get(k) for k in DECODE_KEYS})).alias("decode_config_sha256"), F.col("hypotheses").alias("hypotheses")).alias("asr"),
        F.lit(None).cast("string").alias("lattice_uri"),
        F.struct(F.lit(None).cast("string").alias("created_utc"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("software_lock_sha256"), F.lit(normalizer_id).alias("normalizer_id")).alias("provenance"))
