"""Explicit schemas of every record; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT = "struct<raw:string,normalized:string>"
HYPOTHESIS = (
    "struct<rank:int,text_raw:string,text_normalized:string,token_ids:array<bigint>,token_logprobs:array<double>,"
    "sequence_logscore:double,score_type:string,length_penalty:double,source_system_id:string,source_original_rank:int,metadata:string>"
)
ASR = f"struct<system_id:string,checkpoint:string,code_revision:string,decode_config_sha256:string,hypotheses:array<{HYPOTHESIS}>>"
PROVENANCE = "struct<created_utc:string,host:string,software_lock_sha256:string,normalizer_id:string>"
UTTERANCE = (
    f"schema_version string, utt_id string, dataset string, split string, audio_path string, reference {TEXT}, asr {ASR}, "
    f"lattice_uri string, provenance {PROVENANCE}"
)
MANIFEST = "utt_id string, dataset string, split string, audio_path string, audio_sha256 string, reference_raw string, reference_normalized string"
EC_OUTPUT = (
    "utt_id string, ec_system_id string, decoding_strategy string, output_raw string, output_normalized string, "
    "selected_candidate_rank int, lambda_value double, ec_sequence_score double, asr_sequence_score double, combined_score double, "
    "parser_status string, latency_ms double, truncated boolean, provenance string"
)
LLM_EXCHANGE = (
    "request_hash string, provider string, model_id string, messages array<struct<role:string,content:string>>, generation_parameters string, "
    f"requested_utc string, response_utc string, raw_response string, parsed_output {TEXT}, selected_candidate_rank int, parser_status string, "
    "input_tokens bigint, output_tokens bigint, latency_ms double, retry_count int, errors array<string>"
)
NBEST_LINE = "utt_id string, rank int, text_raw string, text_normalized string, sequence_logscore double, score_type string, source_system_id string"
EC_SCORES = "utt_id string, rank int, ec_score double"
EC_PAIR = "utt_id string, source_text string, target_raw string, target_normalized string, input_nbest int, serializer_id string, serializer_sha256 string"
EDIT_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions", "reference_tokens")])
EDIT_OPERATIONS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "ref", "hyp")]))

# The closed vocabularies of the contracts.
SCORE_TYPES = ("sum_logprob", "length_normalized_logprob", "rnnt_score", "unknown")
PARSER_STATUSES = ("not_applicable", "parsed", "malformed", "empty", "truncated", "provider_error")
EVIDENCE_LABELS = ("PAPER", "REFERENCE_PAPER", "INFERENCE", "RECOMMENDATION", "OPEN_GAP")
SCHEMA_VERSION = "1.0"
