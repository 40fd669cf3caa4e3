"""Contract checks as columns: every row keeps its list of violations, so bad rows can be set apart or refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.operators.pairs import ranks_in_order
from hypomill.schemas import PARSER_STATUSES, SCHEMA_VERSION, SCORE_TYPES


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def not_finite(c: Column) -> Column:
    """True for NaN and infinities; null is no violation."""
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in order of declaration. An unknown condition breaks its rule."""
    named = [F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]
    return F.filter(F.array(*named), lambda v: v.isNotNull())


def utterance_rules() -> dict[str, Column]:
    """V1-V6 of a nested utterance record, V4 and V5 over its hypotheses."""
    hyps = F.col("asr.hypotheses")
    some = F.coalesce(F.size(hyps), F.lit(0)) > 0

    def any_bad(test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(hyps, lambda h: F.coalesce(test(h), F.lit(True))), F.lit(False))

    def lengths(h: Column) -> Column:
        n = F.coalesce(F.array_size(h["token_logprobs"]), F.lit(0))
        return (n > 0) & (n != F.coalesce(F.array_size(h["token_ids"]), F.lit(0)))

    def scores(h: Column) -> Column:
        each = F.coalesce(F.exists(h["token_logprobs"], lambda x: x.isNull() | not_finite(x)), F.lit(False))
        return each | not_finite(h["sequence_logscore"]) | not_finite(h["length_penalty"])

    return {
        "blank_id": blank(F.col("utt_id")) | blank(F.col("dataset")) | blank(F.col("split")) | blank(F.col("audio_path")),
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "reference": F.col("reference.raw").isNull() | F.col("reference.normalized").isNull(),
        "no_hypotheses": ~some,
        "rank_order": some & ~ranks_in_order(hyps),
        "rank_value": any_bad(lambda h: (h["rank"] < 1) | (h["source_original_rank"] < 1)),
        "token_lengths": any_bad(lambda h: F.when(h.isNull(), F.lit(False)).otherwise(lengths(h))),
        "score_not_finite": any_bad(lambda h: F.when(h.isNull(), F.lit(False)).otherwise(scores(h))),
        "score_type": any_bad(lambda h: ~h["score_type"].isin(*SCORE_TYPES)),
        "source_system": any_bad(lambda h: h["source_system_id"] != F.col("asr.system_id")),
    }


def candidate_rules() -> dict[str, Column]:
    """V14 of stored candidates: the flag in the open map tells whether token log-probabilities are there.

    A candidate without the flag breaks nothing.
    """
    def flag_differs(h: Column) -> Column:
        stated = F.get_json_object(h["metadata"], "$.token_logprobs_available")
        has = F.coalesce(F.array_size(h["token_logprobs"]), F.lit(0)) > 0
        return F.coalesce(F.when(stated == "true", ~has).when(stated == "false", has), F.lit(False))

    return {"logprob_flag": F.coalesce(F.exists("asr.hypotheses", lambda h: F.when(h.isNull(), F.lit(False)).otherwise(flag_differs(h))), F.lit(False))}


def short_lists(records: DataFrame, n: int) -> DataFrame:
    """V15: (record_id, candidates) of records with fewer than n candidates, missing lists included."""
    size = F.coalesce(F.array_size("asr.hypotheses"), F.lit(0))
    return records.select("record_id", size.alias("candidates")).where(F.col("candidates") < n)


def output_rules() -> dict[str, Column]:
    """V7 of a decoding result."""
    weight, latency, rank = F.col("lambda_value"), F.col("latency_ms"), F.col("selected_candidate_rank")
    return {
        "blank_id": blank(F.col("utt_id")) | blank(F.col("ec_system_id")) | blank(F.col("decoding_strategy")),
        "text": F.col("output_raw").isNull() | F.col("output_normalized").isNull(),
        "rank_value": F.coalesce(rank < 1, F.lit(False)),
        "lambda_range": F.coalesce((weight < 0) | (weight > 1), F.lit(False)) | not_finite(weight),
        "score_not_finite": not_finite(F.col("ec_sequence_score")) | not_finite(F.col("asr_sequence_score")) | not_finite(F.col("combined_score")),
        "latency": F.coalesce(latency < 0, F.lit(False)) | not_finite(latency),
        "parser_status": ~F.col("parser_status").isin(*PARSER_STATUSES),
    }


def exchange_rules() -> dict[str, Column]:
    """V8 of a cached model call."""
    def negative(name: str) -> Column:
        return F.coalesce(F.col(name) < 0, F.lit(False))

    return {
        "request_hash": ~F.col("request_hash").rlike("^[0-9a-f]{64}$"),
        "no_messages": F.coalesce(F.size("messages"), F.lit(0)) < 1,
        "message": F.coalesce(F.exists("messages", lambda m: F.coalesce(blank(m["role"]) | m["content"].isNull(), F.lit(True))), F.lit(False)),
        "blank_id": blank(F.col("provider")) | blank(F.col("model_id")),
        "negative_count": negative("input_tokens") | negative("output_tokens") | negative("retry_count") | negative("latency_ms"),
        "rank_value": F.coalesce(F.col("selected_candidate_rank") < 1, F.lit(False)),
        "parser_status": ~F.col("parser_status").isin(*PARSER_STATUSES),
    }


def manifest_rules() -> dict[str, Column]:
    """V9 of a manifest row."""
    return {
        "blank_id": blank(F.col("utt_id")) | blank(F.col("dataset")) | blank(F.col("split")) | blank(F.col("audio_path")),
        "audio_sha256": ~F.col("audio_sha256").rlike("^[0-9a-f]{64}$"),
        "reference": F.col("reference_raw").isNull() | blank(F.col("reference_normalized")),
    }


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with violations)."""
    c = checked(df, rules)
    return c.where(F.size("violations") == 0).drop("violations"), c.where(F.size("violations") > 0)


def strict(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, or an error that names the violations of the first bad one met."""
    c = checked(df, rules)
    sound = F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("contract broken: "), F.array_join("violations", ", "))).cast("boolean"))
    return c.where(sound).drop("violations")


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(violation, rows): how many rows break each rule, rules that none breaks included; one pass, one row a task."""
    counts = df.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()))
    each = F.array(*(F.struct(F.lit(name).alias("violation"), F.col(name).alias("rows")) for name in rules))
    return counts.select(F.inline(each))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """V10: keys that more than one row has."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def in_several_splits(df: DataFrame) -> DataFrame:
    """Utterance ids that more than one split holds. Splits differ as spelled; case and '_' for '-' do not matter."""
    split = F.regexp_replace(F.lower(F.trim("split")), "_", "-")
    ids = df.where("utt_id is not null and split is not null").select("utt_id", split.alias("split")).groupBy("utt_id", "split").agg(F.count(F.lit(1)).alias("rows"))
    return ids.groupBy("utt_id").agg(F.count(F.lit(1)).alias("splits"), F.sum("rows").alias("rows")).where("splits > 1")


def expected_counts(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(split, rows, expected, ok) of every expected or present split."""
    want = df.sparkSession.createDataFrame(sorted(expected.items()), "split string, expected long")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(want), "split", "full_outer").select(
        "split", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", (F.col("expected").isNull() | (F.coalesce("rows", F.lit(0)) == F.col("expected"))).alias("ok"))


def normalizer_consensus(records: DataFrame) -> DataFrame:
    """One row: the distinct normaliser ids, rows without one, and whether there is exactly one known id."""
    ids = records.groupBy(F.col("provenance.normalizer_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(F.count("id").alias("ids"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("rows_without"), F.min("id").alias("first_id")).withColumn(
        "consensus", (F.col("ids") == 1) & (F.col("rows_without") == 0))


def requested_n(records: DataFrame, order: str) -> DataFrame:
    """Hypotheses of the first record in the given order: the N an artifact was made with."""
    return records.where("asr.hypotheses is not null").agg(F.min_by(F.size("asr.hypotheses"), F.col(order)).alias("requested_n"))
