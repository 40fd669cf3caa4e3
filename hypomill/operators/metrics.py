"""Corpus error rates and correction diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.errors import MetricError
from hypomill.functions.alignment import char_edits, word_edits
from hypomill.functions.text import conservative_english
from hypomill.operators.nbest import candidates


def error_rate(errors: Column, reference_tokens: Column) -> Column:
    """errors / tokens; without reference tokens 0.0 if there are no errors, else null."""
    return F.when(reference_tokens > 0, errors / reference_tokens).when(errors == 0, F.lit(0.0))


def corpus_metrics(scored: DataFrame, *keys: str, also: list[Column] | None = None) -> DataFrame:
    """Ratio of sums over the rows of each key (of all rows without keys). Rows without counts add nothing.

    ``also``: further aggregates of the same rows.
    """
    sums = [F.coalesce(F.sum(f"edits.{name}"), F.lit(0)).cast("long").alias(name) for name in ("substitutions", "deletions", "insertions", "reference_tokens")]
    total = scored.groupBy(*keys).agg(F.count("edits.reference_tokens").alias("utterances"), *sums, *(also or ()))
    e = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return total.withColumn("errors", e).withColumn("error_rate", error_rate(F.col("errors"), F.col("reference_tokens")))


def first_candidates(records: DataFrame, unit: str = "word") -> DataFrame:
    """The score table of first candidates only; later ranks are cut before any alignment."""
    rows = candidates(records).where("rank = 1").withColumns({"ref": conservative_english(F.col("reference")), "hyp": conservative_english(F.col("text_raw"))})
    return rows.withColumn("edits", (word_edits if unit == "word" else char_edits)(F.col("ref"), F.col("hyp")))


def baseline(records: DataFrame, *keys: str, unit: str = "word") -> DataFrame:
    """Error rate of the first candidates."""
    return corpus_metrics(first_candidates(records, unit), *keys)


def relative_reduction(baseline_rate: Column, system_rate: Column) -> Column:
    """Relative error reduction in percent; null for a baseline of 0, an error for negative rates."""
    bad = (baseline_rate < 0) | (system_rate < 0)
    return F.when(bad, F.raise_error(F.lit("error rates must not be negative")).cast("double")).when(
        baseline_rate > 0, (baseline_rate - system_rate) / F.when(baseline_rate > 0, baseline_rate) * 100.0)


def relative_reduction_value(baseline_rate: float, system_rate: float) -> float | None:
    if baseline_rate < 0 or system_rate < 0:
        raise MetricError("error rates must not be negative")
    return None if baseline_rate == 0 else (baseline_rate - system_rate) / baseline_rate * 100.0


def correction_diagnostics(rows: DataFrame, reference: str, before: str, after: str, *keys: str, also: list[Column] | None = None) -> DataFrame:
    """What a correction did, by equality of normalised texts. Rows with a null text are no utterances.

    Right before and after, and wrong but unchanged, change no state.
    """
    r, b, a = (F.col(c) for c in (reference, before, after))
    total = rows.groupBy(*keys).agg(
        F.count_if(r.isNotNull() & b.isNotNull() & a.isNotNull()).alias("utterances"),
        F.count_if((b == a) & r.isNotNull()).alias("exact_copies"),
        F.count_if((b == r) & (a != r)).alias("correct_to_wrong"),
        F.count_if((b != r) & (a == r)).alias("wrong_to_correct"),
        F.count_if((b != r) & (a != r) & (b != a)).alias("wrong_to_other_wrong"), *(also or ()),
    )
    n = F.col("utterances")
    return total.withColumn("copy_rate", F.when(n > 0, F.col("exact_copies") / n).otherwise(F.lit(0.0)))


def positional_lengths_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty when both sides cover the same utterances."""
    return left.select(key).join(right.select(key), key, "left_anti").unionByName(right.select(key).join(left.select(key), key, "left_anti"))

