"""Sequence log-probabilities from logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def label_logprob(logits: Column, label: Column) -> Column:
    """log softmax(logits)[label], the maximum taken off first; null for an ignored label.

    A label outside the vocabulary is an error.
    """
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - most.cast("double")))
    value = F.get(logits, label).cast("double") - most.cast("double") - F.log(total)
    outside = (label < 0) | (label >= F.size(logits))
    return F.when(label == IGNORED, F.lit(None).cast("double")).when(outside, F.raise_error(F.lit("label outside the vocabulary")).cast("double")).otherwise(value)


def sequence_logprobs(steps: DataFrame, item: str = "item", logits: str = "logits", label: str = "label") -> DataFrame:
    """(item, token_count, logprob_sum, logprob_mean): ignored labels count neither in sum nor length.

    ``steps``: one row per time step. The mean of an item without labels is null.
    """
    each = steps.select(item, label_logprob(F.col(logits), F.col(label)).alias("lp"))
    n, s = F.count("lp"), F.coalesce(F.sum("lp"), F.lit(0.0))
    return each.groupBy(item).agg(n.alias("token_count"), s.alias("logprob_sum")).withColumn(
        "logprob_mean", F.when(F.col("token_count") > 0, F.col("logprob_sum") / F.col("token_count")))


def sequence_logprobs_from_arrays(rows: DataFrame, item: str, logits: str, labels: str) -> DataFrame:
    """The same from one row per item: logits array<array<double>>, labels array<int>. Unequal lengths are an error."""
    same = F.when(F.size(logits) == F.size(labels), F.lit(True)).otherwise(F.raise_error(F.lit("logits and labels differ in length")).cast("boolean"))
    steps = rows.where(same).select(item, F.inline(F.arrays_zip(F.col(logits).alias("logits"), F.col(labels).alias("label"))))
    return sequence_logprobs(steps, item)
