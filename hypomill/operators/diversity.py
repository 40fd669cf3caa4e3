"""Diversity within N-best lists, and the evaluation bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.functions.alignment import word_edits
from hypomill.functions.text import conservative_english
from hypomill.operators.metrics import corpus_metrics
from hypomill.operators.nbest import nbest_lists, score_table
from hypomill.operators.selection import oracle_by_n


def unique_texts(records: DataFrame, requested_n: int, normalize=conservative_english) -> DataFrame:
    """Per record: unique raw and normalised texts among the first N (in order of first occurrence), and empty ones."""
    lists = nbest_lists(records).withColumn("h", F.slice("hypotheses", 1, requested_n))
    return lists.select(
        "record_id", "system_id", F.array_distinct(F.transform("h", lambda x: x["text_raw"])).alias("raw"),
        F.transform("h", lambda x: normalize(x["text_raw"])).alias("all_normalized"),
    ).select("record_id", "system_id", "raw", F.array_distinct("all_normalized").alias("normalized"), F.size(F.filter("all_normalized", lambda x: x == "")).alias("empty"))


def averages(unique: DataFrame, *keys: str) -> DataFrame:
    """Mean numbers of unique texts and the count of empty candidates."""
    sums = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("utterances"), F.sum(F.size("raw")).alias("r"), F.sum(F.size("normalized")).alias("m"), F.sum("empty").alias("empty_candidates"))
    return sums.select(*keys, "utterances", (F.col("r") / F.col("utterances")).alias("average_raw_unique"), (F.col("m") / F.col("utterances")).alias("average_normalized_unique"), "empty_candidates")


def cross_pairs(unique: DataFrame) -> DataFrame:
    """Every pair of different normalised texts of one list, the earlier one as reference.

    A list has at most N texts (a small fixed number), so its pairs are built within the row.
    """
    text = F.col("normalized")
    n = F.size(text)
    later = F.transform(text, lambda a, i: F.transform(F.slice(text, i + 2, n), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return unique.select("record_id", "system_id", F.inline(F.flatten(later)))


def cross_error_rate(unique: DataFrame, *keys: str) -> DataFrame:
    """Corpus error rate between the candidates of each list."""
    return corpus_metrics(cross_pairs(unique).withColumn("edits", word_edits(F.col("a"), F.col("b"))), *keys)


def evaluate(records: DataFrame, requested_n: int) -> DataFrame:
    """(metric, n, value, errors, tokens): baseline, oracle by N and diversity in one long table."""
    scored = score_table(records).where(F.col("rank") <= requested_n)
    # the baseline is the oracle among one candidate, so both come from one pass
    names = F.when(F.col("requested_n") == 1, F.array(F.lit("baseline"), F.lit("oracle"))).otherwise(F.array(F.lit("oracle")))
    rates = oracle_by_n(scored).select(F.explode(names).alias("metric"), F.col("requested_n").alias("n"), F.col("error_rate").alias("value"), "errors", F.col("reference_tokens").alias("tokens"))
    unique = unique_texts(records, requested_n)
    none = F.lit(None).cast("long")
    mean = averages(unique)

    def row(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(requested_n).alias("n"), value.cast("double").alias("value"), none.alias("errors"), none.alias("tokens"))

    diversity = mean.select(F.inline(F.array(*(row(m, F.col(m)) for m in ("average_raw_unique", "average_normalized_unique", "empty_candidates")))))
    cross = cross_error_rate(unique).select(F.lit("cross").alias("metric"), F.lit(requested_n).alias("n"), F.col("error_rate").alias("value"), "errors", F.col("reference_tokens").alias("tokens"))
    return rates.unionByName(diversity).unionByName(cross)
