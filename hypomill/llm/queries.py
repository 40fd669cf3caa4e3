"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypomill.llm import broken_pairs, leakage, packing, ranking, split_overlap, structural_dedup, text_quality, truncation
from hypomill.runtime import table


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_outputs(table(spark, d, "ec_outputs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.found(table(spark, d, "llm_exchanges"))


def p2_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges by model and defect ('none' for sound replies)."""
    judged = broken_pairs.judge(table(spark, d, "llm_exchanges"))
    return judged.groupBy("model_id", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("exchanges"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "ec_outputs"), table(spark, d, "llm_exchanges"), table(spark, d, "data_manifest"))


def p3_cut_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(table(spark, d, "ec_outputs"), table(spark, d, "llm_exchanges"), table(spark, d, "data_manifest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, d, "data_manifest"))


def p4_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_counts(table(spark, d, "data_manifest"))


def p4_row_links(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.row_links(table(spark, d, "data_manifest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return structural_dedup.found(table(spark, d, "hypothesis_lines"))


def p5_distinct_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return structural_dedup.distinct_hypotheses(table(spark, d, "hypothesis_lines"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.spans(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.found(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.plain_statistics(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_ranking, p2_found, p2_defect_counts, p3_found, p3_cut_rates, p4_found, p4_overlap_counts, p4_row_links, p5_found,
        p5_distinct_hypotheses, p7_packed, p8_found, p8_spans, p8_cleaned, p9_found, p9_statistics,
    )
}
