"""Serialised N-best lists and training pairs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.errors import ContractError
from hypomill.functions.jsoncanon import canonical_json
from hypomill.functions.text import conservative_english
from hypomill.operators.nbest import nbest_lists
from hypomill.operators.ranges import row_numbers


@dataclass(frozen=True)
class Serializer:
    """Candidates in rank order, joined by a separator that stands between blanks."""

    serializer_id: str
    separator: str
    prefix: str = ""

    def __post_init__(self) -> None:
        if not self.separator:
            raise ContractError("separator must not be empty")

    def column(self, texts: Column) -> Column:
        """``texts``: array<string> in rank order; an empty list has no serial form (null)."""
        return F.when(F.size(texts) > 0, F.concat(F.lit(self.prefix), F.array_join(texts, f" {self.separator} ")))

    def fingerprint(self) -> str:
        """SHA-256 of every setting that shapes the text."""
        settings = {"serializer_id": self.serializer_id, "separator": self.separator, "prefix": self.prefix}
        return hashlib.sha256(canonical_json(settings).encode()).hexdigest()


# The registered separators.
SERIALIZERS = {
    "literal-sep@v1": Serializer("literal-sep@v1", "[SEP]"),
    "added-special-sep@v1": Serializer("added-special-sep@v1", "<asr_sep>"),
    "t5-sentinel@v1": Serializer("t5-sentinel@v1", "<extra_id_0>"),
}


@dataclass(frozen=True)
class TaggedSerializer(Serializer):
    """Each candidate under its own tag, one a line: ``<hyp1> text </hyp1>``."""

    separator: str = "\n"

    def column(self, texts: Column) -> Column:
        tagged = F.transform(texts, lambda t, i: F.concat(F.lit("<hyp"), (i + 1).cast("string"), F.lit("> "), t, F.lit(" </hyp"), (i + 1).cast("string"), F.lit(">")))
        return F.when(F.size(texts) > 0, F.concat(F.lit(self.prefix), F.array_join(tagged, self.separator)))


def ranks_in_order(hypotheses: Column) -> Column:
    """True exactly if there is a hypothesis and the stored ranks are 1..n in array order."""
    ranks = F.transform(hypotheses, lambda h: h["rank"])
    n = F.size(hypotheses)
    return F.coalesce((n > 0) & (ranks == F.when(n > 0, F.sequence(F.lit(1), n))), F.lit(False))


def texts_of(hypotheses: Column, n: int | None = None, order: str = "rank", seed: int = 7, key: Column | None = None) -> Column:
    """Raw texts of the first n candidates: by rank, reversed, sorted by text, or shuffled by a hash of seed, key and rank."""
    taken = hypotheses if n is None else F.slice(hypotheses, 1, n)
    if order == "reversed":
        taken = F.reverse(taken)
    elif order == "sorted":
        return F.array_sort(F.transform(taken, lambda h: h["text_raw"]))
    elif order == "shuffled":
        keyed = F.transform(taken, lambda h: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), h["rank"].cast("string"))).alias("k"), h["text_raw"].alias("text_raw")))
        return F.transform(F.array_sort(keyed), lambda h: h["text_raw"])
    elif order != "rank":
        raise ContractError(f"unknown order: {order}")
    return F.transform(taken, lambda h: h["text_raw"])


def serialized(records: DataFrame, serializer: Serializer, n: int | None = None, order: str = "rank", seed: int = 7) -> DataFrame:
    lists = nbest_lists(records)
    return lists.select("record_id", serializer.column(texts_of(F.col("hypotheses"), n, order, seed, F.col("record_id"))).alias("source_text"))


def training_pairs(records: DataFrame, serializer: Serializer, n: int, normalize=conservative_english) -> DataFrame:
    """Model input from the first n candidates, target from the reference. Lists shorter than n give no pair.

    The input never reads the reference.
    """
    if n < 1:
        raise ContractError("n must be positive")
    lists = nbest_lists(records).where(F.size("hypotheses") >= n)
    return lists.select(
        "record_id", "utt_id", serializer.column(texts_of(F.col("hypotheses"), n)).alias("source_text"), F.col("reference").alias("target_raw"),
        normalize(F.col("reference")).alias("target_normalized"), F.lit(n).alias("input_nbest"), F.lit(serializer.serializer_id).alias("serializer_id"), F.lit(serializer.fingerprint()).alias("serializer_sha256"))


def filter_by_error(scored: DataFrame, limit: float = 0.25) -> DataFrame:
    """First candidates split by error rate: ``kept`` is false above the limit; nothing is dropped silently."""
    from hypomill.functions.alignment import errors
    from hypomill.operators.metrics import error_rate

    rate = error_rate(errors(F.col("edits")), F.col("edits.reference_tokens"))
    return scored.where("rank = 1").withColumn("error_rate", rate).withColumn("kept", F.coalesce(F.col("error_rate") <= limit, F.lit(False)))


def combined_lists(records: DataFrame, per_system: int | None = None) -> DataFrame:
    """The lists of all systems of one utterance as one list: first candidates of each system first, then second ones.

    Texts that normalise alike are kept once, at their best place. Each record of an utterance
    contributes all its candidates, or at most per_system of them. An open channel may hold any number of records
    under one id, so the numbering works in ranges, not in one task per utterance.
    """
    rows = nbest_lists(records).where("utt_id is not null").select("utt_id", "system_id", "record_id", F.inline("hypotheses" if per_system is None else F.slice("hypotheses", 1, per_system)))
    best = rows.withColumn("hyp", conservative_english(F.col("text_raw"))).groupBy("utt_id", "hyp").agg(
        F.min(F.struct("rank", "system_id", "record_id")).alias("b"), F.countDistinct("system_id").alias("systems"))
    flat = best.select("utt_id", "hyp", "systems", F.col("b.rank").alias("best_rank"), F.col("b.system_id").alias("s"), F.col("b.record_id").alias("r"))
    numbered = row_numbers(flat, ["utt_id"], ["best_rank", "s", "r", "hyp"], "combined_rank")
    return numbered.select("utt_id", "hyp", "systems", "best_rank", F.col("combined_rank").cast("int").alias("combined_rank"))
