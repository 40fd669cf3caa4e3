"""Candidate views over nested utterance records, and the score table everything else reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypomill.functions.alignment import char_edits, word_edits
from hypomill.functions.text import conservative_english

#: Stands for a missing rank, so its candidate comes last.
NO_RANK = 2_147_483_647


def zipped(hypotheses: Column, *fields: str, sizes: tuple[str, ...] = ()) -> Column:
    """An array of structs with some of the hypotheses' fields; ``sizes`` are lengths of array fields.

    Fields are taken one by one, so a Parquet scan reads only them and never the open maps
    and token arrays beside them. A null element has only null fields.
    """
    parts = [hypotheses[f].alias(f) for f in fields] + [F.transform(hypotheses[f], lambda x: F.coalesce(F.array_size(x), F.lit(0))).alias(f) for f in sizes]
    return F.arrays_zip(*parts)


def ordered_hypotheses(hypotheses: Column, with_tokens: bool = False) -> Column:
    """A record's hypotheses in rank order (ties in stored order), without null elements and texts.

    Stays an array: prefixes of it need no shuffle. ``rank`` counts 1..n anew; ``tokens`` is the
    number of token ids where asked for.
    """
    sizes = ("token_ids",) if with_tokens else ()
    kept = F.filter(zipped(hypotheses, "rank", "text_raw", "sequence_logscore", sizes=sizes), lambda h: h["text_raw"].isNotNull())
    fields = ["text_raw", "sequence_logscore", *sizes]
    keyed = F.transform(kept, lambda h, i: F.struct(F.coalesce(h["rank"], F.lit(NO_RANK)).alias("stored_rank"), i.alias("pos"), *(h[f].alias(f) for f in fields)))
    tokens = (lambda h: [h["token_ids"].alias("tokens")]) if with_tokens else (lambda h: [])
    return F.transform(F.array_sort(keyed), lambda h, i: F.struct((i + 1).alias("rank"), h["text_raw"].alias("text_raw"), h["sequence_logscore"].alias("sequence_logscore"), *tokens(h)))


def nbest_lists(records: DataFrame, with_tokens: bool = False) -> DataFrame:
    """(record_id, utt_id, dataset, split, system_id, reference, hypotheses): records with a reference and a candidate."""
    lists = records.where("reference.raw is not null").select(
        "record_id", "utt_id", "dataset", "split", F.col("asr.system_id").alias("system_id"), F.col("reference.raw").alias("reference"),
        ordered_hypotheses(F.col("asr.hypotheses"), with_tokens).alias("hypotheses"))
    return lists.where(F.size("hypotheses") > 0)


def candidates(records: DataFrame, with_tokens: bool = False) -> DataFrame:
    """One row per candidate of every list."""
    return nbest_lists(records, with_tokens).select(
        "record_id", "utt_id", "dataset", "split", "system_id", "reference", F.size("hypotheses").alias("n"), F.inline("hypotheses"))


def score_table(records: DataFrame, normalize=conservative_english, unit: str = "word") -> DataFrame:
    """Candidates with normalised texts and their edit counts against the reference.

    Every (record, rank) is aligned once; baselines, oracles, cut-offs and weight curves are
    aggregations of this table.
    """
    edits = word_edits if unit == "word" else char_edits
    rows = candidates(records).withColumns({"ref": normalize(F.col("reference")), "hyp": normalize(F.col("text_raw"))})
    return rows.withColumn("edits", edits(F.col("ref"), F.col("hyp")))


def ec_score(record_id: Column, rank: Column) -> Column:
    """A stand-in for an external correction model: a fixed score of each (record, rank)."""
    return -(F.conv(F.substring(F.md5(F.concat_ws(":", record_id.cast("string"), rank.cast("string"))), 1, 6), 16, 10).cast("long") % 1000) / F.lit(100.0)
