"""Error rates over a stream of recognised utterances (an extra: the batch operators define the numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypomill.functions.alignment import word_edits
from hypomill.functions.text import conservative_english
from hypomill.operators.metrics import corpus_metrics


def windowed_error_rate(stream: DataFrame, time: str, reference: str, hypothesis: str, *keys: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Corpus error rate per window of event time. Edit counts add up, so late rows within the watermark just add theirs.

    The state is four sums a window and key, whatever the number of utterances.
    """
    rows = stream.withWatermark(time, late).withColumns({"ref": conservative_english(F.col(reference)), "hyp": conservative_english(F.col(hypothesis))})
    scored = rows.withColumn("edits", word_edits(F.col("ref"), F.col("hyp"))).withColumn("window", F.window(time, window))
    total = corpus_metrics(scored, "window", *keys)
    return total.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in total.columns if c != "window"])
