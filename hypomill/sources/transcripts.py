"""Corpus scan: transcript files and audio of a split become manifest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypomill.errors import ManifestError
from hypomill.functions.text import conservative_english_unicode

#: First bytes of an audio file (a fixed value of the format).
AUDIO_MAGIC = "664C6143"


def transcript_lines(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(path, number, line, utt_id, reference_raw, ok) of every transcript line of a split, numbered from 1.

    A line is an id, blanks and a reference; anything else, blank lines included, is not ok.
    A chapter's transcript is a small file and is read whole, so its lines need no shuffle.
    """
    files = spark.read.text(f"{root}/{split}/*/*/*.trans.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    each = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    lines = files.select("path", F.posexplode(each).alias("number", "line")).withColumn("number", F.col("number") + 1)
    parts = r"(?U)^\s*(\S+)\s+(\S.*?)\s*$"
    return lines.select("path", "number", "line", F.regexp_extract("line", parts, 1).alias("utt_id"), F.regexp_extract("line", parts, 2).alias("reference_raw"), F.col("line").rlike(parts).alias("ok"))


def audio_probe(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(audio_path, audio_sha256, sound) of every audio file: hash and whether it begins as it should.

    Files are read whole, one a row; a deployment with long recordings hashes them in chunks
    from their paths instead (``file_sha256``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.flac").option("recursiveFileLookup", "true").load(f"{root}/{split}")
    return files.select(
        F.regexp_extract("path", rf"({split}/.*)$", 1).alias("audio_path"), F.sha2("content", 256).alias("audio_sha256"),
        ((F.col("length") >= 4) & (F.hex(F.substring("content", 1, 4)) == AUDIO_MAGIC)).alias("sound"))


def manifest(spark: SparkSession, root: str, split: str, dataset: str = "librispeech", normalize=conservative_english_unicode) -> DataFrame:
    """Manifest rows of a split. Broken lines, missing or broken audio and empty references raise an error."""
    try:
        lines = transcript_lines(spark, root, split)
    except Exception as error:
        raise ManifestError(f"no transcripts for split {split}: {error}") from error
    folder = F.regexp_extract("path", rf"({split}/.*)/[^/]+$", 1)
    rows = lines.withColumn("audio_path", F.concat(folder, F.lit("/"), F.col("utt_id"), F.lit(".flac"))).join(audio_probe(spark, root, split), "audio_path", "left")
    normal = normalize(F.col("reference_raw"))
    why = (
        F.when(~F.col("ok"), F.concat(F.lit("broken transcript line "), F.col("number").cast("string"), F.lit(" in "), F.col("path"))).when(F.col("sound").isNull(), F.concat(F.lit("missing audio: "), F.col("audio_path")))
        .when(~F.col("sound"), F.concat(F.lit("broken audio: "), F.col("audio_path"))).when(F.col("n") == "", F.concat(F.lit("empty reference: "), F.col("utt_id"))))
    checked = rows.withColumn("n", normal).withColumn("why", why)
    good = F.when(F.col("why").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("why")).cast("boolean"))
    return checked.where(good).select("utt_id", F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "audio_path", "audio_sha256", "reference_raw", F.col("n").alias("reference_normalized"))
