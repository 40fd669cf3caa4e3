"""JSONL artifacts: tolerant scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypomill import schemas
from hypomill.errors import ManifestError

BROKEN = "_broken"


def parse(text: Column, schema: str) -> Column:
    """JSON text by a schema; what does not fit goes to the field ``_broken``, unknown fields are ignored."""
    return F.from_json(text, f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})


def scan(spark: SparkSession, path: str, schema: str, strict: bool = True, first: int | None = None) -> DataFrame:
    """Rows of a JSONL artifact; blank lines are skipped.

    ``strict`` raises an error for a line that does not fit; otherwise such rows keep it in
    ``_broken``. ``first``: only so many rows, in file order.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if first is not None:
        if not isinstance(first, int) or isinstance(first, bool) or first < 1:
            raise ManifestError("max_records must be a positive integer")
        # a block's lines are numbered upwards; the blocks of a file follow each other
        place = (F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        lines = lines.select("value", *place).orderBy("f", "b", "i").limit(first)
    rows = lines.select(parse(F.col("value"), schema).alias("r")).select("r.*")
    if not strict:
        return rows
    ok = F.when(F.col(BROKEN).isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken line: "), F.substring(BROKEN, 1, 200))).cast("boolean"))
    return rows.where(ok).drop(BROKEN)


def manifest(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Manifest rows; with ``max_records`` the first ones in file order."""
    return _some(scan(spark, path, schemas.MANIFEST, first=max_records), path)


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """Nested utterance records; a hypothesis' open metadata map stays JSON text."""
    return _some(scan(spark, path, schemas.UTTERANCE), path)


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """Correction outputs; the open provenance map stays JSON text."""
    return _some(scan(spark, path, schemas.EC_OUTPUT), path)


def exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Cached provider exchanges; generation parameters stay JSON text."""
    return _some(scan(spark, path, schemas.LLM_EXCHANGE), path)


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _some(scan(spark, path, schemas.EC_PAIR), path)


def nbest_lines(lines: DataFrame) -> DataFrame:
    """One N-best hypothesis per line of a table with a ``payload``: its fields, and ``broken`` where it states none."""
    r = parse(F.col("payload"), schemas.NBEST_LINE)
    return lines.select("line_id", r.alias("r")).select("line_id", "r.utt_id", "r.rank", "r.text_raw", "r.text_normalized", "r.sequence_logscore", "r.score_type", "r.source_system_id", F.coalesce(F.col(f"r.{BROKEN}").isNotNull(), F.lit(True)).alias("broken"))


def _some(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ManifestError(f"no records in {path}")
    return df
