"""Choosing candidates: oracle, cut-offs, interpolated and closest selection, weight tuning, decoder ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypomill.errors import DecodingError
from hypomill.functions.alignment import errors, word_edits
from hypomill.operators.metrics import corpus_metrics, error_rate

#: The weight grid 0.00, 0.05, ... 1.00.
GRID = [k / 20 for k in range(21)]


def oracle_selection(scored: DataFrame) -> DataFrame:
    """Per record the candidate with the fewest errors, the earliest of equals."""
    best = F.min_by(F.struct("rank", "text_raw", "edits"), F.struct(errors(F.col("edits")).alias("e"), F.col("rank")))
    return scored.groupBy("record_id").agg(best.alias("b")).select(
        "record_id", F.col("b.rank").alias("rank"), F.col("b.text_raw").alias("text_raw"), F.col("b.edits").alias("edits"))


def first_and_best(scored: DataFrame) -> DataFrame:
    """(record_id, system_id, a, b): the edits of each record's first candidate and of its oracle, in one aggregation."""
    e = errors(F.col("edits"))
    per = scored.groupBy("record_id").agg(
        F.min_by(F.struct("system_id", "edits"), "rank").alias("first"), F.min_by("edits", F.struct(e.alias("e"), F.col("rank"))).alias("b"))
    return per.select("record_id", "first.system_id", F.col("first.edits").alias("a"), "b")


def cut_offs(n: Column) -> Column:
    """The N at which oracles are reported: 1, 5 (or fewer) and all."""
    return F.array_sort(F.array_distinct(F.array(F.lit(1), F.least(F.lit(5), n), n)))


def oracle_by_n(scored: DataFrame) -> DataFrame:
    """Oracle error rate by number of candidates looked at; every N from one gathering of each list.

    A record with fewer than N candidates counts with all it has.
    """
    return corpus_metrics(best_at_cut_offs(scored), "requested_n")


def best_at_cut_offs(scored: DataFrame) -> DataFrame:
    """(requested_n, edits): the best candidate of every record among its first N, for each cut-off.

    Candidates go back to their lists once; each cut-off then takes the least of a prefix
    inside the row. A list holds as many candidates as a decoder keeps.
    """
    longest = scored.agg(F.max("rank").alias("longest"))  # one row; no candidate is aligned for it
    member = F.struct(errors(F.col("edits")).alias("e"), F.col("rank"), F.col("edits"))
    lists = scored.groupBy("record_id").agg(F.collect_list(member).alias("c")).crossJoin(F.broadcast(longest))
    best = F.transform(cut_offs(F.col("longest")), lambda n: F.struct(n.alias("requested_n"), F.array_min(F.filter("c", lambda x: x["rank"] <= n))["edits"].alias("edits")))
    return lists.select(F.inline(best))


def with_exact_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with their correction scores (record_id, rank, ec_score); both sides must cover the same ranks."""
    both = candidates.withColumn("_c", F.lit(True)).join(scores.withColumn("_s", F.lit(True)), ["record_id", "rank"], "full_outer")
    missing = F.when(F.col("_c").isNull() | F.col("_s").isNull(), F.raise_error(F.concat(F.lit("scores and candidates differ in record "), F.col("record_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(missing).drop("_c", "_s")


def score_coverage(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(record_id, rank, side) of every rank that only candidates or only scores have."""
    both = candidates.select("record_id", "rank", F.lit(1).alias("c")).join(scores.select("record_id", "rank", F.lit(1).alias("s")), ["record_id", "rank"], "full_outer")
    return both.where("c is null or s is null").select("record_id", "rank", F.when(F.col("c").isNull(), "score_only").otherwise("candidate_only").alias("side"))


def combined(weight: Column, ec: Column, asr: Column) -> Column:
    """weight * ec + (1 - weight) * asr, in this order of operations."""
    return weight * ec + (F.lit(1.0) - weight) * asr


def constrained(rows: DataFrame, weight: Column, *keys: str) -> DataFrame:
    """Per record (and key) the candidate with the highest combined score; then correction score, then rank.

    ``rows``: record_id, rank, text_raw, sequence_logscore, ec_score and whatever follows.
    An aggregation with a map side, so no record's candidates need be sorted together.
    """
    c = combined(weight, F.col("ec_score"), F.col("sequence_logscore"))
    best = F.max_by(F.struct("rank", "text_raw", "ec_score", "sequence_logscore", c.alias("combined_score"), *[F.col(x) for x in ("edits",) if x in rows.columns]),
                    F.struct(c.alias("c"), F.col("ec_score"), (-F.col("rank")).alias("r"), F.col("text_raw")))
    return rows.groupBy("record_id", *keys).agg(best.alias("b")).select("record_id", *keys, "b.*")


def _not_finite(score: str) -> Column:
    return F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))


def _with_bad(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_bad", F.max(_not_finite("sequence_logscore")).over(Window.partitionBy("record_id")))


def finite_scores(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of records whose every candidate has a finite recogniser score.

    The others cannot be decoded: ``undecodable`` gives them, and ``strict`` raises an error.
    """
    marked = _with_bad(rows)
    ok = ~F.col("_bad")
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a candidate without a finite score in record "), F.col("record_id").cast("string"))).cast("boolean"))
    return marked.where(ok).drop("_bad")


def undecodable(rows: DataFrame) -> DataFrame:
    """(record_id, rank, problem): the quarantined side of ``finite_scores``; problem is null for the sound candidates of such a list."""
    problem = F.when(F.col("sequence_logscore").isNull(), "missing").when(_not_finite("sequence_logscore"), "not finite")
    return _with_bad(rows).where("_bad").select("record_id", "rank", problem.alias("problem"))


def standardized(rows: DataFrame, *columns: str) -> DataFrame:
    """Scores shifted and scaled to mean 0 and deviation 1 within each list; a list of equal scores gets 0.

    Rounded to 12 places, so the order of summation decides no comparison.
    """
    w = Window.partitionBy("record_id")
    out = {}
    for c in columns:
        spread = F.stddev_pop(c).over(w)
        out[c] = F.when(spread > 1e-12, F.round((F.col(c) - F.avg(c).over(w)) / spread, 12)).otherwise(F.lit(0.0))
    return rows.withColumns(out)


def weight_curve(rows: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Corpus error rate of constrained decoding at every weight of the grid. ``rows`` carry ``edits``.

    Candidates are aligned once and gathered once per record; every weight then picks its
    candidate inside the row, so the grid multiplies no shuffle.
    """
    if not grid or any(not 0 <= x <= 1 for x in grid):
        raise DecodingError("weights must lie within [0, 1]")
    member = F.struct("ec_score", (-F.col("rank")).alias("r"), "text_raw", F.col("sequence_logscore").alias("s"), "edits")
    lists = rows.groupBy("record_id").agg(F.collect_list(member).alias("c"))  # one record's candidates: as many as a decoder keeps

    def best(weight: Column) -> Column:
        order = F.transform("c", lambda x: F.struct(combined(weight, x["ec_score"], x["s"]).alias("v"), x["ec_score"].alias("e"), x["r"].alias("r"), x["text_raw"].alias("t"), x["edits"].alias("edits")))
        return F.struct(weight.alias("lmb"), F.array_max(order)["edits"].alias("edits"))

    weights = F.array(*(F.lit(float(w)) for w in grid))
    return corpus_metrics(lists.select(F.inline(F.transform(weights, best))), "lmb")


def select_weight(curve: DataFrame) -> DataFrame:
    """The weight of the lowest error rate (null counts as infinite), the smallest of equals."""
    rate = F.coalesce("error_rate", F.lit(float("inf")))
    return curve.agg(F.min_by(F.struct("lmb", "error_rate"), F.struct(rate.alias("r"), F.col("lmb"))).alias("b")).select("b.lmb", "b.error_rate")


def closest(rows: DataFrame, generated: str) -> DataFrame:
    """Per record the candidate nearest to a generated text; then the better correction score, then rank.

    The generated text is the reference side of the distance.
    """
    near = rows.withColumn("word_distance", errors(word_edits(F.col(generated), F.col("hyp"))))
    best = F.min_by(F.struct("rank", "text_raw", "ec_score", "word_distance"), F.struct("word_distance", (-F.col("ec_score")).alias("s"), "rank", "text_raw"))
    return near.groupBy("record_id").agg(best.alias("b")).select("record_id", "b.*")


def unconstrained(rows: DataFrame, generated: str, normalize) -> DataFrame:
    """A free text as an output: normalised, without claiming a candidate's rank."""
    return rows.select("record_id", F.lit("unconstrained").alias("decoding_strategy"), F.col(generated).alias("output_raw"), normalize(F.col(generated)).alias("output_normalized"), F.lit(None).cast("int").alias("selected_candidate_rank"))


def ranking_score(sum_logprob: Column, tokens: Column, length_penalty: float | None) -> Column:
    """A decoder's score: per token, or by the length penalty ((5 + tokens) / 6) ** p."""
    if length_penalty is not None and not 0 <= length_penalty <= 1:
        raise DecodingError("length_penalty must lie within [0, 1]")
    size = F.when(tokens > 0, tokens.cast("double"))
    return sum_logprob / (size if length_penalty is None else F.pow((F.lit(5.0) + size) / F.lit(6.0), F.lit(float(length_penalty))))


def _beam_problem() -> Column:
    return F.when(F.coalesce("tokens", F.lit(0)) < 1, "no tokens").when(_not_finite("sum_logprob"), "score not finite")


def unrankable(rows: DataFrame, key: str) -> DataFrame:
    """(key, original_index, problem): beams without tokens or without a finite score, the quarantined side of ``rank_candidates``."""
    return rows.select(key, "original_index", _beam_problem().alias("problem")).where("problem is not null")


def rank_candidates(rows: DataFrame, key: str, length_penalty: float | None = None, strict: bool = False) -> DataFrame:
    """Rank finalised beams (key, original_index, tokens, sum_logprob) from 1; equal scores keep their order.

    Beams that cannot be ranked are what ``unrankable`` gives; ``strict`` raises an error for one.
    """
    problem = _beam_problem()
    fine = problem.isNull()
    if strict:
        fine = F.when(fine, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    known = rows.where(fine)
    scored = known.withColumn("ranking_score", ranking_score(F.col("sum_logprob"), F.col("tokens"), length_penalty))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ranking_score"), "original_index")))


def loss_and_win(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Utterances on which system a has fewer, equally many or more errors than b."""
    x, y = errors(F.col(a)), errors(F.col(b))
    return rows.groupBy(*keys).agg(F.count_if(x < y).alias("wins"), F.count_if(x == y).alias("ties"), F.count_if(x > y).alias("losses"))


def bootstrap(rows: DataFrame, a: str, b: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Paired bootstrap of an error-rate difference: one row a replicate.

    Each record's weight in a replicate is Poisson(1), drawn from a hash of (seed, record,
    replicate), four replicates a hash, so the draw is the same on every cluster. Every task
    adds its records into one vector of sums a replicate; no row is repeated.
    """
    names = ("errors_a", "errors_b", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, 3), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_pylist()
                drawn = b"".join(hashlib.md5(f"{seed}:{k}:{i}".encode()).digest() for i in ids for k in range(-(-replicates // 4)))
                u = (np.frombuffer(drawn, ">u4").reshape(len(ids), -1)[:, :replicates].astype(float) + 0.5) / 4294967296.0
                weights = np.searchsorted(POISSON_ONE, u, side="left")
                total += weights.T @ np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]]).astype(np.int64)
        yield pa.record_batch([pa.array(range(replicates), pa.int64()), *map(pa.array, total.T)], names=["replicate", *names])

    light = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col("record_id").cast("string"), errors(F.col(a)).cast("long").alias("a"), errors(F.col(b)).cast("long").alias("b"), F.col(f"{a}.reference_tokens").cast("long").alias("n"))
    sums = light.na.drop().mapInArrow(run, "replicate long, errors_a long, errors_b long, tokens long").groupBy("replicate").agg(*(F.sum(n).alias(n) for n in names))
    return sums.where("tokens > 0 or errors_a > 0 or errors_b > 0").select(
        "replicate", *names, (error_rate(F.col("errors_a"), F.col("tokens")) - error_rate(F.col("errors_b"), F.col("tokens"))).alias("difference"))


def bootstrap_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """(replicates, mean, lower, upper): the percentile interval of the difference at ``level``; one row."""
    tail = (1 - level) / 2

    def quantile(p: float) -> Column:
        return F.expr(f"percentile_disc({p!r}) within group (order by difference)")

    return replicates.agg(F.count("difference").alias("replicates"), F.avg("difference").alias("mean"), quantile(round(tail, 6)).alias("lower"), quantile(round(1 - tail, 6)).alias("upper"))


# Cumulative probabilities of a Poisson variable of mean 1.
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
