"""Metrics, selection, diversity, decoding, pairs and scoring on worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from hypomill.errors import DecodingError, MetricError
from hypomill.functions.alignment import word_edits
from hypomill.operators import diversity, metrics, nbest, pairs, scoring, selection

HYP = "struct<rank:int,text_raw:string,token_ids:array<bigint>,sequence_logscore:double,source_original_rank:int>"
SCHEMA = f"record_id bigint, utt_id string, dataset string, split string, reference struct<raw:string,normalized:string>, asr struct<system_id:string,hypotheses:array<{HYP}>>"


def record(k, reference, *texts, scores=None):
    hyps = [(r, t, [1], (scores or [-1.0 * i for i in range(1, 9)])[r - 1], r) for r, t in enumerate(texts, 1)]
    return (k, f"u{k}", "d", "s", (reference, reference) if reference is not None else None, ("sys", hyps))


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def edits(df):
    return df.withColumn("edits", word_edits(F.col("r"), F.col("h")))


def test_corpus_rate_is_a_ratio_of_sums(spark):
    df = edits(spark.createDataFrame([("north wind", "north"), ("rain", "rain again"), ("six seven eight nine ten", "six nine eight ten ten")], "r string, h string"))
    row = metrics.corpus_metrics(df).first()
    assert (row.errors, row.reference_tokens, row.error_rate) == (4, 8, 0.5)


@pytest.mark.parametrize("r,h,want", [("", "", 0.0), ("", "two words", None), ("quite gone", "", 1.0)])
def test_rate_without_reference(spark, r, h, want):
    assert metrics.corpus_metrics(edits(spark.createDataFrame([(r, h)], "r string, h string"))).first().error_rate == want


def test_corpus_of_nothing(spark):
    row = metrics.corpus_metrics(edits(spark.createDataFrame([], "r string, h string"))).first()
    assert (row.utterances, row.error_rate) == (0, 0.0)


def test_relative_reduction(spark):
    df = spark.createDataFrame([(0.08, 0.06), (0.0, 0.0), (0.1, 0.2)], "b double, s double").select(metrics.relative_reduction(F.col("b"), F.col("s")).alias("w"))
    assert [r.w for r in df.collect()] == [pytest.approx(25.0), None, pytest.approx(-100.0)]
    assert metrics.relative_reduction_value(0.4, 0.3) == pytest.approx(25.0)
    with pytest.raises(MetricError):
        metrics.relative_reduction_value(-1, 0)
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-0.1, 0.1)], "b double, s double").select(metrics.relative_reduction(F.col("b"), F.col("s"))).collect()


def test_diagnostics(spark):
    rows = [  # reference, before, after
        ("red barn", "red barn", "red barn"), ("red barn", "red barn", "bed barn"), ("tall ship", "tell ship", "tall ship"), ("tall ship", "toll ship", "tall ship"),
        ("old mill", "cold mill", "cold meal"), ("old mill", "gold mill", "gold mill"), ("old mill", None, "old mill"),
    ]
    got = metrics.correction_diagnostics(spark.createDataFrame(rows, "r string, b string, a string"), "r", "b", "a").first()
    assert (got.exact_copies, got.correct_to_wrong, got.wrong_to_correct, got.wrong_to_other_wrong) == (2, 1, 2, 1)
    assert (got.utterances, got.copy_rate) == (6, 2 / 6)
    empty = metrics.correction_diagnostics(spark.createDataFrame([], "r string, b string, a string"), "r", "b", "a").first()
    assert empty.copy_rate == 0.0


def test_length_check(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "u string") for ids in ("ab", "bc"))
    assert {r.u for r in metrics.positional_lengths_match(a, b, "u").collect()} == {"a", "c"}


def test_oracle(spark):
    df = nbest.score_table(records(spark, record(1, "boats drift past the quay", "boats drifted past quay", "boats drift past a quay", "boats drift past the quay"), record(2, "low tide", "slow tide", "low tied")))
    got = {r.record_id: r.rank for r in selection.oracle_selection(df).collect()}
    assert got == {1: 3, 2: 1}


def test_evaluation_bundle(spark):
    df = records(spark, record(1, "grey geese fly", "grey geese flew", "grey geese fly"), record(2, "home", "home", "Home!"))
    got = {(r.metric, r.n): r.value for r in diversity.evaluate(df, 2).collect()}
    assert got == {
        ("baseline", 1): 1 / 4, ("oracle", 1): 1 / 4, ("oracle", 2): 0.0, ("average_raw_unique", 2): 2.0,
        ("average_normalized_unique", 2): 1.5, ("empty_candidates", 2): 0.0, ("cross", 2): 1 / 3,
    }


def test_oracle_never_grows(spark):
    df = nbest.score_table(records(spark, record(1, "a b c", "x", "a", "a b", "b c", "a b c", "z", "y")))
    rates = [r.error_rate for r in selection.oracle_by_n(df).orderBy("requested_n").collect()]
    assert rates == sorted(rates, reverse=True) and len(rates) == 3


def test_dirty_lists(spark):
    df = records(spark, (1, "u", "d", "s", None, None), record(2, None, "a"), (3, "u", "d", "s", ("r", "r"), ("sys", None)), (4, "u", "d", "s", ("r", "r"), ("sys", [None, (2, "b", None, None, 1), (None, "c", None, None, 1), (1, None, None, None, 1), (1, "a", None, None, 1)])))
    rows = nbest.candidates(df).orderBy("rank").collect()
    assert [(r.record_id, r.rank, r.text_raw) for r in rows] == [(4, 1, "a"), (4, 2, "b"), (4, 3, "c")]


def decoding_rows(spark):
    df = nbest.score_table(records(spark, record(1, "light snow fell", "light show fell", "light snow fell", scores=[-1.5, -2.5])))
    scores = spark.createDataFrame([(1, 1, -4.0), (1, 2, -1.0)], "record_id bigint, rank int, ec_score double")
    return selection.with_exact_scores(df, scores)


def test_weights(spark):
    rows = decoding_rows(spark)
    assert selection.constrained(rows, F.lit(0.0)).first().rank == 1
    assert selection.constrained(rows, F.lit(1.0)).first().rank == 2
    curve = selection.weight_curve(rows, [0.0, 0.5, 1.0])
    assert selection.select_weight(curve).first().lmb == 0.5
    with pytest.raises(DecodingError):
        selection.weight_curve(rows, [1.01])
    assert len(selection.GRID) == 21 and selection.GRID[7] == 0.35


def test_coverage_is_exact(spark):
    c = spark.createDataFrame([(1, 1), (1, 2)], "record_id bigint, rank int")
    s = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.0)], "record_id bigint, rank int, ec_score double")
    assert {(r.record_id, r.rank, r.side) for r in selection.score_coverage(c, s).collect()} == {(1, 2, "candidate_only"), (2, 1, "score_only")}
    with pytest.raises(Exception, match="differ"):
        selection.with_exact_scores(c, s).collect()


def test_closest(spark):
    rows = nbest.score_table(records(spark, record(1, "light snow fell", "light show fell", "light snow fell"))).withColumn("ec_score", F.when(F.col("rank") == 1, -2.0).otherwise(-0.1)).withColumn("generated", F.lit("light snow falls"))
    got = selection.closest(rows, "generated").first()
    assert (got.rank, got.word_distance) == (2, 1)


def test_unconstrained_claims_no_rank(spark):
    df = spark.createDataFrame([(1, "Free Text!")], "record_id bigint, g string")
    row = selection.unconstrained(df, "g", lambda c: F.lower(c)).first()
    assert row.selected_candidate_rank is None and row.output_normalized == "free text!"


def beams(spark, *rows):
    return spark.createDataFrame([(1, i, n, s) for i, (n, s) in enumerate(rows)], "k bigint, original_index int, tokens int, sum_logprob double")


def test_candidate_ranking(spark):
    got = selection.rank_candidates(beams(spark, (4, -2.0), (2, -1.5), (4, -3.0)), "k").orderBy("rank").collect()
    assert [r.original_index for r in got] == [0, 1, 2]
    assert [round(r.ranking_score, 9) for r in got] == [-0.5, -0.75, -0.75]
    assert [r.original_index for r in selection.rank_candidates(beams(spark, (1, -2.0), (7, -2.5)), "k", 1.0).orderBy("rank").collect()] == [1, 0]
    bad = beams(spark, (0, -1.0), (1, float("nan")), (1, None))
    assert selection.rank_candidates(bad, "k").count() == 0 and selection.unrankable(bad, "k").count() == 3
    with pytest.raises(Exception, match="no tokens"):
        selection.rank_candidates(bad.where("tokens = 0"), "k", strict=True).collect()
    with pytest.raises(DecodingError):
        selection.ranking_score(F.lit(1.0), F.lit(1), 1.1)


def test_serialisers(spark):
    df = records(spark, record(1, "what was said", "one guess", "another"))
    texts = {k: pairs.serialized(df, s).first().source_text for k, s in pairs.SERIALIZERS.items()}
    assert texts == {"literal-sep@v1": "one guess [SEP] another", "added-special-sep@v1": "one guess <asr_sep> another", "t5-sentinel@v1": "one guess <extra_id_0> another"}
    assert len({s.fingerprint() for s in pairs.SERIALIZERS.values()}) == 3
    with pytest.raises(Exception):
        pairs.Serializer("x@v1", "")
    assert pairs.serialized(df, pairs.SERIALIZERS["literal-sep@v1"], order="reversed").first().source_text == "another [SEP] one guess"
    pair = pairs.training_pairs(df, pairs.SERIALIZERS["literal-sep@v1"], 2).first()
    assert (pair.source_text, pair.target_raw) == ("one guess [SEP] another", "what was said")
    assert pairs.training_pairs(df, pairs.SERIALIZERS["literal-sep@v1"], 3).count() == 0


def test_sequence_score(spark):
    logs = [[math.log(p) for p in (0.25, 0.6, 0.15)], [0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(1, logs, [1, -100]), (2, [[0.0, 0.0]], [0]), (3, [[0.0, 0.0]], [-100])], "item bigint, logits array<array<double>>, labels array<int>")
    got = {r.item: r for r in scoring.sequence_logprobs_from_arrays(df, "item", "logits", "labels").collect()}
    assert got[1].token_count == 1 and math.isclose(got[1].logprob_sum, math.log(0.6)) and math.isclose(got[1].logprob_mean, math.log(0.6))
    assert math.isclose(got[2].logprob_sum, -math.log(2))
    assert (got[3].token_count, got[3].logprob_mean) == (0, None)
    for bad in ([5], [0, 0]):
        with pytest.raises(Exception):
            scoring.sequence_logprobs_from_arrays(spark.createDataFrame([(1, [[0.0, 0.0]], bad)], "item bigint, logits array<array<double>>, labels array<int>"), "item", "logits", "labels").collect()


def test_bootstrap_is_stable(spark):
    df = nbest.score_table(records(spark, *(record(k, "a b", "a x", "a b") for k in range(40)))).where("rank = 1")
    rows = df.select("record_id", F.col("edits").alias("a"), F.col("edits").alias("b"))
    one, two = (sorted(selection.bootstrap(rows, "a", "b", 5).collect()) for _ in range(2))
    assert one == two and all(r.difference == 0 for r in one) and len({r.tokens for r in one}) > 1
    interval = selection.bootstrap_interval(selection.bootstrap(rows, "a", "b")).first()
    assert (interval.replicates, interval.lower, interval.upper) == (200, 0.0, 0.0)


def test_undecodable_lists_are_told(spark):
    rows = nbest.candidates(records(spark, record(1, "a", "a", "b", scores=[-1.0, None]), record(2, "a", "a", "b")))
    assert {(r.record_id, r.rank, r.problem) for r in selection.undecodable(rows).collect()} == {(1, 1, None), (1, 2, "missing")}
    assert {r.record_id for r in selection.finite_scores(rows).collect()} == {2}
    with pytest.raises(Exception, match="without a finite score"):
        selection.finite_scores(rows, strict=True).collect()
