import math

import pytest
from pyspark.sql import functions as F

from hypomill import schemas
from hypomill.operators import validation as V


def hypothesis(rank=1, ids=(1,), lps=(-0.1,), score=-1.0, kind="sum_logprob", system="s", original=1):
    return (rank, "t", "t", list(ids), list(lps), score, kind, None, system, original, "{}")


def utterances(spark, *hyps, version="1.0", utt="u"):
    row = (version, utt, "d", "dev", "a.flac", ("R", "r"), ("s", "c", "r", None, list(hyps) if hyps else None), None, ("2031", "h", None, "identity@v1"))
    return spark.createDataFrame([row], schemas.UTTERANCE)


@pytest.mark.parametrize("change,want", [
    ({}, []), ({"ids": (1, 2)}, ["token_lengths"]), ({"lps": ()}, []), ({"score": math.nan}, ["score_not_finite"]), ({"score": math.inf}, ["score_not_finite"]),
    ({"lps": (-math.inf,)}, ["score_not_finite"]), ({"kind": "x"}, ["score_type"]), ({"system": "other"}, ["source_system"]), ({"rank": 2}, ["rank_order"]), ({"original": 0}, ["rank_value"]),
])
def test_utterance(spark, change, want):
    assert V.checked(utterances(spark, hypothesis(**change)), V.utterance_rules()).first().violations == want


def test_missing_levels(spark):
    assert V.checked(utterances(spark), V.utterance_rules()).first().violations == ["no_hypotheses"]
    assert V.checked(utterances(spark, hypothesis(), hypothesis()), V.utterance_rules()).first().violations == ["rank_order"]
    assert V.checked(utterances(spark, hypothesis(), version="2.0", utt=" "), V.utterance_rules()).first().violations == ["blank_id", "schema_version"]
    nulls = spark.createDataFrame([(None,) * 9], schemas.UTTERANCE)
    assert "no_hypotheses" in V.checked(nulls, V.utterance_rules()).first().violations


def test_output(spark):
    def row(**change):
        base = dict(utt_id="u", ec_system_id="s", decoding_strategy="closest", output_raw="R", output_normalized="r", selected_candidate_rank=1, lambda_value=0.5, ec_sequence_score=0.0,
                    asr_sequence_score=None, combined_score=None, parser_status="parsed", latency_ms=1.0, truncated=None, provenance=None) | change
        return V.checked(spark.createDataFrame([tuple(base.values())], schemas.EC_OUTPUT), V.output_rules()).first().violations

    assert row() == []
    assert row(lambda_value=1.01) == ["lambda_range"]
    assert row(latency_ms=-1.0, parser_status="odd") == ["latency", "parser_status"]
    assert row(combined_score=math.nan, selected_candidate_rank=0) == ["rank_value", "score_not_finite"]


def test_exchange_and_manifest(spark):
    good = ("a" * 64, "p", "m", [("user", "x")], "{}", "t", "t", "r", None, None, "parsed", 1, 1, 1.0, 0, [])
    bad = ("A" * 64, " ", "m", [], "{}", "t", "t", "r", None, 0, "odd", -1, 1, 1.0, 0, [])
    df = spark.createDataFrame([good, bad], schemas.LLM_EXCHANGE)
    assert [r.violations for r in V.checked(df, V.exchange_rules()).collect()] == [[], ["request_hash", "no_messages", "blank_id", "negative_count", "rank_value", "parser_status"]]
    m = spark.createDataFrame([("u", "d", "s", "a", "0" * 64, "R", "r"), ("u", "d", "s", "a", "x", "R", "")], schemas.MANIFEST)
    sound, broken = V.quarantine(m, V.manifest_rules())
    assert sound.count() == 1 and broken.first().violations == ["audio_sha256", "reference"]
    with pytest.raises(Exception, match="contract broken"):
        V.strict(m, V.manifest_rules()).collect()


def test_sets(spark):
    m = spark.createDataFrame([("u", "dev-clean"), ("u", "DEV_CLEAN"), ("v", "dev-clean"), ("v", "train"), (None, "x")], "utt_id string, split string")
    assert {r.utt_id: (r.splits, r.rows) for r in V.in_several_splits(m).collect()} == {"v": (2, 2)}
    assert {r.utt_id for r in V.repeated(m, "utt_id").collect()} == {"u", "v"}
    counts = {r.split: (r.rows, r.ok) for r in V.expected_counts(m, {"train": 1, "gone": 2}).collect()}
    assert counts["train"] == (1, True) and counts["gone"] == (0, False) and counts["x"] == (1, True)


def test_consensus(spark):
    df = spark.createDataFrame([(("i",),), (("i",),)], "provenance struct<normalizer_id:string>")
    assert V.normalizer_consensus(df).first().consensus
    assert not V.normalizer_consensus(df.unionByName(df.select(F.struct(F.lit(None).cast("string").alias("normalizer_id")).alias("provenance")))).first().consensus


def test_every_exchange_rule_can_break(spark):
    """The tables at hand break none of these, so broken rows are made here."""
    good = dict(request_hash="ab" * 32, provider="p", model_id="m", messages=[("user", "say")], selected_candidate_rank=None, parser_status="parsed", input_tokens=1, output_tokens=1, latency_ms=1.0, retry_count=0)
    changes = {
        "request_hash": {"request_hash": "AB" * 32}, "no_messages": {"messages": []}, "message": {"messages": [(" ", "x")]}, "blank_id": {"model_id": ""},
        "negative_count": {"retry_count": -1}, "rank_value": {"selected_candidate_rank": 0}, "parser_status": {"parser_status": "fine"},
    }
    schema = "request_hash string, provider string, model_id string, messages array<struct<role:string,content:string>>, selected_candidate_rank int, parser_status string, input_tokens bigint, output_tokens bigint, latency_ms double, retry_count int"
    rows = [tuple((good | c).values()) for c in ({}, *changes.values())]
    counts = {r.violation: r.rows for r in V.violation_counts(spark.createDataFrame(rows, schema), V.exchange_rules()).collect()}
    assert counts == {name: 1 for name in changes}


def test_parsed_replies(spark):
    from hypomill.operators import requests

    cases = {
        "The cat sat.": ("parsed", None, "The cat sat."), "3": ("parsed", 3, None), "Rank 2.": ("parsed", 2, None), '{"answer": "yes"}': ("parsed", None, "yes"), '{"rank": 4}': ("parsed", 4, None),
        "```\nplain\n```": ("parsed", None, "plain"), "": ("empty", None, None), " \n": ("empty", None, None), '{"text": ""}': ("empty", None, None), '{"text": "cut': ("malformed", None, None), "{}": ("malformed", None, None), None: ("empty", None, None),
    }
    got = spark.createDataFrame([(c,) for c in cases], "r string").select("r", requests.parse_reply(F.col("r"), F.lit(True)).alias("p")).collect()
    assert {r.r: tuple(r.p) for r in got} == cases
    assert spark.range(1).select(requests.parse_reply(F.lit("x"), F.lit(False)).alias("p")).first().p.parser_status == "not_applicable"
