import json

import pytest
from pyspark.sql import functions as F

from hypomill.operators import flatten as X

HYP = "struct<rank:int,text_raw:string,token_logprobs:array<double>,metadata:string>"
SCHEMA = f"record_id bigint, asr struct<hypotheses:array<{HYP}>>, hypotheses string, child string"


def meta(segments, wrap=None):
    value = {"segments": segments}
    return {None: json.dumps(value), "detail": json.dumps({"x": 1, "detail": value}), "twice": json.dumps(json.dumps(value)), "text": json.dumps({"extra": json.dumps(value)}), "list": json.dumps([[value]])}[wrap]


def run(spark, *hyps):
    df = spark.createDataFrame([(7, (list(hyps),), "clash", "clash")], SCHEMA)
    return sorted(tuple(r) for r in X.found(df).collect())


@pytest.mark.parametrize("wrap", [None, "detail", "twice", "text", "list"])
def test_segments_are_found_wherever_they_stand(spark, wrap):
    got = run(spark, (1, "t", [-0.1, None], meta([{"words": [{"w": "a"}, {"w": "b"}]}, {"no": 1}, {"words": {"w": "c"}}], wrap)))
    assert got == [("hypothesis", 7, 0, -1, -1), ("logprob", 7, 0, 0, -1), ("logprob", 7, 0, 1, -1), ("word", 7, 0, 0, 0), ("word", 7, 0, 0, 1), ("word", 7, 0, 2, 0)]


@pytest.mark.parametrize("metadata", [None, "", "no json", "{", "[]", "3", '"text"', '{"segments": null}', '{"segments": []}', '{"segments": [null, {"words": null}]}'])
def test_nothing_below(spark, metadata):
    assert run(spark, (1, "t", None, metadata)) == [("hypothesis", 7, 0, -1, -1)]


def test_objects_in_place_of_arrays(spark):
    assert run(spark, (1, "t", [], meta({"words": {"w": "a"}}))) == [("hypothesis", 7, 0, -1, -1), ("word", 7, 0, 0, 0)]


def test_null_elements_keep_their_position(spark):
    assert run(spark, None, (1, "t", [-1.0], None)) == [("hypothesis", 7, 0, -1, -1), ("hypothesis", 7, 1, -1, -1), ("logprob", 7, 1, 0, -1)]


def test_missing_levels_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, (None,), None, None), (3, ([],), None, None)], SCHEMA)
    assert X.found(df).count() == 0
    assert X.found(df.where("false")).count() == 0
    assert X.interval_nodes(df).count() == 3


def test_intervals_nest_and_link(spark):
    df = spark.createDataFrame([(7, ([(1, "one", [-0.5], meta([{"words": [{"w": "a", "p": 0.5}]}])), (2, "two", [], meta([{"words": [{"w": "b", "p": 0.25}]}, {"words": ["c"]}]))],), None, None)], SCHEMA)
    nodes = X.interval_nodes(df)
    rows = nodes.collect()
    labels = [x for r in rows for x in (r.pre, r.post)]
    assert sorted(labels) == list(range(len(labels)))
    for a in rows:
        for b in rows:
            assert a.post < b.pre or b.post < a.pre or (a.pre <= b.pre and b.post <= a.post) or (b.pre <= a.pre and a.post <= b.post)
    linked = X.contained(X.flat_table(nodes, "word"), X.flat_table(nodes, "hypothesis"))
    assert {(r.content, r.up_content, r.number) for r in linked.collect()} == {("a", "one", 0.5), ("b", "two", 0.25), ("c", "two", None)}
    assert linked.where(F.col("hyp_pos") != F.col("up_hyp_pos")).count() == 0


def test_large_record(spark):
    got = run(spark, *[(r, "t" * 5000, [-0.1] * 500, meta([{"words": [{"w": "a"}] * 50}] * 20)) for r in range(40)])
    assert len(got) == 40 * (1 + 500 + 1000)


def test_segments_in_segments_link_to_the_innermost(spark):
    inner = {"words": [{"w": "deep"}], "note": "n"}
    outer = {"words": [{"w": "a"}, {"w": "b"}], "extra": {"segments": [{"words": []}, inner]}}
    df = spark.createDataFrame([(7, ([(1, "one", [], json.dumps({"segments": [{"words": ["x"]}, outer], "k": [1, {"z": None}]}))],), None, None)], SCHEMA)
    rows = X.interval_nodes(df).collect()
    assert len({(r.record_id, r.pre) for r in rows}) == len(rows)
    by = {r.pre: r for r in rows}
    words = {r.content: r for r in rows if r.child == "word"}
    assert {w: (r.pos_one, r.pos_two) for w, r in words.items()} == {"x": (0, 0), "a": (1, 0), "b": (1, 1), "deep": (1, 0)}
    holds = lambda w: [r for r in rows if r.child == "segment" and r.pre < words[w].pre and words[w].post < r.post]
    assert len(holds("a")) == 1 and len(holds("deep")) == 2  # its segment, and the one around it
    assert max(holds("deep"), key=lambda r: r.pre).parent != holds("a")[0].parent
    # every object and array has a node, and every node lies inside its parent
    assert sorted((r.child, r.name or "") for r in rows if r.child in ("object", "array")) == sorted(
        [("object", "metadata"), ("array", "segments"), ("array", "words"), ("array", "words"), ("object", "extra"), ("array", "segments"), ("array", "words"), ("array", "words"), ("array", "k"), ("object", "")])
    for r in rows:
        assert r.parent is None or (by[r.parent].pre < r.pre and r.post < by[r.parent].post)
    assert {(r.content, r.number) for r in rows if r.child == "value"} == {("n", None), ("1", 1.0), (None, None)}


def test_words_with_further_fields_keep_them(spark):
    df = spark.createDataFrame([(7, ([(1, "one", [], meta([{"words": [{"w": "a", "p": 0.5, "alt": ["b", "c"]}]}]))],), None, None)], SCHEMA)
    nodes = X.interval_nodes(df)
    assert [(r.word, r.probability) for r in X.words(df).collect()] == [("a", 0.5)]
    assert {r.content for r in nodes.where("name is null and child = 'value'").collect()} == {"b", "c"}
