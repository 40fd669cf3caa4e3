import json

from hypomill.llm import structural_dedup as D


def lines(spark, payloads):
    return spark.createDataFrame([(k, p, "clash", b"x") for k, p in enumerate(payloads)], "line_id bigint, payload string, canonical string, root_digest binary")


def payload(utt="u", rank=1, text="Hello, World 2!", **more):
    return json.dumps({"utt_id": utt, "rank": rank, "text_raw": text} | more)


def test_formatting_does_not_matter(spark):
    same = [payload(), '{"text_raw":"hello WORLD　2","rank":1,"utt_id":"u"}', ' { "rank" : 1, "utt_id" : "u", "text_raw" : "h\\u0065llo-world2" } ', payload(score=3)]
    other = [payload(rank=2), payload(utt="v"), payload(text="hello world 3"), payload(text="world hello 2")]
    got = {(r.first_line_id, r.line_id) for r in D.found(lines(spark, same + other)).collect()}
    assert got == {(0, 1), (0, 2), (0, 3)}
    counts = {r.line_id: r.copies for r in D.distinct_hypotheses(lines(spark, same + other)).collect()}
    assert counts == {0: 4, 4: 1, 5: 1, 6: 1, 7: 1}


def test_no_hypothesis_no_copy(spark):
    rows = [None, None, "", "x", "x", "[]", "{}", "{}", '{"rank": 1}', '{"rank": 1}', payload(text=None), payload(text=None)]
    got = {(r.first_line_id, r.line_id) for r in D.found(lines(spark, rows)).collect()}
    assert got == {(8, 9), (10, 11)}
    assert D.found(lines(spark, ["x"]).where("false")).count() == 0


def test_hot_group_and_long_text(spark):
    rows = [payload(text="a b c" * 1000)] * 500 + [payload(text=f"t {k}") for k in range(500)]
    assert D.found(lines(spark, rows)).count() == 499


def test_nested_digests():
    one = {"a": {"x": "Hello, World", "y": [1, {"k": "Two!", "m": None}]}, "tags": ["b", "A"]}
    two = json.loads('{"tags": ["a", "B."], "a": {"y": [1.0, {"m": null, "k": "two"}], "x": "hello world"}}')
    rules = D.Rules(unordered=frozenset({"tags"}))
    assert D.merkle(one, rules) == D.merkle(two, rules)
    assert D.merkle(one, D.Rules())[0] != D.merkle(two, D.Rules())[0]  # without the rule an array has an order
    changed = [
        {"a": {"x": "Hello, World", "y": [{"k": "Two!", "m": None}, 1]}, "tags": ["b", "A"]}, {"a": {"y": "Hello, World", "x": [1, {"k": "Two!", "m": None}]}, "tags": ["b", "A"]},
        {"a": {"x": "Hello, World", "y": [1, {"k": "Two!"}]}, "tags": ["b", "A"]}, {"a": {"x": "Hello, World", "y": [1, {"k": "Two!", "m": "~"}]}, "tags": ["b", "A"]},
        {"a": {"x": "Hello, World", "y": [1, {"k": "Two!", "m": None}]}, "tags": ["b", "A", "A"]}, {"a": {"x": "Hello, World", "y": [[1, {"k": "Two!", "m": None}]]}, "tags": ["b", "A"]},
    ]
    for other in changed:
        assert D.merkle(other, rules)[0] != D.merkle(one, rules)[0] and D.merkle(other, rules)[1] != D.merkle(one, rules)[1]


def test_nested_records(spark):
    rows = ['{"a": {"x": 1, "y": ["P", "q"]}}', '{ "a": {"y": ["p.", "Q"], "x": 1.0}, "b": [] }', '{"b":[],"a":{"x":1,"y":["p","q"]}}', '{"a": {"x": 1, "y": ["q", "p"]}}', "[1]", "{", None]
    hashed = D.with_root_digest(lines(spark, rows), "line_id", "payload", D.Rules())
    assert {(r.first_id, r.id) for r in D.copies_of(hashed).collect()} == {(1, 2)}
    deep = "[" * 100_000 + "]" * 100_000
    assert D.with_root_digest(lines(spark, ['{"a": %s}' % deep]), "line_id", "payload", D.Rules()).count() == 0


def test_a_collision_merges_nothing(spark):
    rows = spark.createDataFrame([(1, b"d", "x"), (2, b"d", "y"), (3, b"d", "x"), (4, b"d", "y"), (5, b"e", "x"), (6, b"e", "x"), (7, b"d", "z")], "id bigint, root_digest binary, canonical string")
    assert {(r.first_id, r.id) for r in D.copies_of(rows).collect()} == {(1, 3), (2, 4), (5, 6)}
