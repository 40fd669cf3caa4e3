from hypomill.operators.requests import request_sha256
from hypomill.operators.voting import vote_words
from pyspark.sql import functions as F


def words(*texts):
    return " ".join(vote_words([t.split() for t in texts]))


def test_votes():
    assert words("a x c", "a b c", "a b c") == "a b c"
    assert words("a b c") == "a b c"
    assert words("a c", "a b c", "a b c") == "a b c"
    assert words("a b c", "a c", "a c") == "a c"
    assert words("a b", "a x") == "a b"
    assert words("", "a", "a") == "a"
    assert vote_words([]) == []


def test_request_hash(spark):
    schema = "p string, m string, s array<struct<role:string,content:string>>, g string"
    rows = [("p", "m", [("user", "x")], '{"a": 1, "b": 2}'), ("p", "m", [("user", "x")], '{"b":2,"a":1}'), ("pm", "", [("user", "x")], '{"b":2,"a":1}'), ("p", "m", [("userx", "")], '{"b":2,"a":1}'), (None, None, None, None), ("p", "m", [(None, None)], "no json")]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(request_sha256(F.col("p"), F.col("m"), F.col("s"), F.col("g"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 5 and all(got)
