import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from hypomill.functions import alignment as A


def brute(ref, hyp):
    """Independent memoised backtrace with the same preference."""

    @cache
    def cost(i, j):
        if not i or not j:
            return i + j
        return min(cost(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    i, j, s, d, n = len(ref), len(hyp), 0, 0, 0
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1] and cost(i, j) == cost(i - 1, j - 1):
            i, j = i - 1, j - 1
        elif i and j and cost(i, j) == cost(i - 1, j - 1) + 1:
            i, j, s = i - 1, j - 1, s + 1
        elif i and cost(i, j) == cost(i - 1, j) + 1:
            i, d = i - 1, d + 1
        else:
            j, n = j - 1, n + 1
    return [s, d, n, len(ref)]


def pairs(k, seed=0):
    rng = random.Random(seed)
    return [[[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2)] for _ in range(k)]


def test_batched_counts_equal_backtrace():
    ps = pairs(3000)
    got = A.counts_of([r for r, _ in ps], [h for _, h in ps]).tolist()
    assert got == [brute(r, h) for r, h in ps]


def test_single_pair_form_equals_batched():
    for r, h in pairs(300, 1):
        assert list(A._plain_counts(r, h)) == A.counts_of([r], [h])[0, :3].tolist()


def test_long_texts():
    ref = [str(k % 97) for k in range(3000)]
    hyp = ref[:1000] + ["x"] + ref[1002:]
    assert A.counts_of([ref], [hyp])[0].tolist() == [1, 1, 0, 3000]


def test_trace_agrees_with_counts_and_text():
    for r, h in pairs(300, 2):
        steps = A.trace_of(r, h)
        ops = [s["op"] for s in steps]
        assert [ops.count("substitution"), ops.count("deletion"), ops.count("insertion"), len(r)] == brute(r, h)
        assert [s["ref"] for s in steps if s["ref"] is not None] == r
        assert [s["hyp"] for s in steps if s["hyp"] is not None] == h


def test_swap_keeps_errors_and_length_difference():
    for r, h in pairs(300, 3):
        a, b = brute(r, h), brute(h, r)
        assert sum(a[:3]) == sum(b[:3])
        assert a[1] - a[2] == len(r) - len(h)


@pytest.mark.parametrize("ref,hyp,want", [
    ("a b c", "a x c", (1, 0, 0, 3)), ("a b c", "a c", (0, 1, 0, 3)), ("a c", "a b c", (0, 0, 1, 2)),
    ("", "", (0, 0, 0, 0)), ("", "extra", (0, 0, 1, 0)), ("missing", "", (0, 1, 0, 1)), (None, "a", (None,) * 4), ("a", None, (None,) * 4),
])
def test_columns(spark, ref, hyp, want):
    row = spark.createDataFrame([(ref, hyp)], "r string, h string").select(A.word_edits(F.col("r"), F.col("h")).alias("e")).select("e.*").first()
    assert tuple(row) == want


def test_native_form_equals_arrow_form(spark):
    df = spark.createDataFrame([(" ".join(r), " ".join(h)) for r, h in pairs(300, 4)], "r string, h string")
    from hypomill.functions.text import word_tokens

    both = df.select(A.word_edits(F.col("r"), F.col("h")).alias("a"), A.native_edits(word_tokens(F.col("r")), word_tokens(F.col("h"))).alias("n"))
    assert both.where("a <> n").count() == 0


def test_characters_ignore_plain_blanks_only(spark):
    row = spark.createDataFrame([("a b", "a c")], "r string, h string").select(A.char_edits(F.col("r"), F.col("h")).alias("e")).select("e.*").first()
    assert tuple(row) == (1, 0, 0, 2)


def test_traces_of_long_texts_equal_those_of_short_ones():
    small, A._ARRAY_CELLS = A._ARRAY_CELLS, 10**9
    ps = pairs(200, 4) + [[list("ab" * 60 + "c"), list("ba" * 55 + "cc")]]
    try:
        want = [A.trace_of(r, h) for r, h in ps]
        A._ARRAY_CELLS = 0
        assert [A.trace_of(r, h) for r, h in ps] == want
    finally:
        A._ARRAY_CELLS = small
    for (r, h), steps in zip(ps[:200], want):
        ops = [x["op"] for x in steps]
        assert [ops.count(o) for o in ("substitution", "deletion", "insertion")] == brute(r, h)[:3]
        assert [x["ref"] for x in steps if x["ref"] is not None] == r and [x["hyp"] for x in steps if x["hyp"] is not None] == h
