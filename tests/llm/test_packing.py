import random

import pytest

from hypomill.llm import packing as K
from hypomill.llm.tokens import TokenCounter

KINDS = [("big", 64), ("small", 10)]


def check(spark, sizes, most_open=8, kinds=KINDS):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id bigint, tokens bigint").repartition(4)
    rows = K.pack(df, kinds, most_open).collect()
    for name, capacity in kinds:
        own = [r for r in rows if r.bin_name == name]
        filled, stated = {}, {}
        for r in own:
            filled[r.container] = filled.get(r.container, 0) + r.tokens
            stated.setdefault(r.container, set()).add(r.container_tokens)
        assert all(n <= capacity for n in filled.values())
        assert all(stated[c] == {n} for c, n in filled.items())
        for doc, n in enumerate(sizes):
            pieces = sorted((r.piece, r.first_token, r.tokens) for r in own if r.doc_id == doc)
            assert sum(p[2] for p in pieces) == n
            assert len(pieces) == 1 if n <= capacity else [p[1] for p in pieces] == list(range(0, n, capacity))
        yield sum(filled.values()) / (capacity * len(filled))


def test_every_token_has_a_place(spark):
    rng = random.Random(1)
    fills = list(check(spark, [rng.randint(0, 30) for _ in range(2000)]))
    assert all(f > 0.9 for f in fills)


def test_many_leftovers_merge_in_rounds(spark):
    old, K.FAN_IN = K.FAN_IN, 1
    try:
        assert min(check(spark, [9] * 40 + [7] * 40 + [3] * 40 + [1] * 40, most_open=4)) > 0.8
    finally:
        K.FAN_IN = old


def test_edges(spark):
    assert list(check(spark, [0, 0, 10, 11, 64, 65, 1000]))
    empty = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert K.pack(empty, KINDS).count() == 0
    assert K.pack(empty, []).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bounded_space(seed):
    rng = random.Random(seed)
    p, out = K.Packer(100, 5), []
    for k in range(500):
        e = p.put(rng.randint(1, 100), k)
        assert len(p.free) <= 5
        out += [e] if e else []
    out += list(p.leftovers())
    assert sorted(x for _, _, items in out for x in items) == list(range(500))


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello.", "c"), (2, None, "c"), (3, "", "c"), (1, "again", "c"), (4, "<|endoftext|> é 漢字 " * 300, "c")], "doc_id bigint, text string, tokens string")
    limits = spark.createDataFrame([("a", 50), (None, 5), ("b", 0), ("c", None)], "bin_name string, capacity_tokens int")
    rows = K.pack_documents(docs, limits).collect()
    assert {r.bin_name for r in rows} == {"a"} and {r.doc_id for r in rows} == {1, 2, 3, 4}
    n = TokenCounter().count("<|endoftext|> é 漢字 " * 300)
    assert sum(r.tokens for r in rows if r.doc_id == 4) == n > 300
