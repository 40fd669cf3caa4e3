import random

import numpy as np

from hypomill.llm import text_quality as Q
from hypomill.llm.quality_examples import EXAMPLES
from hypomill.runtime import materialize

RNG = random.Random(12)
NOUNS = "harbour miller lantern bridge meadow engine cousin tavern anchor kettle ribbon garden window castle".split()


VERBS = "carried repaired counted watched painted followed greased admired borrowed measured".split()
KINDS = "old grey narrow silent frozen heavy crooked gentle wooden distant bright patient".split()
WAYS = "across behind beside under near above beyond within".split()


def thing():
    return f"{RNG.choice(['the', 'a', 'every', 'that', 'her', 'our'])} {RNG.choice(KINDS)} {RNG.choice(NOUNS)}"


def sentence():
    s = f"{thing()} {RNG.choice(['quietly ', 'often ', ''])}{RNG.choice(VERBS)} {thing()}"
    s += f" {RNG.choice(WAYS)} {thing()}" if RNG.random() < 0.7 else ""
    s += f" {RNG.choice(['because', 'while', 'until', 'but'])} {thing()} {RNG.choice(VERBS)} {thing()}" if RNG.random() < 0.5 else ""
    return s[0].upper() + s[1:]


def made(kind):
    n = RNG.randint(6, 25)
    if kind == "prose":
        style = RNG.randrange(3)
        return {0: ". ".join(sentence() for _ in range(n)) + ".", 1: "\n".join(f"Speaker {RNG.randint(1, 3)}: {sentence()}." for _ in range(n)), 2: " ".join(sentence().lower() for _ in range(n))}[style]
    if kind == "list":
        return "\n".join(f"{RNG.choice(['- ', '* '])}the {RNG.choice(NOUNS)}" for _ in range(n)) if RNG.random() < 0.5 else "\n".join(RNG.choice(NOUNS) for _ in range(n))
    if kind == "table":
        d = RNG.choice([" | ", "\t", ";"])
        return "\n".join(d.join([RNG.choice(NOUNS), *(f"{RNG.random() * 30:.2f}" for _ in range(3))]) for _ in range(n))
    return {0: "".join(RNG.choice("{}[]<>|/\\~^%$#@!&*=+ ") for _ in range(300)), 1: "\n".join(f"[{RNG.randrange(10**9):010d}] DBG 0x{RNG.randrange(16**10):010x} {RNG.randrange(99)} nil" for _ in range(n)), 2: " ".join(["the kettle of"] * 60)}[RNG.randrange(3)]


def test_held_out_accuracy(spark):
    kinds = [RNG.choices(["prose", "list", "table", "junk"], [8, 1, 1, 1])[0] for _ in range(600)]
    rows = [(k, made(kind), "clash") for k, kind in enumerate(kinds)]
    got = {r.doc_id: r.kind for r in Q.classify(spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).collect()}
    right = sum(got[k] == kind for k, kind in enumerate(kinds))
    assert right >= 0.95 * len(kinds)


def test_expectation_maximization_decides(spark):
    rng = random.Random(5)
    kinds = [rng.choices(["prose", "list", "table", "junk"], [8, 1, 1, 1])[0] for _ in range(600)]
    docs = materialize(spark.createDataFrame([(k, made(kind)) for k, kind in enumerate(kinds)], "doc_id bigint, text string"))

    def right(**rounds):
        got = {r.doc_id: r.kind for r in Q.classify(docs, **rounds).collect()}
        return sum(got[k] == kind for k, kind in enumerate(kinds)) / len(kinds)

    with_it, without = right(), right(rounds=0, last_rounds=0)
    assert with_it >= 0.95 and without <= with_it - 0.1


def test_a_text_copied_over_and_over_changes_no_other(spark):
    rng = random.Random(6)
    kinds = [rng.choices(["prose", "list", "table", "junk"], [8, 1, 1, 1])[0] for _ in range(300)]
    rows = [(k, made(kind)) for k, kind in enumerate(kinds)]
    copies = [(1000 + k, "Her cousin painted the old bridge and nobody in the tavern was asked.") for k in range(300)]
    got = {r.doc_id: r.kind for r in Q.classify(spark.createDataFrame(rows + copies, "doc_id bigint, text string")).collect()}
    assert sum(got[k] == kind for k, kind in enumerate(kinds)) >= 0.95 * len(kinds)
    assert {got[d] for d, _ in copies} == {"prose"}


def test_no_example_is_a_text_of_the_test_data(spark):
    import os

    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/documents.parquet"
        if os.path.exists(path):
            texts = {r.text for r in spark.read.parquet(path).select("text").collect()}
            assert not texts & {t for _, t in EXAMPLES}


def test_statistics():
    s = dict(zip(Q.STATISTICS, Q.statistics("The cat sat.\nThe dog ran.")))
    assert s["line_end_punct"] == 1.0 and abs(s["word_length"] - 3) < 1e-9 and s["digit_ratio"] == 0.0
    for text in ("x", " . ", "1", "\n\n", "é" * 100000, "a b " * 100000):
        assert np.isfinite(Q.statistics(text)).all()
    assert all(len(Q.statistics(t)) == len(Q.STATISTICS) for _, t in EXAMPLES)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "One plain sentence stands here for itself."), (4, "One plain sentence stands here for itself."), (5, "word " * 50000)], "doc_id bigint, text string")
    got = [(r.doc_id, r.kind) for r in Q.classify(docs).collect()]
    assert sorted(d for d, _ in got) == [4, 4, 5]
    assert Q.found(docs.where("false")).count() == 0
    assert Q.found(docs.where("doc_id < 4")).count() == 0
    plain = {r.doc_id: r for r in Q.plain_statistics(docs).collect()}
    assert plain[1].words == 0 and plain[1].common_share is None and plain[5].words == 50000
    assert Q.plain_statistics(docs).count() == 6
