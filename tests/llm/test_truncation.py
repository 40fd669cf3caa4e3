import math
import random

from pyspark.sql import functions as F

from hypomill.llm import truncation as P


def test_censored_fit_recovers_the_distribution():
    rng = random.Random(5)
    lengths = {}
    for _ in range(20000):
        n = min(160, max(1, round(math.exp(rng.gauss(4.8, 0.35)))))
        lengths[n] = lengths.get(n, 0) + 1
    mu, sigma = P.censored_lognormal(lengths, 160)
    assert abs(mu - 4.8) < 0.02 and abs(sigma - 0.35) < 0.02
    (n, odds, last), = P.find_limits(lengths)
    assert (n, last) == (160, True) and odds > 2


def test_two_limits_of_a_source():
    """A field limit of 120 in older rows, and one of 160 in later ones."""
    rng = random.Random(8)
    lengths = {}
    for k in range(20000):
        n = min(120 if k % 3 == 0 else 160, max(1, round(math.exp(rng.gauss(4.8, 0.35)))))
        lengths[n] = lengths.get(n, 0) + 1
    found = P.find_limits(lengths)
    assert [(n, last) for n, _, last in found] == [(160, True), (120, False)]
    assert all(odds > 1 for _, odds, _ in found)
    # one text copied over and over is no limit
    lengths[90] += 3000
    assert [n for n, _, _ in P.find_limits(lengths, {n: 1.0 if n == 90 else float(c) for n, c in lengths.items()})] == [160, 120]


def test_no_limit_where_there_is_none():
    rng = random.Random(6)
    lengths = {}
    for _ in range(5000):
        n = max(1, round(math.exp(rng.gauss(4.8, 0.35))))
        lengths[n] = lengths.get(n, 0) + 1
    assert P.find_limits(lengths) == [] and P.find_limits({}) == [] and P.find_limits({50: 1}) == []


REF = "The miller counted forty sacks of flour near the old bridge before the lantern went out."


def odds(text, flag=None, limit=None, mark=0.95, refs=(REF,)):
    at_limit = limit is not None and len(text) >= limit
    return (3.5 if at_limit else P.TRANSFER_PRIOR) + sum(P.WEIGHTS[f] for f in P.output_findings(text, list(refs), flag, at_limit, mark))


def test_weights_are_fitted():
    """A flag that is right more often than it was thought to be gains weight, one that says nothing loses it."""
    rng = random.Random(9)

    def patterns(told):
        counts = {}
        for _ in range(20000):
            cut = rng.random() < 0.1
            flag = "flag=yes" if rng.random() < told[cut] else "flag=no"
            end = "end=unmarked 10" if cut or rng.random() < 0.05 else "end=marked"
            rest = rng.choice(["rest=4", "rest=6", "rest=2 cut"]) if cut else "rest=same"
            key = (flag, end, rest)
            counts[key] = counts.get(key, 0) + 1
        return [(k, None, n) for k, n in counts.items()]

    base, sure = P.fitted_weights(patterns({True: 0.9, False: 0.01}))
    _, vague = P.fitted_weights(patterns({True: 0.3, False: 0.3}))
    assert sure["flag=yes"] > 3.8 and abs(vague["flag=yes"]) < 0.2
    assert abs(base - math.log(0.1 / 0.9)) < 0.1
    assert P.fitted_weights([]) == (P.TRANSFER_PRIOR, P.WEIGHTS)


def test_style_is_that_of_the_whole_text(spark):
    rows = [("ALL CAPITALS HERE 12",), ("A HEADING IN CAPITALS THAT IS LONGER THAN FORTY LETTERS AND then the text goes on",), ("Title case",), ("lower",), ("12",), ("OK",)]
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(P.style(F.col("t")).alias("s")).collect()]
    assert got == ["upper", "title", "title", "lower", "lower", "title"]


def test_endings():
    assert odds("The miller counted forty sacks of flour ne") > 0
    assert odds("The miller counted forty sacks of ") > 0
    assert odds("the miller counted forty sacks of flour near the o", mark=0.0) > 0
    assert odds(REF) < 0
    assert odds(REF.rstrip(".").lower(), mark=0.0) < 0
    assert odds("The miller counted forty sacks of flour near the old bridge before the lantern went.") < 0
    assert odds("The miller counted forty sacks of flour near the old bridge...") < 0
    assert odds("the miller counted forty sacks of flour near the old bridge before the lantern", mark=0.0) < 0
    assert odds("The miller counted forty sacks of flour near the...", limit=51) > 0
    assert odds("anything at all", refs=(), mark=0.0) < 0


def tables(spark, outputs, exchanges=(), manifest=()):
    o = spark.createDataFrame(list(outputs), "output_id bigint, utt_id string, ec_system_id string, output_raw string, truncated boolean, source string, text string")
    e = spark.createDataFrame(list(exchanges), "exchange_id bigint, messages array<struct<role:string,content:string>>, raw_response string, output_tokens bigint, generation_parameters string, model_id string, odds double")
    m = spark.createDataFrame(list(manifest), "utt_id string, reference_raw string, reference_normalized string")
    return o, e, m


def test_tables(spark):
    outputs = [(1, "u", "s", REF, False, "c", "c"), (2, "u", "s", REF[:41], None, "c", "c"), (3, None, "s", None, True, "c", "c"), (4, "gone", None, "", None, "c", "c"), (5, None, None, "word", None, "c", "c"), (2, "u", "s", REF[:41], None, "c", "c"), (6, "u", "s", "word " * 20000, None, "c", "c")]
    exchanges = [(1, [("user", "Answer.\n\n" + REF)], '{"text": "The miller cou', 9, '{"max_tokens": 9}', "m", 0.0), (2, None, None, None, None, None, 0.0), (3, None, "All is well.", None, None, None, 0.0)]
    o, e, m = tables(spark, outputs, exchanges, [("u", REF, None), ("u", REF, REF), (None, "x", "x")])
    got = sorted((r.record_table, r.record_id) for r in P.found(o, e, m).collect())
    assert [g for g in got if g != ("ec_outputs", 6)] == [("ec_outputs", 2), ("ec_outputs", 2), ("llm_exchanges", 1)]
    rates = {(r.record_table, r.source): (r.texts, r.cut) for r in P.cut_rates(o, e, m).collect()}
    assert rates[("llm_exchanges", "m")] == (1, 1)
    empty = [t.where("false") for t in (o, e, m)]
    assert P.found(*empty).count() == 0


def test_limit_of_a_source(spark):
    rng = random.Random(7)
    words = "the miller counted forty sacks of flour near an old bridge before his lantern went out".split()
    rows, cut, refs = [], set(), []
    for k in range(600):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(8, 30))).capitalize() + "."
        refs.append((f"u{k}", text, None))
        if len(text) > 100:
            cut.add(k)
        rows.append((k, f"u{k}", "s", text[:100], None, "c", "c"))
    o, e, m = tables(spark, rows, manifest=refs)
    got = {r.record_id for r in P.found(o, e, m).collect()}
    assert len(got ^ cut) <= 0.02 * len(cut) and len(cut) > 50


def test_every_reference_of_an_id_counts(spark):
    middle = ["Many boats drifted past the quiet harbour on the", "Never did she ask him where the letters had gone to and", "Over the hill came a long row of carts with no"]
    refs = ["A short note about nothing at all was read to them by the old clerk this morning.", *[f"{m} evening of that day in May." for m in middle], "Zebras rarely cross the wide road at noon in summer when the heat is at its worst."]
    outputs = [(k, "u", "s", m + " evening of that day in Ma", None, "c", "c") for k, m in enumerate(middle)] + [(9, "u", "s", middle[1], True, "c", "c"), (9, "u", "s", middle[1], True, "c", "c")]
    whole = [(20 + k, "u", "s", refs[k + 1].rstrip("."), True, "c", "c") for k in range(3)]
    o, e, m = tables(spark, outputs + whole, manifest=[("u", r, None) for r in refs * 2])
    got = {(r.record_id, tuple(r.findings)) for r in P.output_rows(o, m).collect()}
    fit = {r.source: r for r in P.fit_sources(o.selectExpr("ec_system_id as source", "output_raw as text", "cast(null as long) as tokens")).collect()}["s"]
    assert fit.limits == []
    want = {(k, tuple(P.output_findings(t, refs, flag, False, fit.mark_title))) for k, _, _, t, flag, _, _ in outputs + whole}
    assert got == want
    assert P.outputs_judged(o, m).count() == len(outputs + whole)
    for _, _, _, t, f, _, _ in whole:
        outer, all_ = (P.output_findings(t, r, f, False, fit.mark_title)[2] for r in ([refs[0], refs[-1]], refs))
        assert P.WEIGHTS[outer] > P.WEIGHTS[all_]
