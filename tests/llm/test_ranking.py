import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from hypomill.llm import ranking as R
from hypomill.runtime import materialize

SCHEMA = "output_id bigint, ec_system_id string, ec_sequence_score double, asr_sequence_score double, combined_score double, id string, v double, r int"


def outputs(spark, rows):
    return spark.createDataFrame([(k, *row, "clash", 0.0, 1) for k, row in enumerate(rows)], SCHEMA)


def brute(rows):
    """All pairs, score by score."""
    flows = [[] for _ in rows]
    for s in range(3):
        x = {}
        for g in {r[0] for r in rows}:
            own = [(k, r[1 + s]) for k, r in enumerate(rows) if r[0] == g and r[1 + s] is not None and math.isfinite(r[1 + s]) and r[1 + s] not in R.SENTINELS]
            for k, v in own:
                below, equal = sum(w < v for _, w in own), sum(w == v for _, w in own)
                x[k] = Fraction(2 * below + equal, 2 * len(own))
        for k, a in x.items():
            total = sum(max(-1, min(1, 5 * (a - b))) for b in x.values())
            flows[k].append(float(total / (len(x) - 1)) if len(x) > 1 else 0.0)
    return [sum(f) / len(f) if f else None for f in flows]


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        q = rng.gauss(0, 1)
        rows.append((rng.choice(["a", "b", None]), round(math.exp(q), 2), rng.choice([None, math.nan, math.inf, -9999.0, round(q * 1000.0, 0)]), rng.choice([0.5, 0.5, round(q, 1)])))
    want = brute([(r[0] or "", *r[1:]) for r in rows])
    got = {r.output_id: r for r in R.rank_outputs(outputs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, w in enumerate(want):
        assert (got[k].net_flow is None) == (w is None)
        assert w is None or abs(got[k].net_flow - w) < 1e-8
    for k in got:
        mine = -9 if got[k].net_flow is None else got[k].net_flow
        assert got[k].rank == 1 + sum((-9 if o.net_flow is None else o.net_flow) > mine for o in got.values())


def test_scale_and_shape_do_not_matter(spark):
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(80)]
    plain = R.rank_outputs(outputs(spark, [("a", x, x, x) for x in base])).collect()
    bent = R.rank_outputs(outputs(spark, [("a", math.exp(x), 1e6 * x - 7, x**3) for x in base])).collect()
    assert {r.output_id: r.rank for r in plain} == {r.output_id: r.rank for r in bent}


def test_absurd_scores_are_no_scores(spark):
    rows = [("a", float(k), None, None) for k in range(50)] + [("a", 1e9, None, None)]
    got = {r.output_id: r for r in R.rank_outputs(outputs(spark, rows)).collect()}
    assert got[50].n_scores == 0 and got[50].net_flow is None and got[50].rank == 51


def test_ties_single_and_empty(spark):
    got = R.rank_outputs(outputs(spark, [("a", 1.0, 1.0, 1.0)] * 4)).collect()
    assert {r.rank for r in got} == {1} and {r.net_flow for r in got} == {0.0}
    assert R.rank_outputs(outputs(spark, [("a", 1.0, None, None)])).first().net_flow == 0.0
    assert R.rank_outputs(outputs(spark, [("a", None, None, None)] * 2)).count() == 2
    assert R.rank_outputs(outputs(spark, [("a", 1.0, None, None)]).where("false")).count() == 0


def test_one_group_holds_most_rows(spark):
    rows = [("hot", float(k % 5), None, None) for k in range(2000)] + [("x", float(k), None, None) for k in range(50)]
    got = R.rank_outputs(outputs(spark, rows)).collect()
    assert len(got) == 2050 and all(r.net_flow is not None for r in got)


def test_two_million_values_of_one_group_stay_apart(spark):
    n, f = 2_000_000, 400_000
    rows = spark.range(n).select(
        F.col("id").alias("output_id"), F.lit("a").alias("ec_system_id"), F.pow(F.col("id").cast("double"), 1.5).alias("ec_sequence_score"),
        F.lit(None).cast("double").alias("asr_sequence_score"), F.lit(None).cast("double").alias("combined_score"))
    got = materialize(R.rank_outputs(rows))
    # with n different values the flow of the k-th is a sum over whole numbers
    k = np.arange(n, dtype=np.int64)
    below, above = np.minimum(k, f), np.minimum(n - 1 - k, f)
    want = (below * (below + 1) // 2 + (k - below) * f - above * (above + 1) // 2 - (n - 1 - k - above) * f) / (f * (n - 1))
    chosen = got.where("output_id % 99991 = 0 or output_id > 1999990").collect()
    assert len(chosen) > 20
    for r in chosen:
        assert abs(r.net_flow - want[r.output_id]) < 2e-9
    # far from the ends every step is a fifth of the scale wide on both sides, at the ends less
    assert got.where("net_flow is null").count() == 0 and got.agg(F.countDistinct("net_flow")).first()[0] > 1_900_000
