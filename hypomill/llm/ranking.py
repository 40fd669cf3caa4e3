"""Problem 1: one ranking from several scores on different scales.

Outranking net flow. Every score becomes its percentile among the valid scores of its own
group (the system that made it), so scale, unit and shape no longer matter. On percentiles,
item a is preferred to b by min(1, (a - b) / 0.2); an item's flow for a score is its mean
preference over all others minus theirs over it, and its net flow is the equally weighted mean
over the scores it has.

Flows come from sorted prefix sums, not from pairs. With C(y) and S(y) the number and the sum
of all percentiles up to y, the preferences of x add up to
``f * (C(x - f) + C(x + f) - n) + x * (C(x + f) - C(x - f)) - (S(x + f) - S(x - f))``, divided by
f. The two shifted prefix sums meet x where copies of all points, moved by +f and -f, are
sorted together with the points themselves. All sums are of integers, so they are exact, and
no order of summation changes a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypomill.runtime import bounded_broadcast, materialize

SCORES = ("ec_sequence_score", "asr_sequence_score", "combined_score")
#: A percentile is the mid-rank's integer part in units of 10^-15: values of one group stay
#: apart, whatever their number (mid-ranks differ by one in 10^15 items at least).
UNIT = 1_000_000_000_000_000
#: Difference of percentiles from which one item is wholly preferred.
FULL = UNIT // 5
#: Pieces of the percentile scale whose points one window sorts; UNIT and FULL are multiples of a piece.
PIECES = 5_000
#: Fixed values that stand for a missing score.
SENTINELS = (-9999.0, 9999.0, -99999.0, 99999.0)
#: A score more than this many times the 10-90 % range away from its group's median is no score.
ABSURD = 200.0
#: Net flows are compared at this resolution; RANK_RANGES ranges of them are ranked apart.
FLOW_STEPS, RANK_RANGES = 1_000_000_000, 1024


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~v.isin(*SENTINELS)


def long_scores(items: DataFrame, id_col: str, group_col: str, scores: tuple[str, ...]) -> DataFrame:
    """(id, group, score, v): one row per item and score; v is null where the score is missing,
    NaN, infinite or a sentinel."""
    each = [F.struct(F.lit(k).alias("score"), F.when(_finite(F.col(s).cast("double")), F.col(s).cast("double")).alias("v")) for k, s in enumerate(scores)]
    return items.select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("group"), F.explode(F.array(*each)).alias("e")).select("id", "group", "e.score", "e.v")


def prefixes(values: DataFrame) -> DataFrame:
    """(group, score, v, n, upto, size): each distinct value, its items, the items of its group up to it and in all; written.

    Equal values are counted together before any shuffle. The distinct values are then range
    partitioned, into as many ranges as the session has shuffle partitions; a rank is the
    prefix sum within a range plus the items of the group's lower ranges. However large a
    group, no task holds more than a range of it.
    """
    counted = values.groupBy("group", "score", "v").agg(F.count(F.lit(1)).alias("n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, because the ranges must not change between the two reads below
    ranged = materialize(counted.repartitionByRange(parts, "group", "score", "v").withColumn("r", F.spark_partition_id()), "p1-ranges")
    inside = ranged.withColumn("within", F.sum("n").over(Window.partitionBy("group", "score", "r").orderBy("v")))
    whole = Window.partitionBy("group", "score")
    ranges = ranged.groupBy("group", "score", "r").agg(F.sum("n").alias("m")).select(
        "group", "score", "r", (F.sum("m").over(whole.orderBy("r")) - F.col("m")).alias("below"), F.sum("m").over(whole).alias("size"))
    joined = inside.join(ranges, ["group", "score", "r"])
    return materialize(joined.select("group", "score", "v", "n", (F.col("below") + F.col("within")).alias("upto"), "size"), "p1-prefixes")


def credible(prefix: DataFrame) -> DataFrame:
    """(group, score, low, high, cut, all): the exact span of credible values, the items below it and in it."""

    def quantile(tenths: int) -> Column:
        return F.min(F.when(F.col("upto") * 10 >= F.col("size") * tenths, F.col("v")))

    q = prefix.groupBy("group", "score").agg(quantile(1).alias("q1"), quantile(5).alias("q5"), quantile(9).alias("q9"))
    reach = F.lit(ABSURD) * F.greatest(F.col("q9") - F.col("q1"), F.lit(1e-9))
    spans = bounded_broadcast(q.select("group", "score", (F.col("q5") - reach).alias("low"), (F.col("q5") + reach).alias("high")), "p1-spans")
    counts = prefix.join(spans, ["group", "score"]).groupBy("group", "score", "low", "high").agg(
        F.coalesce(F.max(F.when(F.col("v") < F.col("low"), F.col("upto"))), F.lit(0)).alias("cut"), F.max(F.when(F.col("v") <= F.col("high"), F.col("upto"))).alias("last"))
    return bounded_broadcast(counts.select("group", "score", "low", "high", "cut", (F.col("last") - F.col("cut")).alias("all")), "p1-credible")


def percentiles(values: DataFrame) -> DataFrame:
    """(group, score, v, n, x): each distinct credible value, its items and its mid-rank percentile in UNITs."""
    prefix = prefixes(values)
    kept = prefix.join(credible(prefix), ["group", "score"]).where("v between low and high")
    # twice the mid-rank is an integer
    twice = "cast(2 * (upto - cut) - n as decimal(20, 0))"
    return kept.select("group", "score", "v", "n", F.expr(f"cast({twice} * {UNIT} div cast(2 * all as decimal(20, 0)) as bigint)").alias("x"))


def flows(points: DataFrame) -> DataFrame:
    """(group, score, v, flow) of every point, over all items. ``points`` is read twice and should be written.

    Points and moved points are sorted within PIECES pieces of the percentile scale, over
    which mid-ranks lie evenly; the sums of lower pieces come from a table of at most PIECES
    rows a score.
    """
    piece = F.expr(f"cast(x div {UNIT // PIECES} as int)").alias("piece")
    asked = points.select("score", "x", piece, "group", "v", F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("decimal(38,0)").alias("s"))
    n, sum_x = F.col("n"), F.expr("cast(cast(n as decimal(19, 0)) * cast(x as decimal(18, 0)) as decimal(38, 0))")
    none, zero = F.lit(None), F.lit(0).cast("long")

    def moved(by: int, near: Column, far: Column, s: Column) -> DataFrame:
        there = F.greatest(F.col("x") + by, F.lit(0))
        rows = points.where(there <= UNIT).select("score", there.alias("x"), near.alias("near"), far.alias("far"), s.alias("s"))
        return rows.select("score", "x", piece, none.cast("string").alias("group"), none.cast("double").alias("v"), "near", "far", "s")

    shifted = moved(FULL, zero, n, -sum_x).unionByName(moved(-FULL, n, zero, sum_x))
    upto = Window.partitionBy("score", "piece").orderBy("x")
    sums = asked.unionByName(shifted).withColumns({f"c_{k}": F.sum(k).over(upto) for k in ("near", "far", "s")}).where("v is not null")
    lower = Window.partitionBy("score").orderBy("piece")
    totals = shifted.groupBy("score", "piece").agg(*(F.sum(k).alias(k) for k in ("near", "far", "s")))
    # pieces without moved points have their own points too
    every = points.select("score", piece).distinct().join(totals, ["score", "piece"], "full_outer")
    before = every.select("score", "piece", *((F.sum(F.coalesce(F.col(k).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))).over(lower) - F.coalesce(F.col(k), F.lit(0))).cast("decimal(38,0)").alias(f"b_{k}") for k in ("near", "far", "s")))
    size = points.groupBy("score").agg(F.sum("n").alias("all"))  # a row a score
    full = sums.join(F.broadcast(before), ["score", "piece"]).join(F.broadcast(size), "score")
    near, far, s = (f"(cast(c_{k} as decimal(38, 0)) + b_{k})" for k in ("near", "far", "s"))
    x, f = "cast(x as decimal(18, 0))", f"cast({FULL} as decimal(18, 0))"
    preferred = f"{f} * cast({near} + {far} - all as decimal(20, 0)) + {x} * cast({near} - {far} as decimal(20, 0)) - {s}"
    return full.select("group", "score", "v", F.expr(f"case when all > 1 then cast({preferred} as double) / (cast({FULL} as double) * (all - 1)) else 0.0d end").alias("flow"))


def net_flows(items: DataFrame, id_col: str, group_col: str, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(id, n_scores, net_flow) of every item; net_flow is null for an item without a valid score."""
    long = long_scores(items, id_col, group_col, scores)
    points = materialize(percentiles(long.where("v is not null")), "p1-points")
    return (
        long.join(flows(points), ["group", "score", "v"], "left").groupBy("id")
        .agg(F.count("flow").alias("n_scores"), F.round(F.sum("flow") / F.count("flow"), 9).alias("net_flow"))
    )


def ranked(net: DataFrame) -> DataFrame:
    """Adds ``rank``: 1 plus the number of items with a greater net flow; equal flows share it.

    Items without a net flow come after all others, together. Distinct flows are counted
    first and ranked within ranges of the flow scale, so no task sorts all items.
    """
    step = F.round(F.col("net_flow") * FLOW_STEPS).cast("long")
    stepped = net.withColumn("f", F.coalesce(step, F.lit(-2 * FLOW_STEPS)))
    distinct = stepped.groupBy("f").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.expr(f"greatest(-1, (f + {FLOW_STEPS}) div {2 * FLOW_STEPS // RANK_RANGES})"))
    inside = distinct.withColumn("above", F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = distinct.groupBy("r").agg(F.sum("n").alias("m"))
    # at most RANK_RANGES + 2 rows
    ranges = ranges.select("r", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("over"))
    places = inside.join(ranges, "r").select("f", (F.col("over") + F.col("above") + 1).alias("rank"))
    return stepped.join(places, "f").drop("f")


def rank_outputs(outputs: DataFrame) -> DataFrame:
    """(output_id, n_scores, net_flow, rank) of every output.

    Missing, NaN, infinite, sentinel and absurd scores count as not available; a null system
    is a group of its own. Repeated rows count singly, ties share a rank.
    """
    return ranked(net_flows(outputs, "output_id", "ec_system_id")).withColumnRenamed("id", "output_id")
