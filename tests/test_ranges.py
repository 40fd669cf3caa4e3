import random

from hypomill.operators.ranges import row_numbers


def test_numbers_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 10**9), k) for k in range(3000)]
    got = row_numbers(spark.createDataFrame(rows, "k string, v long, id long"), ["k"], ["v", "id"], "n").collect()
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r[1:] for r in rows if r[0] == key)), 1):
            want[r[1]] = n
    assert {r.id: r.n for r in got} == want
    assert row_numbers(spark.createDataFrame([], "k string, v long"), ["k"], ["v"], "n").count() == 0
