import random

from pyspark.sql import functions as F

from grovekit.operators import ranks


def test_numbered_and_running_sums_with_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, float(rng.randrange(1, 9))) for i in range(300)] + [("none", 1000, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = sorted((r.n, r.i) for r in ranks.numbered(df, "n", "i", parts=7).collect())
    assert [n for n, _ in got] == list(range(301)) and [i for _, i in got] == sorted(r[1] for r in rows)
    want, run = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        run[k] = run.get(k, 0.0) + (v or 0.0)
        want[i] = run[k] if v is not None else None
    assert {r.i: r.s for r in ranks.running_sum(df, "s", "k", "v", F.desc("i"), parts=7).collect()} == want
    assert ranks.numbered(df.limit(0), "n", "i").count() == 0
