import math
import random

from grovekit.operators import hotkeys


def test_exact_quantiles_match_sorting(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 2, 2, 3, rng.gauss(0, 1e6)]))) for _ in range(800)] + [(f"k{rng.randrange(9)}", rng.random()) for _ in range(200)]
    rows += [("hot", None), ("hot", float("nan")), (None, 1.0), ("none", None), ("one", -5.0), ("far", -1e308), ("far", 1e308), ("far", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("value", hotkeys.F.col("v"))
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {(r.k, r.q): r.value for r in hotkeys.exact_quantiles(df, "k", "v", qs).collect()}
    vals = {}
    for k, v in rows:
        if k is not None and v is not None and not math.isnan(v):
            vals.setdefault(k, []).append(v)
    assert got == {(k, q): sorted(v)[max(1, math.ceil(q * len(v))) - 1] for k, v in vals.items() for q in qs}


def test_totals_and_dominant(spark):
    df = spark.createDataFrame([("a", 1)] * 19 + [("b", 1), (None, 1)], "k string, v int")
    t = hotkeys.key_totals(df, "k", "v")
    assert {(r.k, r.n) for r in hotkeys.dominant(t, "k", 20).collect()} == {("a", 19)}  # b has exactly one in twenty
    empty = df.limit(0)
    assert hotkeys.dominant(hotkeys.key_totals(empty, "k", "v"), "k").count() == 0
    assert hotkeys.exact_quantiles(empty, "k", "v", (0.5,)).count() == 0


def test_distinct_by_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    assert {tuple(r) for r in hotkeys.distinct_by_key(df, "k", "v", "n").collect()} == {("a", 2)}
