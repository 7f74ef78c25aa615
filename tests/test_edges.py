import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.operators import edges
from grovekit.plans import tune

E = "src string, dst string, weight double"


def df(spark, rows):
    return spark.createDataFrame(rows, E)


def pairs(d):
    return {(r.src, r.dst) for r in d.collect()}


def star(weights):
    return [("a", f"c{i}", float(w)) for i, w in enumerate(weights)]


@pytest.mark.parametrize("weights,p,gone", [([5], 0.9, [0]), ([3, 3, 3, 1], 0.5, [0, 1, 2, 3]), ([6, 3, 1], 0.9, [2]), ([6, 3, 1], 0.55, [0, 1, 2]), ([5, -1, -2], 0.9, [0, 1, 2]), ([1, 2], 1, [])])
def test_nucleus(spark, weights, p, gone):
    assert pairs(edges.outside_nucleus(df(spark, star(weights)), p)) == {("a", f"c{i}") for i in gone}


def test_inverse_and_loops(spark):
    e = df(spark, [("a", "b", 2.0), ("b", "a", 2.0), ("c", "d", 3.0), ("d", "c", 2.0), ("x", "x", None), ("p", "q", None), ("q", "p", 2.0)])
    assert pairs(edges.weaker_inverses(e)) == {("d", "c"), ("p", "q")}
    assert pairs(edges.self_loops(e)) == {("x", "x")}


def test_percentile_is_exact_and_ties_are_ordered(spark):
    rng = random.Random(1)
    rows = sorted({(f"s{rng.randrange(9)}", f"d{rng.randrange(9)}"): float(rng.randrange(4)) for _ in range(60)}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    for p in (0.0, 0.37, 0.99, 1):
        want = sorted(rows, key=lambda r: (r[2], r[0], r[1]))[: int(p * len(rows))]
        assert pairs(edges.below_percentile(df(spark, rows), p)) == {(a, b) for a, b, _ in want}
    assert pairs(edges.below_percentile(df(spark, []), 0.5)) == set()


def reference_prune(rows, absolute, relative):
    """All rules on the original edges, in NumPy."""
    gone = {(a, b) for a, b, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1]))[: int(absolute * len(rows))]}
    w = {(a, b): x for a, b, x in rows}
    out = defaultdict(list)
    for a, b, x in rows:
        out[a].append((x, b))
    if relative != 1:
        for a, kids in out.items():
            kids.sort(key=lambda k: (-k[0], k[1]))
            v = np.array([k[0] for k in kids])
            lim = v[np.argmax(np.cumsum(v / v.sum()) > relative)]
            gone |= {(a, b) for x, b in kids if x <= lim}
    gone |= {(a, b) for a, b in w if a == b or w.get((b, a), -1) > w[a, b]}
    kept = set(w) - gone
    tops = {a for a, _ in kept} - {b for _, b in kept}
    return kept | {(edges.ROOT, t) for t in tops}


def test_post_process_and_search_agree_with_numpy(spark):
    rng = random.Random(5)
    w = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}"): float(rng.randrange(1, 9)) for _ in range(70)}
    rows = [(a, b, x) for (a, b), x in w.items()]
    e = df(spark, rows).cache()
    truth = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", 1.0) for _ in range(30)] + [(edges.ROOT, "n1", 1.0)]
    for a, r in ((0.0, 1), (0.3, 0.7)):
        assert pairs(edges.post_process(e, a, r)) == reference_prune(rows, a, r)
    al, rl = tune.grid(len(rows), 4)
    got = {r.seq: r for r in tune.literal_search(e, df(spark, truth), al, rl).collect()}
    t = {(a, b) for a, b, _ in truth}
    for i, a in enumerate(al):
        for j, r in enumerate(rl):
            want = reference_prune(rows, a, r)
            row = got[i * len(rl) + j]
            assert row.edges == len(want)
            assert row.precision == pytest.approx(len(want & t) / len(want) if want else 0)
            assert row.recall == pytest.approx(len(want & t) / len(t))


def test_grid_ends():
    a, r = tune.grid(625)
    assert (len(a), len(r), a[0], r[0]) == (21, 21, 0.0, 1.0)
    assert a[-1] == pytest.approx(1 - 1 / 625) and r[-1] == pytest.approx(0.1) and a == sorted(a)


def test_root_of_a_cycle_and_of_nothing(spark):
    assert pairs(edges.post_process(df(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]))) == {("a", "b"), ("b", "c"), ("c", "a")}
    assert pairs(edges.post_process(df(spark, []))) == set()
    kept = edges.post_process(df(spark, [("r", "a", 1.0), ("x", "b", 1.0)]), root="r")
    assert pairs(kept) == {("r", "a"), ("x", "b")}


def test_support_and_inverse_frequency(spark):
    steps = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", "b"), (2, "b", "c")], "id int, src string, dst string")
    assert {(r.src, r.dst, r.weight) for r in edges.support(steps, "id").collect()} == {("a", "b", 2.0), ("b", "c", 1.0)}
    assert {(r.src, r["count"], r.weight) for r in edges.inverse_frequency(steps).collect()} == {("a", 3, 2 / 3), ("b", 1, 2.0)}


def test_non_edges(spark):
    titles = spark.createDataFrame([(f"t{i}",) for i in range(12)], "title string")
    e = df(spark, [("t1", "t2", 1.0), ("t2", "t3", 1.0)])
    got = [tuple(r) for r in edges.non_edges(titles, e, 10).collect()]
    assert len(got) == len(set(got)) == 20 and not set(got) & {("t1", "t2"), ("t2", "t3")}
    assert edges.non_edges(titles, e, 1000).count() == 142  # all pairs that are no edges
    assert edges.non_edges(titles, df(spark, [])).count() == 0


def test_best(spark):
    rows = spark.createDataFrame([(0, 0.5, 3), (1, 0.7, 4), (2, 0.7, 9), (3, None, 1)], "seq int, f1 double, k int")
    assert tune.best(rows, "f1").first().seq == 1
    assert tuple(tune.best_rank(rows).first()) == (0.7, 9)
    assert tuple(tune.best_rank(rows.limit(0)).first()) == (0.0, 0)


def test_search_scores_titles_that_are_alike(spark):
    from grovekit.operators import metrics

    e = df(spark, [("a", "b", 5.0), ("a", "c", 1.0), ("b", "d", 3.0), ("d", "q", 2.0)]).cache()
    truth = df(spark, [("a2", "b2", 1.0), ("b2", "d2", 1.0)])
    v = spark.createDataFrame([(t, x) for t, x in {"a": [1.0, 0.0, 0.1], "a2": [1.0, 0.1, 0.0], "b": [0.0, 1.0, 0.0], "b2": [0.2, 1.0, 0.0], "c": [-1.0, 0.1, 0.3], "d": [0.5, 0.0, 1.0], "d2": [0.4, 0.1, 1.0], "q": [0.1, -1.0, 0.2], edges.ROOT: [0.3, 0.3, 0.3]}.items()], "title string, embed array<double>")
    al, rl = [0.0, 0.5], [1.0, 0.6]
    got = tune.search(e, truth, v, al, rl).orderBy("seq").collect()
    assert len(got) == 4 and max(r.continuous_f1 for r in got) > 0.5
    for r in got:
        p = edges.post_process(e, r.absolute_percentile, r.relative_percentile).select("src", "dst")
        for kind, want in (("continuous", metrics.continuous_prf(p, truth, v).first()), ("fuzzy", metrics.fuzzy_prf(p, truth, v).first())):
            assert [r[f"{kind}_{x}"] for x in ("precision", "recall", "f1")] == pytest.approx(list(want))
