import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.operators import cooccur, metrics
from grovekit.operators.assign import best_assignment, best_sum


@pytest.mark.parametrize("n,m", [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6)])
def test_assignment_against_permutations(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for ties in (False, True):
        w = rng.integers(-3, 4, (n, m)).astype(float) if ties else rng.normal(size=(n, m))
        small, large = (w, m) if n <= m else (w.T, n)
        want = max(sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(large), min(n, m)))
        r, c = best_assignment(w)
        assert len(set(r)) == len(set(c)) == min(n, m)
        assert best_sum(w) == pytest.approx(want) == pytest.approx(w[r, c].sum())
    assert best_sum(np.zeros((0, 3))) == 0.0


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def prf(df):
    return tuple(round(x, 6) if x is not None else None for x in df.first())


def test_literal(spark):
    a, b = edges(spark, [("x", "y"), ("x", "y"), ("y", "z")]), edges(spark, [("x", "y"), ("q", "r"), ("s", "t")])
    assert prf(metrics.literal_prf(a, b)) == (0.5, 0.333333, 0.4)
    assert prf(metrics.literal_prf(a, a)) == (1.0, 1.0, 1.0)
    assert prf(metrics.literal_prf(a.limit(0), b)) == (0.0, 0.0, 0.0)


def test_fuzzy_and_continuous_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    emb = {f"t{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(9)} | {"zero": [0.0] * 4}
    pick = lambda: rng.choice(list(emb))
    ra, rb = list({(pick(), pick()) for _ in range(8)}), list({(pick(), pick()) for _ in range(10)})
    e = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in emb.items()], "title string, embed array<float>")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in emb.items() if any(v)}
    va, vb = [x for x in ra if "zero" not in x], [x for x in rb if "zero" not in x]
    s = np.array([[min(unit[a] @ unit[c], unit[b] @ unit[d]) for c, d in vb] for a, b in va])
    p, r = (s.max(1) >= 0.3).sum() / len(ra), (s.max(0) >= 0.3).sum() / len(rb)
    got = prf(metrics.fuzzy_prf(edges(spark, ra), edges(spark, rb), e, 0.3))
    assert got == pytest.approx((p, r, 2 * p * r / (p + r) if p + r else 0), abs=1e-5)
    total = best_sum(s)
    got = prf(metrics.continuous_prf(edges(spark, ra), edges(spark, rb), e))
    assert got[:2] == pytest.approx((total / len(ra), total / len(rb)), abs=1e-5)
    assert prf(metrics.continuous_prf(edges(spark, ra), edges(spark, rb), e, most=10)) == (None, None, None)
    assert prf(metrics.continuous_prf(edges(spark, ra).limit(0), edges(spark, rb), e)) == (0.0, 0.0, 0.0)


def test_convolution_and_graph_metric(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "id string, embed array<double>")
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")])
    adj = np.eye(3)
    adj[1, 0] = adj[2, 1] = 1
    deg = adj.sum(1)
    n = adj / np.sqrt(np.outer(deg, deg))
    x = n @ n @ np.array([[1, 0], [0, 1], [1, 1.0]])
    got = {(r.id, r.dim): r.x for r in metrics.convolved(nodes, e, 2).collect()}
    assert all(got.get(("abc"[i], j), 0.0) == pytest.approx(x[i, j]) for i in range(3) for j in range(2))
    assert prf(metrics.graph_prf(nodes, e, nodes, e)) == (1.0, 1.0, 1.0)
    assert prf(metrics.graph_prf(nodes.limit(0), e, nodes, e)) == (0.0, 0.0, 0.0)


def test_small_expressions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(metrics.cosine(F.col("a"), F.col("b")).alias("c"), metrics.cosine(F.col("a"), F.col("z")).alias("n"), metrics.scaled_cosine(F.col("a"), F.col("b")).alias("s"), metrics.link_probability(F.lit(0.0), F.lit(0.0)).alias("p")).first()
    assert r.c == pytest.approx(1 / math.sqrt(2)) and r.n is None and r.s == pytest.approx((1 / math.sqrt(2) + 1) / 2) and r.p == 0.5
    pool = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert pool.select(metrics.mean_pool(F.col("t"), F.col("m")).alias("x")).first().x == [2.0, 3.0]
    logits = spark.createDataFrame([(0.0, 1.0, 1), (0.0, 1.0, 0), (1.0, 1.0, 1), (2.0, 1.0, 0)], "l0 double, l1 double, label int")
    assert tuple(metrics.pair_classifier_scores(logits).first()) == (0.5, 0.5, 0.5, 0.5)


def test_top_similar(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=5) for i in range(40)} | {99: np.zeros(5)}
    rows = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in v.items()], "id long, embed array<double>")
    got = {(r.query, r.id) for r in metrics.top_similar(rows.where("id < 5"), rows, 3).collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == {(q, i) for q in range(5) for i in sorted((j for j in v if j != 99), key=lambda j: -cos(v[q], v[j]))[:3]}


def test_ppmi_and_factors(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 6, (8, 6)).astype(float)
    c = spark.createDataFrame([(f"l{i}", f"r{j}", float(a[i, j])) for i in range(8) for j in range(6) if a[i, j]], "l string, r string, cnt double")
    p = np.zeros_like(a)
    nz = a > 0
    p[nz] = np.maximum(0, np.log(a.sum() * a / np.outer(a.sum(1), a.sum(0)))[nz])
    got = {(r.l, r.r): r.ppmi for r in cooccur.ppmi(c).collect()}
    assert all(got[f"l{i}", f"r{j}"] == pytest.approx(p[i, j]) for i, j in zip(*np.nonzero(nz)))
    every = spark.createDataFrame([(f"l{i}", f"r{j}") for i in range(8) for j in range(6)] + [("l0", "unknown")], "l string, r string")
    for model, m in (("raw", a), ("ppmi", p)):
        s = {(r.l, r.r): r.score for r in cooccur.score(every, c, model).collect()}
        assert s["l0", "unknown"] == 0.0 and s["l1", "r1"] == pytest.approx(m[1, 1])
    for k in (2, 50):
        u, d, vt = np.linalg.svd(p)
        low = (u[:, : min(k, 6)] * d[: min(k, 6)]) @ vt[: min(k, 6)]
        s = {(r.l, r.r): r.score for r in cooccur.score(every, c, "svd_ppmi", k).collect()}
        assert all(s[f"l{i}", f"r{j}"] == pytest.approx(low[i, j], abs=1e-5) for i in range(8) for j in range(6)) and s["l0", "unknown"] == 0.0
    assert {r.cnt for r in cooccur.counts(spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", "b")], "d int, l string, r string"), "d").collect()} == {2.0}
