import itertools

import pytest

from grovekit import models
from grovekit.functions import tokens
from grovekit.operators import edges
from grovekit.plans import tune


def test_top_of_all_pairs_against_brute_force(spark):
    names = list("abcdefghijklmno")
    score = {("a", "b"): 3.0, ("c", "c"): 1.0, ("o", "a"): 2.0, ("b", "a"): 0.0}
    t = spark.createDataFrame([(x,) for x in [*names, "a", None]], "title string")
    s = spark.createDataFrame([(*k, v) for k, v in score.items()], "src string, dst string, weight double")
    for factor in (1, 10, 20):
        want = sorted(((score.get(p, 0.0), *p) for p in itertools.product(names, names)), key=lambda x: (-x[0], x[1], x[2]))[: min(factor * len(names), len(names) ** 2)]
        assert {(r.weight, r.src, r.dst) for r in edges.top_pairs(t, s, factor).collect()} == set(want)
    assert edges.top_pairs(t.limit(0), s.limit(0)).count() == 0


def test_rejects(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [1, 2, 3]), (4, [])], "id int, ids array<int>")
    assert {r.id: r.reject for r in tokens.with_reject(df, "ids", 2).collect()} == {1: None, 2: "no tokens", 3: "too long", 4: None}


@pytest.mark.parametrize("same", [True, False])
def test_evaluation_of_a_graph_against_itself_and_nothing(spark, same):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e")]
    e = spark.createDataFrame(rows, "src string, dst string")
    emb = models.embed_titles(spark.createDataFrame([(x,) for x in "abcde"], "title string"), None, models.HashEmbedder)
    r = tune.evaluate(e, e if same else e.limit(0), emb).first().asDict()
    assert (r["num_nodes"], r["num_edges"]) == (5, 5) and len(r) == 15
    for k in ("literal", "continuous", "fuzzy", "graph"):
        assert r[f"{k}_f1"] == pytest.approx(1.0 if same else 0.0)
    assert r["motif_dist"] == (pytest.approx(0.0) if same else None)
