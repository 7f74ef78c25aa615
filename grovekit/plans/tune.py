"""The search over prunings: the grid, literal, fuzzy and continuous scores of all its points, and the best point."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROOT
from ..operators.assign import best_sum
from ..operators import metrics, motif
from ..operators.metrics import MOST_STEPS, affordable, edge_vectors
from ..session import materialise
from ..operators.edges import nucleus_limits, ranked, running_shares, weight


def geomspace(lo: float, hi: float, n: int) -> list[float]:
    if n == 1:
        return [lo]
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n - 1)] + [hi]


def grid(n_edges: int, n: int = 21) -> tuple[list[float], list[float]]:
    """``(absolute, relative)`` percentiles: from 0 to 1 - 1/E rising, and from 1 to 0.1 falling, closer at their first ends' far sides."""
    if n_edges < 1:
        return [0.0], [1.0]
    a = [1 - x for x in reversed(geomspace(1 / n_edges, 1, n))]
    return [0.0 if x == 0 else x for x in a], [1 - x + 0.1 for x in geomspace(0.1, 1, n)]


def grid_table(spark, n_edges: int, n: int = 21) -> DataFrame:
    """``(seq, absolute_percentile, relative_percentile)`` of all points."""
    a, r = grid(n_edges, n)
    return spark.createDataFrame([(i * len(r) + j, x, y) for i, x in enumerate(a) for j, y in enumerate(r)], "seq int, absolute_percentile double, relative_percentile double")


def pruned_edges(e: DataFrame, absolute: list[float], relative: list[float], root: str = ROOT) -> DataFrame:
    """``(seq, src, dst)``: the edges that each point's pruning leaves, the root's new ones included.

    Ranks, shares and inverse edges are computed once; a kept edge is then told for which points it stays, and the root's
    new edges follow from the nodes that a point leaves without a parent.  Equal to pruning at every point.
    """
    e = materialise(e.select("src", "dst", weight().alias("weight")), "edges")
    total = e.count()
    r = ranked(e)
    r = r.join(nucleus_limits(running_shares(e), relative), "src")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    r = r.where("src <> dst").join(back, ["src", "dst"], "left").where("back is null or back <= weight")
    cut = [total if p == 1 else math.floor(p * total) for p in absolute]
    points = [(i * len(relative) + j, k, j) for i, k in enumerate(cut) for j in range(len(relative))]
    stays = F.array_compact(F.array(*[F.when((F.col("rank") > k) & (F.col("weight") > F.col("limits")[j]), F.lit(s)) for s, k, j in points]))
    kept = r.select("src", "dst", F.explode(stays).alias("seq"))
    ends = kept.select("seq", F.col("src").alias("id"), F.lit(0).alias("below")).unionByName(kept.select("seq", F.col("dst").alias("id"), F.lit(1).alias("below")))
    tops = ends.groupBy("seq", "id").agg(F.max("below").alias("below")).where("below = 0").where(F.col("id") != root).select("seq", F.lit(root).alias("src"), F.col("id").alias("dst"))
    return kept.select("seq", "src", "dst").unionByName(tops).distinct()


def literal_search(e: DataFrame, truth: DataFrame, absolute: list[float], relative: list[float], root: str = ROOT) -> DataFrame:
    """``(seq, absolute_percentile, relative_percentile, edges, precision, recall, f1)`` of every pruning of titled edges."""
    every = pruned_edges(e, absolute, relative, root)
    t = truth.select("src", "dst").distinct()
    nt = t.count()
    s = every.join(t.withColumn("hit", F.lit(1)), ["src", "dst"], "left").groupBy("seq").agg(F.count(F.lit(1)).alias("edges"), F.count("hit").alias("hit"))
    spark = e.sparkSession
    pts = spark.createDataFrame([(i * len(relative) + j, x, y) for i, x in enumerate(absolute) for j, y in enumerate(relative)], "seq int, absolute_percentile double, relative_percentile double")
    s = pts.join(s, "seq", "left").withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("precision", F.coalesce(F.try_divide("hit", "edges"), F.lit(0.0))).withColumn("recall", F.coalesce(F.col("hit") / F.lit(nt or None).cast("double"), F.lit(0.0)))
    f = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return s.withColumn("f1", f).drop("hit")


def _safe_f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


SCORES = [f"{kind}_{x}" for kind in ("continuous", "fuzzy") for x in ("precision", "recall", "f1")]


def search(e: DataFrame, truth: DataFrame, embeddings: DataFrame, absolute: list[float], relative: list[float], root: str = ROOT, threshold: float = 0.436, most: int = MOST_STEPS) -> DataFrame:
    """``(seq, absolute_percentile, relative_percentile, edges, continuous_..., fuzzy_...)`` of every pruning: precision, recall, f1.

    As the reference scores them: both kinds from the smaller cosine of two edges' ends by ``embeddings(title, embed)``, shares
    relative to all edges of a side, 0 where a side is empty, null where the assignment would cost more than ``most``.  A
    point is one task's group; the truth goes to all tasks, as many edges as the guard on the assignment allows.
    """
    spark = e.sparkSession
    every = materialise(pruned_edges(e, absolute, relative, root), "pruned")
    t = materialise(truth.select("src", "dst").distinct(), "truth")
    nt = t.count()
    sizes = every.groupBy("seq").agg(F.count(F.lit(1)).alias("edges"))
    ok = materialise(sizes, "sizes")
    fit = [r.seq for r in ok.collect() if nt and affordable(r.edges, nt, most)]
    rows = edge_vectors(t, embeddings).select("u", "v").collect() if fit else []
    both = (np.array([r.u for r in rows], float), np.array([r.v for r in rows], float))
    told = spark.sparkContext.broadcast(both)
    pairs = every.join(ok, "seq").where(F.col("seq").isin(fit))
    distinct = pairs.select("src", "dst").distinct()
    vec = edge_vectors(distinct, embeddings)
    scored = pairs.join(vec, ["src", "dst"], "left").select("seq", "edges", "u", "v")

    def score(x: pd.DataFrame) -> pd.DataFrame:
        n = int(x["edges"].iloc[0])
        has = x[x["u"].notna()]
        tu, tv = told.value
        p = r = fp = fr = 0.0
        if len(has) and len(tu):
            sims = np.minimum(np.stack([np.asarray(a, float) for a in has["u"]]) @ tu.T, np.stack([np.asarray(a, float) for a in has["v"]]) @ tv.T)
            total = best_sum(sims)
            p, r = total / n, total / nt
            hard = sims >= threshold
            fp, fr = hard.any(1).sum() / n, hard.any(0).sum() / nt
        return pd.DataFrame([(x["seq"].iloc[0], p, r, _safe_f1(p, r), fp, fr, _safe_f1(fp, fr))], columns=["seq", *SCORES])

    got = scored.groupBy("seq").applyInPandas(score, "seq int, " + ", ".join(f"{c} double" for c in SCORES))
    pts = spark.createDataFrame([(i * len(relative) + j, x, y) for i, x in enumerate(absolute) for j, y in enumerate(relative)], "seq int, absolute_percentile double, relative_percentile double")
    out = pts.join(ok, "seq", "left").withColumn("edges", F.coalesce("edges", F.lit(0))).join(got, "seq", "left")
    empty = (F.col("edges") == 0) | F.lit(nt == 0)
    return out.select("seq", "absolute_percentile", "relative_percentile", "edges", *[F.when(empty, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in SCORES])


def evaluate(predicted: DataFrame, truth: DataFrame, embeddings: DataFrame, threshold: float = 0.436, hops: int = 2, most: int = MOST_STEPS) -> DataFrame:
    """One row of 15 figures of titled edges against true ones: numbers of nodes and edges, precision, recall and F1 each by literal,
    continuous, fuzzy and graph matching, and the distance of motifs.  Figures of assignments beyond ``most`` are null."""
    e, t = materialise(predicted.select("src", "dst").distinct(), "edges"), materialise(truth.select("src", "dst").distinct(), "truth")

    def nodes(x: DataFrame) -> DataFrame:
        ids = x.select(F.col("src").alias("id")).union(x.select("dst")).distinct()
        return ids.join(embeddings.select(F.col("title").alias("id"), "embed"), "id")

    beside = lambda a, b: a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")  # noqa: E731  # one row each
    row = beside(e.agg(F.count(F.lit(1)).alias("num_edges")), e.select("src").union(e.select("dst")).distinct().agg(F.count(F.lit(1)).alias("num_nodes")))
    kinds = {
        "literal": metrics.literal_prf(e, t), "continuous": metrics.continuous_prf(e, t, embeddings, most), "fuzzy": metrics.fuzzy_prf(e, t, embeddings, threshold),
        "graph": metrics.graph_prf(nodes(e), e, nodes(t), t, hops, most),
    }
    for name, got in kinds.items():
        row = beside(row, got.select(*[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")]))
    row = beside(row, motif.distance(motif.census(e), motif.census(t)).select("motif_dist"))
    return row.select("num_nodes", "num_edges", *[f"{k}_{c}" for k in kinds for c in ("precision", "recall", "f1")], "motif_dist")


def best(results: DataFrame, metric: str) -> DataFrame:
    """The point of the highest metric, the first on ties."""
    return results.orderBy(F.desc_nulls_last(metric), "seq").limit(1)


def best_rank(results: DataFrame) -> DataFrame:
    """``(f1, k)``: the highest f1, the larger k on ties, (0, 0) where none is above."""
    m = F.max(F.struct(F.col("f1").cast("double").alias("f1"), F.col("k").cast("long").alias("k")))
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0).cast("long").alias("k"))
    return results.agg(F.greatest(F.coalesce(m, zero), zero).alias("b")).select("b.*")
