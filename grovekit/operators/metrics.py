"""Graph comparison: literal, fuzzy, continuous and graph-convolution precision, recall and F1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assign import best_sum

#: Matrices with more than this many steps of the assignment (n * n * m) are not solved: the metric is null.
MOST_STEPS = 20_000**3
#: Rows of the smaller side that are sent to all tasks at once (two vectors each).
BLOCK_ROWS = 20_000


def f1(p: Column, r: Column) -> Column:
    """0 where both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros or null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scaled_cosine(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the vectors of an array whose mask is set; the count is at least 1e-9."""
    dims = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    kept = F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.cast("double").alias("m")))
    return F.transform(dims, lambda d: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["t"], d) * x["m"]) / n)


def literal_prf(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``(precision, recall, f1)`` of distinct (src, dst) pairs of titles; 0 where a side has none."""
    p = predicted.select("src", "dst").distinct().withColumn("p", F.lit(1))
    t = truth.select("src", "dst").distinct().withColumn("t", F.lit(1))
    c = p.join(t, ["src", "dst"], "full_outer").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.col("p") + F.col("t")).alias("hit"))
    c = c.select(F.coalesce(F.try_divide("hit", "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hit", "nt"), F.lit(0.0)).alias("recall"))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def edge_vectors(edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(src, dst, u, v)``: edges with the unit vectors of their ends from ``embeddings(title, embed)``; edges without both are left out."""
    norm = F.sqrt(F.aggregate("embed", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = embeddings.withColumn("_n", norm).where("_n > 0").select("title", F.transform("embed", lambda x: x.cast("double") / F.col("_n")).alias("e"))
    return edges.select("src", "dst").join(unit.select(F.col("title").alias("src"), F.col("e").alias("u")), "src").join(unit.select(F.col("title").alias("dst"), F.col("e").alias("v")), "dst").select("src", "dst", "u", "v")


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in col]) if len(col) else np.zeros((0, 1))


def fuzzy_matches(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """``(src, dst)`` of the edges of a (with vectors) that some edge of b is like: both ends' cosines reach the threshold.

    b goes to the tasks in blocks of ``BLOCK_ROWS``, and each task multiplies matrices; no pairs are built.
    """
    spark = a.sparkSession
    n = b.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    out = None
    for k in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("src", "dst"), F.lit(blocks)) == k).select("u", "v").collect()
        shared = spark.sparkContext.broadcast((_matrix([r.u for r in rows]), _matrix([r.v for r in rows])))

        def run(batches, shared=shared):
            u, v = shared.value
            for x in batches:
                if len(x) and len(u):
                    hit = np.zeros(len(x), bool)
                    xu, xv = _matrix(x["u"]), _matrix(x["v"])
                    for i in range(0, len(u), 512):
                        hit |= np.minimum(xu @ u[i : i + 512].T, xv @ v[i : i + 512].T).max(1) >= threshold
                    yield x.loc[hit, ["src", "dst"]]

        got = a.mapInPandas(run, "src string, dst string")
        out = got if out is None else out.unionByName(got)
    return out.distinct() if blocks > 1 else out


def fuzzy_prf(predicted: DataFrame, truth: DataFrame, embeddings: DataFrame, threshold: float = 0.436) -> DataFrame:
    """Shares of edges with a like edge on the other side, relative to all edges of their own side."""
    a, b = edge_vectors(predicted, embeddings), edge_vectors(truth, embeddings)
    np_, nt = predicted.agg(F.count(F.lit(1)).alias("np")), truth.agg(F.count(F.lit(1)).alias("nt"))
    hp = fuzzy_matches(a, b, threshold).agg(F.count(F.lit(1)).alias("hp"))
    ht = fuzzy_matches(b, a, threshold).agg(F.count(F.lit(1)).alias("ht"))
    one = [d.withColumn("_one", F.lit(1)) for d in (np_, nt, hp, ht)]
    c = one[0]
    for d in one[1:]:
        c = c.join(d, "_one")
    c = c.select(F.coalesce(F.try_divide("hp", "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("ht", "nt"), F.lit(0.0)).alias("recall"))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def affordable(n: int, m: int, most: int = MOST_STEPS) -> bool:
    n, m = sorted((n, m))
    return n * n * m <= most


def _one_task_sum(a: DataFrame, b: DataFrame, pairwise: str) -> float:
    """The best assignment's sum between two guarded sets of rows, solved in one task."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).withColumn("g", F.lit(0))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        s = _matrix(x["u"]) @ _matrix(y["u"]).T if len(x) and len(y) else np.zeros((0, 0))
        if pairwise == "edges" and s.size:
            s = np.minimum(s, _matrix(x["v"]) @ _matrix(y["v"]).T)
        return pd.DataFrame({"s": [best_sum(s)]})

    got = both.groupBy("g").applyInPandas(solve, "s double").collect()
    return got[0][0] if got else 0.0


def _prf_of_sum(spark, total: float | None, n: int, m: int) -> DataFrame:
    schema = "precision double, recall double, f1 double"
    if total is None:
        return spark.createDataFrame([(None, None, None)], schema)
    p, r = (total / n if n else 0.0), (total / m if m else 0.0)
    return spark.createDataFrame([(p, r, 2 * p * r / (p + r) if p + r else 0.0)], schema)


def continuous_prf(predicted: DataFrame, truth: DataFrame, embeddings: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """The best one-to-one matching of edges by the smaller of their ends' cosines, relative to each side's edges.

    Null where n * n * m exceeds ``most`` (the matching is solved in one task); 0 where a side is empty.
    """
    n, m = predicted.count(), truth.count()
    if not affordable(n, m, most):
        return _prf_of_sum(predicted.sparkSession, None, n, m)
    if not n or not m:
        return _prf_of_sum(predicted.sparkSession, 0.0, n, m)
    return _prf_of_sum(predicted.sparkSession, _one_task_sum(edge_vectors(predicted, embeddings), edge_vectors(truth, embeddings), "edges"), n, m)


def convolved(nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``(id, dim, x)``: node vectors after ``hops`` rounds of normalised sums over incoming edges and the node itself.

    ``nodes(id, embed)``; weights are ignored, parallel edges and self-loops don't add up; a node's degree is that of its
    incoming edges, itself included.
    """
    ids = nodes.select("id")
    e = edges.where("src <> dst").select("src", "dst").distinct().unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    deg = e.groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
    w = e.join(deg, "dst").join(deg.select(F.col("dst").alias("src"), F.col("d").alias("ds")), "src").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("ds").cast("double"))).alias("w"))
    x = nodes.select("id", F.posexplode("embed").alias("dim", "x")).select("id", "dim", F.col("x").cast("double").alias("x"))
    for _ in range(hops):
        x = w.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return x


def graph_prf(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame, hops: int = 2, most: int = MOST_STEPS) -> DataFrame:
    """The best one-to-one matching of nodes by cosine of their convolved vectors, relative to each side's nodes."""
    n, m = nodes_a.count(), nodes_b.count()
    spark = nodes_a.sparkSession
    if not affordable(n, m, most):
        return _prf_of_sum(spark, None, n, m)
    if not n or not m:
        return _prf_of_sum(spark, 0.0, n, m)

    def unit(nodes, edges):
        v = convolved(nodes, edges, hops).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("e"))
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
        return v.withColumn("_n", norm).where("_n > 0").select(F.transform("e", lambda x: x / F.col("_n")).alias("u"))

    return _prf_of_sum(spark, _one_task_sum(unit(nodes_a, edges_a), unit(nodes_b, edges_b), "nodes"), n, m)


def pair_classifier_scores(logits: DataFrame) -> DataFrame:
    """``(accuracy, precision, recall, f1)`` of ``(l0, l1, label)``: the larger logit wins, the first on ties."""
    hit = F.when(F.col("l1") > F.col("l0"), 1).otherwise(0)
    c = logits.select(hit.alias("p"), "label").agg(F.avg(F.when(F.col("p") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"), F.sum(F.col("p") * F.col("label")).alias("tp"), F.sum("p").alias("np"), F.sum("label").alias("nt"))
    c = c.select("accuracy", F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "nt"), F.lit(0.0)).alias("recall"))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def link_probability(l0: Column, l1: Column) -> Column:
    """The second of two logits as a probability."""
    return 1 / (1 + F.exp(l0 - l1))


def top_similar(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``(query, id, cosine)``: the k rows most like each query; both sides are ``(id, embed)``.

    Queries go to the tasks in blocks of ``BLOCK_ROWS``, each task keeps the best k of its rows, and those are merged.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    kind = rows.select("id").schema[0].dataType.simpleString()
    out = None
    for part in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).collect()
        shared = spark.sparkContext.broadcast(([r.id for r in q], _matrix([r.embed for r in q])))

        def run(batches, shared=shared):
            ids, m = shared.value
            if not ids:
                return
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            best_s, best_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), object)
            for x in batches:
                if not len(x):
                    continue
                v = _matrix(x["embed"])
                n = np.linalg.norm(v, axis=1)
                s = m @ (v / np.maximum(n, 1e-300)[:, None]).T
                s[:, n == 0] = -np.inf
                best_s = np.hstack([best_s, s])
                best_i = np.hstack([best_i, np.broadcast_to(x["id"].to_numpy(object), s.shape)])
                if best_s.shape[1] > k:
                    at = np.lexsort((best_i, -np.round(best_s, 12)), axis=1)[:, :k] if best_i.size else None
                    best_s, best_i = np.take_along_axis(best_s, at, 1), np.take_along_axis(best_i, at, 1)
            yield pd.DataFrame([(a, i, float(s)) for a, ss, ii in zip(ids, best_s, best_i) for s, i in zip(ss, ii) if s > -np.inf], columns=["query", "id", "cosine"])

        got = rows.select("id", "embed").mapInPandas(run, f"query {kind}, id {kind}, cosine double")
        out = got if out is None else out.unionByName(got)
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "id")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
