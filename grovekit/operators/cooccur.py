"""Co-occurrence ``(l, r, cnt)``: counts, marginals, PPMI, truncated SVD and the four scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def counts(pairs: DataFrame, once_per: str | None = None) -> DataFrame:
    """Occurrences of each pair; with ``once_per`` a record counts a pair once."""
    rows = pairs.select(once_per, "l", "r").distinct() if once_per else pairs
    return rows.groupBy("l", "r").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def ppmi(c: DataFrame) -> DataFrame:
    """``(l, r, cnt, ppmi)``: max(0, ln(n * cnt / (row * column))) of each cell counted, by parts as logarithms."""
    c = c.where("cnt > 0")
    row = c.groupBy("l").agg(F.sum("cnt").alias("nl"))
    col = c.groupBy("r").agg(F.sum("cnt").alias("nr"))
    total = c.agg(F.sum("cnt").alias("n")).withColumn("_one", F.lit(1))  # one row
    x = c.join(row, "l").join(col, "r").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return x.select("l", "r", "cnt", F.greatest(F.lit(0.0), F.log("n") + F.log("cnt") - F.log("nl") - F.log("nr")).alias("ppmi"))


def scored(pairs: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """``pairs(l, r)`` with ``score``: the value of their cell, 0 without one."""
    return pairs.join(cells.select("l", "r", F.col(value).alias("score")), ["l", "r"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def concept_factors(cells: DataFrame, value: str, k: int, seed: int = 0, rounds: int = 2, extra: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(left, right)`` factors ``(name, vec)`` whose dot products are the rank-k approximation of the matrix of ``value``.

    A randomised range finder with power rounds.  The matrix stays in long form and is multiplied by joins and sums; only
    Gram matrices of (k + extra) squared numbers come to the driver.  k is cut to the smaller side.
    """
    m = materialise(cells.where(F.col(value) != 0).select("l", "r", F.col(value).cast("double").alias("v")), "cells")
    n = min(m.select("l").distinct().count(), m.select("r").distinct().count())
    if not n:
        none = m.select(F.col("l").alias("name"), F.array(F.col("v")).alias("vec")).limit(0)
        return none, none
    k = min(k, n)
    q = min(k + extra, n)

    def times(x: DataFrame, over: str, to: str) -> DataFrame:
        """The matrix times vectors held by ``over``, summed for each ``to``."""
        j = m.join(x.withColumnRenamed("name", over), over)
        sums = [F.sum(F.col("v") * F.col("vec")[i]).alias(f"s{i}") for i in range(q)]
        return materialise(j.groupBy(F.col(to).alias("name")).agg(*sums).select("name", F.array(*[f"s{i}" for i in range(q)]).alias("vec")), "factors")

    def gram(x: DataFrame) -> np.ndarray:
        def part(batches):
            import pandas as pd

            g = np.zeros((q, q))
            for b in batches:
                a = np.stack(b["vec"].to_numpy()) if len(b) else np.zeros((0, q))
                g += a.T @ a
            yield pd.DataFrame({"g": [g.ravel().tolist()]})

        return np.sum([np.array(r[0]) for r in x.select("vec").mapInPandas(part, "g array<double>").collect()], 0).reshape(q, q)

    def turned(x: DataFrame, by: np.ndarray) -> DataFrame:
        cols = [sum((F.col("vec")[i] * float(by[i, j]) for i in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])]
        return x.select("name", F.array(*cols).alias("vec"))

    def orthonormal(x: DataFrame) -> DataFrame:
        for _ in range(2):
            val, vec = np.linalg.eigh(gram(x))
            ok = val > max(val.max(), 1e-300) * 1e-12
            by = np.zeros((q, q))
            by[:, : ok.sum()] = vec[:, ok] / np.sqrt(val[ok])
            x = materialise(turned(x, by), "factors")
        return x

    noise = [F.pmod(F.xxhash64("name", F.lit(seed * 1009 + i)), F.lit(2**31)).cast("double") / 2**30 - 1 for i in range(q)]
    x = m.select(F.col("r").alias("name")).distinct().select("name", F.array(*noise).alias("vec"))
    y = orthonormal(times(x, "r", "l"))
    for _ in range(rounds):
        y = orthonormal(times(times(y, "l", "r"), "r", "l"))
    b = times(y, "l", "r")  # the transposed matrix in the range found
    val, vec = np.linalg.eigh(gram(b))
    top = vec[:, np.argsort(val)[::-1][:k]]
    return materialise(turned(y, top), "left"), materialise(turned(b, top), "right")


def factor_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs(l, r)`` with the dot product of their factors; 0 where one is unknown."""
    a = left.select(F.col("name").alias("l"), F.col("vec").alias("_a"))
    b = right.select(F.col("name").alias("r"), F.col("vec").alias("_b"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "l", "left").join(b, "r", "left").withColumn("score", F.coalesce(dot, F.lit(0.0))).drop("_a", "_b")


#: The four scorers by name; the last two take a rank.
def score(pairs: DataFrame, c: DataFrame, model: str, k: int = 50) -> DataFrame:
    """``raw``, ``ppmi``, ``svd_raw`` or ``svd_ppmi`` scores of ``pairs(l, r)`` from counts ``(l, r, cnt)``; unknown pairs score 0."""
    if model == "raw":
        return scored(pairs, c, "cnt")
    if model == "ppmi":
        return scored(pairs, ppmi(c), "ppmi")
    if model == "svd_raw":
        return factor_scores(pairs, *concept_factors(c, "cnt", k))
    if model == "svd_ppmi":
        return factor_scores(pairs, *concept_factors(ppmi(c), "ppmi", k))
    raise ValueError(model)
