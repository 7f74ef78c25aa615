"""Weighted edge tables ``(src, dst, weight)``: building, counting and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROOT
from ..session import materialise
from .ranks import first, numbered, running_sum


def weight() -> Column:
    """A missing weight reads as one."""
    return F.coalesce(F.col("weight").cast("double"), F.lit(1.0))


def support(steps: DataFrame, key: str) -> DataFrame:
    """Edges weighted by the number of records ``key`` that hold them; a record counts once."""
    return steps.select(key, "src", "dst").distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def inverse_frequency(steps: DataFrame) -> DataFrame:
    """``(src, dst, count, weight)``: occurrences, and their mean over all edges divided by them."""
    c = steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"))
    mean = c.agg(F.avg("count").alias("mean"))  # one row
    return c.withColumn("_one", F.lit(1)).join(F.broadcast(mean.withColumn("_one", F.lit(1))), "_one").select("src", "dst", "count", (F.col("mean") / F.col("count")).alias("weight"))


def self_loops(e: DataFrame) -> DataFrame:
    return e.where("src = dst").select("src", "dst")


def weaker_inverses(e: DataFrame) -> DataFrame:
    """Edges whose opposite weighs strictly more."""
    e = e.select("src", "dst", weight().alias("weight"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("back"))
    return e.join(back, ["src", "dst"]).where("back > weight").select("src", "dst")


def ranked(e: DataFrame) -> DataFrame:
    """With ``rank``: place by (weight, src, dst) among all edges, from 1."""
    return numbered(e, "rank", "weight", "src", "dst").withColumn("rank", F.col("rank") + 1)


def below_percentile(e: DataFrame, p: float) -> DataFrame:
    """The ``int(p * E)`` lightest of E edges; ties by source and target, all for p = 1."""
    e = e.select("src", "dst", weight().alias("weight"))
    if p == 1:
        return e.select("src", "dst")
    total = e.agg(F.floor(F.count(F.lit(1)) * F.lit(float(p))).alias("k")).withColumn("_one", F.lit(1))  # one row
    return ranked(e).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").where("rank <= k").select("src", "dst")


def outside_nucleus(e: DataFrame, p: float) -> DataFrame:
    """By source, the edges that are not heavier than the one with which the running share first exceeds p; none for p = 1.

    Shares are summed heaviest first.  A source whose sum never exceeds p (as with weights below zero) loses all edges.
    """
    e = e.select("src", "dst", weight().alias("weight"))
    if p == 1:
        return e.select("src", "dst").limit(0)
    lim = nucleus_limits(running_shares(e), [p]).select("src", F.col("limits")[0].alias("limit"))
    return e.join(lim, "src").where("weight <= limit").select("src", "dst")


def running_shares(e: DataFrame) -> DataFrame:
    """With ``run``: the running share of its source's total weight, heaviest first; null where the total is zero."""
    total = e.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = e.join(total, "src").withColumn("share", F.try_divide("weight", "total")).drop("total")
    return running_sum(shares, "run", "src", "share", F.desc("weight"), F.asc("dst"))


def nucleus_limits(r: DataFrame, ps: list[float]) -> DataFrame:
    """``(src, limits)``: for each p the weight at which the running share first exceeds it (the heaviest, where none does)."""
    def limit(p: float) -> Column:
        if p == 1:
            return F.lit(float("-inf"))
        return F.coalesce(F.max(F.when((F.col("run") > p) & ~F.isnan("run"), F.col("weight"))), F.max("weight"))

    return r.groupBy("src").agg(F.array(*[limit(p) for p in ps]).alias("limits"))


def attach_root(e: DataFrame, nodes: DataFrame, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """Edges of weight one from the root to each node that no edge leads to, and the nodes with the root."""
    tops = nodes.select("id").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").where(F.col("id") != root)
    new = tops.select(F.lit(root).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return e.select("src", "dst", weight().alias("weight")).unionByName(new), nodes.select("id").unionByName(nodes.sparkSession.createDataFrame([(root,)], "id string")).distinct()


def removed(e: DataFrame, absolute: float = 0.0, relative: float = 1.0, loops: bool = True, inverses: bool = True) -> DataFrame:
    """The union of what each rule removes; every rule looks at the original edges."""
    gone = below_percentile(e, absolute).unionByName(outside_nucleus(e, relative))
    if inverses:
        gone = gone.unionByName(weaker_inverses(e))
    if loops:
        gone = gone.unionByName(self_loops(e))
    return gone.distinct()


def post_process(e: DataFrame, absolute: float = 0.0, relative: float = 1.0, loops: bool = True, inverses: bool = True, root: str | None = None) -> DataFrame:
    """Pruned edges; without a root, or where pruning drops it, one is attached to all nodes that nothing leads to."""
    e = materialise(e.select("src", "dst", weight().alias("weight")), "edges")  # every rule and the result read it
    kept = e.join(removed(e, absolute, relative, loops, inverses), ["src", "dst"], "left_anti")
    kept = materialise(kept, "kept")
    nodes = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    if root is not None and nodes.where(F.col("id") == root).limit(1).count():
        return kept
    return attach_root(kept, nodes)[0]


def top_edges(e: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges; ties by source and target."""
    return first(e, k, F.desc("weight"), "src", "dst")


def top_pairs(titles: DataFrame, scores: DataFrame, factor: int = 10) -> DataFrame:
    """The ``min(factor * N, N * N)`` highest of all pairs of N titles; ties by source and target.

    Pairs without a score above 0 count as 0.  They are not all built: those that can be needed begin with the first sources, as
    many as fill the wanted number beside all pairs scored.  Scores are of distinct pairs of ``titles(title)``, none below 0.
    """
    t = materialise(titles.select("title").where("title is not null").distinct(), "titles")
    n = t.count()
    want = min(factor * n, n * n)
    s = materialise(scores.select("src", "dst", weight().alias("weight")).where("weight > 0"), "scores")
    high = first(s, want, F.desc("weight"), "src", "dst")
    missing = want - min(want, s.count())
    if not missing:
        return high
    sources = first(t, -(-(missing + s.count()) // n), "title").withColumnRenamed("title", "src")
    zero = sources.join(t.withColumnRenamed("title", "dst")).join(s.select("src", "dst"), ["src", "dst"], "left_anti")  # factor * N, the scored and N pairs at most
    return high.unionByName(first(zero, missing, "src", "dst").select("src", "dst", F.lit(0.0).alias("weight")))


def non_edges(titles: DataFrame, e: DataFrame, factor: int = 10, seed: int = 0) -> DataFrame:
    """``factor`` times as many pairs of titles that are no edges as there are edges, drawn by hash; self pairs may occur.

    The pairs to draw from are all pairs, so titles are given numbers and pairs are drawn as numbers: enough distinct draws
    to leave the wanted number after edges are taken out.  Nothing of all pairs is built.
    """
    t = titles.select("title").distinct()
    n = t.count()
    have = e.select("src", "dst").distinct()
    m = have.count()
    want = min(factor * m, max(n * n - m, 0))
    if not want:
        return have.limit(0)
    spark = t.sparkSession
    number = numbered(t, "n", "title")
    draws = spark.range(min(n * n, 3 * (want + m) + 1000)) if want + m < n * n // 2 else spark.range(n * n)
    slot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n * n)) if want + m < n * n // 2 else F.col("id")
    pairs = draws.select(slot.alias("slot")).distinct().select("slot", F.floor(F.col("slot") / n).cast("long").alias("i"), (F.col("slot") % n).alias("j"))
    a = number.select(F.col("n").alias("i"), F.col("title").alias("src"))
    b = number.select(F.col("n").alias("j"), F.col("title").alias("dst"))
    free = pairs.join(a, "i").join(b, "j").join(have, ["src", "dst"], "left_anti")
    return first(free, want, F.xxhash64("slot", F.lit(seed + 1)), "slot").select("src", "dst")
