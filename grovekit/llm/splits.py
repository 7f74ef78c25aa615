"""Splits that keep related records together (problem 4).

Records that share a key are related, and relations are closed: the groups are the connected components of records and
keys.  Each task runs union-find over its links and passes on a forest, one link for each node that is no root; forests
are merged in ever fewer tasks while they fit, and by distributed star contraction where they do not.  Groups are dealt
to the splits largest first, each to the split furthest below its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, materialise

#: Most links that a merging task may be given (about 150 bytes each).
TASK_LINKS = 2_000_000
FAN_IN = 8


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links ``(a, b)`` of one task; gives ``(a, b)`` with a a node and b the smallest node joined to it."""
    up: dict = {}

    def find(x):
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            ra, rb = find(a), find(b)
            if ra < rb:
                up[rb] = ra
            elif rb < ra:
                up[ra] = rb
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"a": part, "b": [find(x) for x in part]}, dtype=object)


def _contract(links: DataFrame) -> DataFrame:
    """Large and small stars in turn until every node hangs on the smallest of its component."""
    e = links
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialise(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = materialise(small, "small")
        changed = small.join(small.select(F.col("a").alias("b"), F.lit(1).alias("x")), "b", "left_semi").limit(1).count() or small.groupBy("a").count().where("count > 1").limit(1).count()
        forget(large)
        e = small
        if not changed:
            return e


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, component)`` for each node of the string links ``(a, b)``; a component is named by its smallest node.

    Null ends are no links.  Nodes that only link to themselves may be missing: they are their own component.
    """
    links = links.where("a is not null and b is not null and a <> b")
    forest = materialise(links.mapInPandas(local_forest, "a string, b string"), "forest")
    parts, n = max(1, forest.rdd.getNumPartitions()), forest.count()
    while n:
        parts = -(-parts // FAN_IN)
        if n > task_links * parts:
            forest = _contract(forest)
            break
        merged = materialise((forest.repartition(parts, "b") if parts > 1 else forest.coalesce(1)).mapInPandas(local_forest, "a string, b string"), "forest")
        forget(forest)
        forest = merged
        if parts == 1:
            break
        n = forest.count()
    return forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(forest.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def groups(records: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``(kind, id, group_key, group_size)`` of records ``(kind, id, keys)`` with at least one key; keys is an array of strings.

    Kinds are kept apart.  group_key is the smallest key, in code point order, of any record of the group.  Null elements
    and records without keys are left out; (kind, id) must be unique.  A record only offers links from its smallest key to
    its others, so a key that a third of all records hold makes one link where they hold nothing else.
    """
    rec = records.withColumn("keys", F.array_sort(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))).where("size(keys) > 0")
    name = lambda k: F.concat("kind", F.lit("\u0001"), k)
    links = rec.where("size(keys) > 1").select(name(F.col("keys")[0]).alias("a"), F.explode(F.slice("keys", 2, F.size("keys"))).alias("k"), "kind").select("a", name(F.col("k")).alias("b")).distinct()
    comp = components(links, task_links)
    own = rec.select("kind", "id", name(F.col("keys")[0]).alias("node"))
    of_record = materialise(own.join(comp, "node", "left").select("kind", "id", F.coalesce("component", "node").alias("g")), "grouped")
    sizes = of_record.groupBy("g").agg(F.count(F.lit(1)).alias("group_size"))
    return of_record.join(sizes, "g").select("kind", "id", F.expr("substring(g, length(kind) + 2)").alias("group_key"), "group_size")


def quotas(sizes: list[tuple[int, int]], shares: Sequence[float]) -> list[tuple[int, list[int]]]:
    """How many of the groups of each size each split gets, for ``(size, number of groups)``.

    Largest first, each to the split furthest below its target, ties to the first split; groups of equal size are dealt
    in bulk once the splits take turns, which gives the same numbers up to the order within the turn.
    """
    total = sum(s * n for s, n in sizes)
    lack = [total * x / sum(shares) for x in shares]
    out = []
    for size, n in sorted(sizes, reverse=True):
        got = [0] * len(lack)
        if n > 10_000:  # deal all but the last turns by level: every lack ends about the same height
            order = sorted(lack, reverse=True)
            left = n - 1_000 * len(lack)
            level, k = order[0], 1
            for k in range(1, len(order) + 1):
                level = (sum(order[:k]) - left * size) / k
                if k == len(order) or level >= order[k]:
                    break
            for i, x in enumerate(lack):
                if x > level:
                    take = min(int((x - level) / size), n)
                    got[i] += take
                    lack[i] -= take * size
            n -= sum(got)
        for _ in range(n):
            i = max(range(len(lack)), key=lambda j: (lack[j], -j))
            got[i] += 1
            lack[i] -= size
        out.append((size, got))
    return out


def assign(groups_: DataFrame, shares: Sequence[float], names: Sequence[str], spread: int = 64) -> DataFrame:
    """``(.., split)`` for ``(group, group_size)`` rows, one per group.

    The driver sees the histogram of sizes only: its length is at most the square root of twice the records.  Which groups
    of one size go where follows from their rank by hash, counted in ``spread`` parts, so that no size is one task.
    """
    g = groups_.withColumn("_s", F.pmod(F.xxhash64("group"), F.lit(spread)))
    g = materialise(g, "dealt")
    hist = [(r[0], r[1]) for r in g.groupBy("group_size").count().collect()]
    if not hist:
        return g.drop("_s").withColumn("split", F.lit(None).cast("string"))
    spark = g.sparkSession
    bounds = []
    for size, got in quotas(hist, shares):
        lo = 0
        for name, k in zip(names, got):
            if k:
                bounds.append((size, lo, lo + k, name))
            lo += k
    table = spark.createDataFrame(bounds, "group_size long, _lo long, _hi long, split string")
    ahead = Window.partitionBy("group_size").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offs = g.groupBy("group_size", "_s").count().withColumn("_off", F.coalesce(F.sum("count").over(ahead), F.lit(0))).select("group_size", "_s", "_off")
    w = Window.partitionBy("group_size", "_s").orderBy(F.xxhash64("group", F.lit(1)), "group")
    ranked = g.withColumn("_r", F.row_number().over(w) - 1).join(offs, ["group_size", "_s"]).withColumn("_r", F.col("_r") + F.col("_off"))
    return ranked.join(table, "group_size").where("_r >= _lo and _r < _hi").drop("_s", "_r", "_off", "_lo", "_hi")
