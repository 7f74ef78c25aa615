"""Traversal: breadth-first distances, reachability, simple paths, linearisation and depth splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import TaxoGraph
from ..session import materialise
from .ranks import first


#: Graphs of up to this many links are walked in one task (about 150 bytes a link); larger ones level by level.
ONE_TASK_LINKS = 1_000_000


def _walk(cutoff: int | None):
    """Breadth-first search over one task's rows ``(src, dst)``; a row without a target is a seed."""
    def run(batches):
        out: dict[str, list[str]] = {}
        front: list[str] = []
        for b in batches:
            for s, t in zip(b["src"].tolist(), b["dst"].tolist()):
                if t is None:
                    front.append(s)
                else:
                    out.setdefault(s, []).append(t)
        seen = dict.fromkeys(front, 0)
        depth = 0
        while front and (cutoff is None or depth < cutoff):
            depth += 1
            new = dict.fromkeys(t for s in front for t in out.get(s, ()) if t not in seen)
            seen.update(dict.fromkeys(new, depth))
            front = list(new)
        yield pd.DataFrame({"id": list(seen), "depth": list(seen.values())}).astype({"id": object, "depth": "int32"})

    return run


def bfs(edges: DataFrame, seeds: DataFrame, cutoff: int | None = None, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """``(id, depth)``: steps from the nearest of ``seeds(id)``, up to ``cutoff``.

    A large graph is searched level by level, with the frontier alone joined to the links; a small one in one task.  Ids are
    strings; null ends are no links.
    """
    e = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    start = seeds.select("id").where("id is not null").distinct()
    if e.count() <= one_task_links and (first := materialise(start, "front")).count() <= one_task_links:
        rows = e.unionByName(first.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")))
        return rows.coalesce(1).mapInPandas(_walk(cutoff), "id string, depth int")
    seen = front = materialise(start.withColumn("depth", F.lit(0)), "front")
    depth = 0
    while cutoff is None or depth < cutoff:
        depth += 1
        new = front.join(e, front.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = materialise(new.withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def hash_order(c: Column, seed: int) -> Column:
    """A random order that any engine can repeat."""
    return F.md5(F.concat(c, F.lit(f"/{seed}")))


def depth_split(g: TaxoGraph, depth: int, share: float, seed: int = 0) -> tuple[TaxoGraph, TaxoGraph]:
    """``(test, train)``: nodes at ``depth`` are dealt out, ``int(share * n)`` of them to test; each side has them, all nodes above,
    and what they reach within the graph's longest distance.  What both reach is in both; without nodes there, both have only
    the nodes above."""
    dist = materialise(bfs(g.edges, g.nodes.where(F.col("id") == g.root).select("id")), "depths")
    longest = dist.agg(F.max("depth")).first()[0] or 0
    level = dist.where(F.col("depth") == depth).select("id")
    k = int(share * level.count())
    test = materialise(first(level, k, hash_order(F.col("id"), seed), "id"), "test")
    train = level.join(test, "id", "left_anti")
    above = dist.where(F.col("depth") < depth).select("id")
    return tuple(g.induced(bfs(g.edges, side, max(longest - depth, 0)).select("id").union(above).distinct()) for side in (test, train))


def split_coverage(dist: DataFrame, ids_a: DataFrame, ids_b: DataFrame) -> DataFrame:
    """By depth of ``dist(id, depth)``: nodes, and the shares of them in a, in b, in both and in either."""
    a, b = ids_a.select("id", F.lit(1).alias("a")), ids_b.select("id", F.lit(1).alias("b"))
    x = dist.join(a, "id", "left").join(b, "id", "left").withColumn("a", F.coalesce("a", F.lit(0))).withColumn("b", F.coalesce("b", F.lit(0)))
    return x.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.avg("a").alias("in_a"), F.avg("b").alias("in_b"), F.avg(F.col("a") * F.col("b")).alias("shared"), F.avg(F.greatest("a", "b")).alias("covered"))


def edge_depths(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """Edges with the smaller depth of their ends; edges with an end out of reach are left out."""
    return edges.join(dist.select(F.col("id").alias("src"), F.col("depth").alias("d1")), "src").join(dist.select(F.col("id").alias("dst"), F.col("depth").alias("d2")), "dst").select("src", "dst", F.least("d1", "d2").alias("depth"))


def simple_paths(edges: DataFrame, root: str, most_nodes: int) -> DataFrame:
    """``(node, path)``: every path without a repeated node from the root, of up to ``most_nodes`` nodes; the root's own included."""
    e = materialise(edges.select("src", "dst").distinct(), "edges")
    spark = e.sparkSession
    front = spark.createDataFrame([(root, [root])], "node string, path array<string>")
    out = front
    for _ in range(most_nodes - 1):
        longer = front.join(e, front.node == e.src).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = materialise(longer, "front")  # else each level would be planned and run again for all behind it
        out = out.unionByName(front)
    return out


def linearise(g: TaxoGraph, cutoff: int) -> DataFrame:
    """``(id, title, abstract, paths)`` of every page that a path of at most ``cutoff`` steps, the last to the page, leads to.

    Paths hold titles and come distinct and sorted; of a page listed by several nodes the first in (node, place) counts.
    """
    titles = g.nodes.select("id", "title")
    paths = simple_paths(g.edges, g.root, cutoff).withColumn("key", F.concat_ws("\u0001", "path"))
    named = paths.select("node", "key", F.posexplode("path").alias("i", "id")).join(titles, "id").groupBy("node", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"]).alias("path"))
    listed = g.node_pages.select(F.col("node_id").alias("node"), "page_id").distinct()
    per = listed.join(named, "node").groupBy("page_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return g.pages.join(per, g.pages.id == per.page_id).select("id", "title", "abstract", "paths")


def path_statistics(samples: DataFrame) -> DataFrame:
    """Mean and exact quantiles of paths per sample and of titles per path: ``(what, mean, p5, p25, p50, p75, p95)``."""
    n = samples.select(F.lit("paths").alias("what"), F.size("paths").alias("v"))
    m = samples.select(F.lit("titles").alias("what"), F.explode("paths").alias("p")).select("what", F.size("p").alias("v"))
    qs = (5, 25, 50, 75, 95)
    q = F.percentile("v", F.array(*[F.lit(x / 100) for x in qs]))
    return n.unionByName(m).groupBy("what").agg(F.avg("v").alias("mean"), q.alias("q")).select("what", "mean", *[F.col("q")[i].alias(f"p{x}") for i, x in enumerate(qs)])


def uncovered_edges(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges (by title) that are a step of no path."""
    return edges.select("src", "dst").distinct().join(steps.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def taxonomy(root: str, groups: DataFrame, archives: DataFrame, categories: DataFrame, aliases: DataFrame | None = None) -> TaxoGraph:
    """Root over groups over archives over categories from ``(id, title, parent, is_test)`` tables; test rows are left out.

    Ids go through the aliases; a category that becomes its own archive makes no edge.  A node's title is that of its own
    row; where several fall together, the largest.
    """
    live = lambda d: d.where(~F.coalesce("is_test", F.lit(False)))
    rows = live(groups).select("id", "title", F.lit(root).alias("parent")).unionByName(live(archives).select("id", "title", "parent")).unionByName(categories.select("id", "title", "parent"))
    if aliases is not None:
        for c in ("id", "parent"):
            a = aliases.select(F.col("alias").alias(c), F.col("canonical").alias("_to"))
            rows = rows.join(a, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    e = rows.where("id <> parent").select(F.col("parent").alias("src"), F.col("id").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    top = rows.sparkSession.createDataFrame([(root, root)], "id string, title string")
    return TaxoGraph(rows.groupBy("id").agg(F.max("title").alias("title")).unionByName(top), e, root)
