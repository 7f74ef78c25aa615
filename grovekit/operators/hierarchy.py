"""Parent-child links of unknown depth: cycles, heavy chains, full paths, depth, root and descendants (problem 3).

Nodes on cycles are separated first: those that reach each other become one node, named by the smallest of them, so what
lies ahead of a cycle leads through it to what lies behind.  What remains is acyclic; every node's smallest parent makes a
spanning forest, and each further parent is a *graft*.  Pointer doubling (a number of rounds logarithmic in the depth) gives roots,
depths and subtree sizes, the largest child continues its parent's chain, and a preorder that enters the heavy child
first makes each chain, and each subtree, one interval.  Paths are chain segments strung together, so their rounds are
bounded by the changes of chain on a path and not by its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, materialise

#: A cyclic core of up to this many links is solved in one task (about 100 bytes a link); a larger one by distributed colouring.
ONE_TASK_LINKS = 1_000_000
#: Siblings are numbered in this many groups, so that a parent of a third of all nodes is no single task.
SIBLING_GROUPS = 64


def clean_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    """``(src, dst)``, distinct and without nulls; links from a node to itself are kept."""
    return links.select(F.col(parent).cast("string").alias("src"), F.col(child).cast("string").alias("dst")).where("src is not null and dst is not null").distinct()


def _core(links: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Peels off links whose source nothing leads to or whose target leads nowhere, until all do or few enough are left."""
    e = materialise(links, "links")
    n = e.count()
    while n > limit:
        smaller = materialise(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "core"
        )
        m = smaller.count()
        forget(e)
        e = smaller
        if m == n:
            break
        n = m
    return e, n


def strong_components(src: list, dst: list) -> dict:
    """Component (its smallest node) of each node in a cycle of two or more; iterative, as paths may be long."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    comp: dict = {}
    for start in out:
        if start in order:
            continue
        work = [(start, iter(out[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1:
                        comp.update(dict.fromkeys(members, min(members)))
    return comp


def _solve_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    src: list = []
    dst: list = []
    for b in batches:
        src += b["src"].tolist()
        dst += b["dst"].tolist()
    comp = strong_components(src, dst)
    yield pd.DataFrame({"node": list(comp), "scc": list(comp.values())}, dtype=object)


def _solve_spread(e: DataFrame) -> DataFrame:
    """Forward-backward colouring: each node takes the smallest node that reaches it; what reaches that one back is its component."""
    spark = e.sparkSession
    found = spark.createDataFrame([], "node string, scc string")
    while True:
        e, n = _core(e, 0)
        if not n:
            return found
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colour = materialise(nodes.select("node", F.col("node").alias("c")), "colour")
        while True:
            pushed = e.join(colour, e.src == colour.node).select(F.col("dst").alias("node"), "c").unionByName(colour).groupBy("node").agg(F.min("c").alias("c"))
            new = materialise(pushed, "colour")
            moved = new.join(colour.withColumnRenamed("c", "was"), "node").where("c <> was").limit(1).count()
            colour = new
            if not moved:
                break
        inside = materialise(
            e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")), "inside"
        )
        back = materialise(colour.where("node = c"), "back")
        size = back.count()
        while True:
            grown = materialise(back.unionByName(inside.join(back.select(F.col("node").alias("dst"), F.lit(1).alias("hit")), "dst").select(F.col("src").alias("node"), "c")).distinct(), "back")
            m = grown.count()
            back = grown
            if m == size:
                break
            size = m
        two = back.groupBy("c").count().where("count > 1").select("c")
        found = materialise(found.unionByName(back.join(two, "c").select("node", F.col("c").alias("scc"))), "scc")
        done = back.select("node")
        e = e.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def cyclic_nodes(links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """``(node, scc)`` for each node on a cycle of ``links(src, dst)``; scc is the smallest node of its component.

    A node linked to itself is a cycle of one.  Empty links give no rows.  ``links`` must be distinct and without nulls
    (:func:`clean_links`).
    """
    own = links.where("src = dst").select(F.col("src").alias("node"))
    core, n = _core(links.where("src <> dst"), one_task_links)
    if n == 0:
        larger = links.sparkSession.createDataFrame([], "node string, scc string")
    elif n <= one_task_links:
        larger = core.coalesce(1).mapInPandas(_solve_here, "node string, scc string")
    else:
        larger = _solve_spread(core)
    return larger.unionByName(own.withColumn("scc", F.col("node"))).groupBy("node").agg(F.min("scc").alias("scc"))


def _double(parents: DataFrame, sizes: bool = False) -> DataFrame:
    """``(node, top, dist, total[, size])`` of a forest ``(node, parent, weight)``: root, steps to it, sum of the weights of the
    steps, and nodes below and including it.  Each round doubles the steps looked back on."""
    cur = materialise(
        parents.select("node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.when(F.col("parent").isNull(), 0).otherwise(F.col("weight")).cast("long").alias("total"), F.lit(1).cast("long").alias("size")), "jump"
    )
    step = 1
    while True:
        far = cur.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("dist").alias("d2"), F.col("total").alias("t2"))
        open_ = cur.where(F.col("dist") == step)  # what stopped short of it has met its root
        moved = open_.join(far, "top").select("node", F.col("top2").alias("top"), (F.col("dist") + F.col("d2")).alias("dist"), (F.col("total") + F.col("t2")).alias("total"), "size")
        nxt = moved.unionByName(cur.where(F.col("dist") != step))
        if sizes:
            below = open_.groupBy(F.col("top").alias("node")).agg(F.sum("size").alias("below"))
            nxt = nxt.join(below, "node", "left").withColumn("size", F.col("size") + F.coalesce("below", F.lit(0))).drop("below")
        nxt = materialise(nxt, "jump")
        forget(cur)
        cur, step = nxt, step * 2
        if not cur.where(F.col("dist") == step).limit(1).count():
            return cur


def _label_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All labels of one task's forest ``(node, parent, g)``, in the order that the distributed rounds give."""
    parts = list(batches)
    parent = {n: p for b in parts for n, p in zip(b["node"].tolist(), b["parent"].tolist())}
    group = {n: g for b in parts for n, g in zip(b["node"].tolist(), b["g"].tolist())}
    kids: dict = {}
    for n, p in parent.items():
        if p is not None:
            kids.setdefault(p, []).append(n)
    order = [n for n, p in parent.items() if p is None]
    for n in order:  # grows while it is read: parents before children
        order += kids.get(n, ())
    size = dict.fromkeys(order, 1)
    for n in reversed(order):
        if parent[n] is not None:
            size[parent[n]] += size[n]
    root, depth, head, pos, pre = {}, {}, {}, {}, {}
    for n in order:
        if parent[n] is None:
            root[n], depth[n], head[n], pos[n], pre[n] = n, 0, n, 0, 0
        below = kids.get(n)
        if below:
            heavy = min(below, key=lambda k: (-size[k], k))
            at = pre[n] + 1
            for k in sorted(below, key=lambda k: (k != heavy, group[k], k)):
                root[k], depth[k], pre[k] = root[n], depth[n] + 1, at
                head[k], pos[k] = (head[n], pos[n] + 1) if k == heavy else (k, 0)
                at += size[k]
    for i in range(0, len(order), 100_000):
        part = order[i : i + 100_000]
        cols = {c: [d[n] for n in part] for c, d in (("parent", parent), ("root", root), ("depth", depth), ("size", size), ("head", head), ("pos", pos), ("pre", pre))}
        yield pd.DataFrame({"node": part} | cols)


def _condensed(rows: DataFrame, column: str, cyclic: DataFrame) -> DataFrame:
    """``rows`` with each node on a cycle named by its component."""
    return rows.join(cyclic.select(F.col("node").alias(column), F.col("scc").alias("_scc")), column, "left").withColumn(column, F.coalesce("_scc", column)).select(*rows.columns)


def each_member(rows: DataFrame, column: str, cyclic: DataFrame) -> DataFrame:
    """``rows`` with one row for each node of the component that ``column`` names."""
    return rows.join(cyclic.select(F.col("scc").alias(column), F.col("node").alias("_node")), column, "left").withColumn(column, F.coalesce("_node", column)).select(*rows.columns)


def label(links: DataFrame, nodes: DataFrame | None = None, one_task_links: int = ONE_TASK_LINKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(labels, grafts, cyclic)`` of distinct links.

    labels: node, parent, root, depth (root 0), size (itself and what is below it in the forest), head and pos (its chain, and
    place in it), pre (the nodes below it in the forest are those of its root with pre in (pre, pre + size)).  grafts:
    (parent, node) links beside the spanning forest.  cyclic: (node, scc) of all nodes on cycles; labels and grafts have the
    sccs in their place (:func:`each_member` puts them back).  ``nodes`` adds nodes without links.  A forest of up to
    ``one_task_links`` nodes is labelled in one task, with the same result.
    """
    links = materialise(links, "links")
    cyclic = materialise(cyclic_nodes(links, one_task_links), "cyclic")
    every = links.select(F.col("src").alias("node")).union(links.select("dst"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0]).cast("string")).where(F.col(nodes.columns[0]).isNotNull()))
    acyclic = materialise(_condensed(_condensed(links, "src", cyclic), "dst", cyclic).where("src <> dst").distinct(), "acyclic")
    first = acyclic.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    forest = materialise(_condensed(every.distinct(), "node", cyclic).distinct().join(first, "node", "left").withColumn("weight", F.lit(1)), "forest")
    grafts = acyclic.select(F.col("src").alias("parent"), F.col("dst").alias("node")).join(forest.select("node", F.col("parent").alias("p")), "node").where("parent <> p").select("parent", "node")
    if forest.count() <= one_task_links:
        rows = forest.select("node", "parent", F.pmod(F.xxhash64("node"), F.lit(SIBLING_GROUPS)).cast("int").alias("g")).coalesce(1)
        here = rows.mapInPandas(_label_here, "node string, parent string, root string, depth long, size long, head string, pos long, pre long")
        return materialise(here, "labels"), grafts, cyclic
    base = _double(forest, sizes=True).select("node", F.col("top").alias("root"), F.col("dist").alias("depth"), "size")
    tree = materialise(forest.select("node", "parent").join(base, "node"), "tree")
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.min_by("node", F.struct(-F.col("size"), "node")).alias("heavy"))
    child = tree.where("parent is not null").join(heavy, "parent").withColumn("is_heavy", F.col("node") == F.col("heavy"))
    group = F.when(F.col("is_heavy"), -1).otherwise(F.pmod(F.xxhash64("node"), F.lit(SIBLING_GROUPS)).cast("int"))
    child = materialise(child.withColumn("g", group).select("node", "parent", "size", "is_heavy", "g"), "children")
    before = Window.partitionBy("parent").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = child.groupBy("parent", "g").agg(F.sum("size").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(before), F.lit(0))).select("parent", "g", "ahead")
    within = Window.partitionBy("parent", "g").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    offset = child.withColumn("in_group", F.coalesce(F.sum("size").over(within), F.lit(0))).join(groups, ["parent", "g"]).select("node", "parent", (1 + F.col("ahead") + F.col("in_group")).alias("weight"))
    pre = _double(tree.select("node", "parent").join(offset.select("node", "weight"), "node", "left")).select("node", F.col("total").alias("pre"))
    along = child.where("is_heavy").select("node", F.col("parent").alias("hp"))
    chain = _double(tree.select("node").join(along, "node", "left").select("node", F.col("hp").alias("parent"), F.lit(1).alias("weight"))).select("node", F.col("top").alias("head"), F.col("dist").alias("pos"))
    return tree.join(pre, "node").join(chain, "node").select("node", "parent", "root", "depth", "size", "head", "pos", "pre"), grafts, cyclic


def full_paths(labels: DataFrame, grafts: DataFrame) -> DataFrame:
    """``(node, path)``: every path from a root to every node, one row each, through grafts too.

    An entry is a way into a chain: (chain, place, path above).  Entries of roots' chains come first; each round takes the
    links that leave the chains entered last.  A cycle is one entry of a path, named by its smallest node.
    """
    lab = materialise(labels, "labels")
    chains = materialise(lab.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("chain")), "chains")
    at = lab.select("node", "head", "pos")
    light = lab.where("parent is not null and pos = 0").select("parent", "node")
    ways = light.unionByName(grafts)
    ways = materialise(ways.join(at.select(F.col("node").alias("parent"), F.col("head").alias("from_head"), F.col("pos").alias("from_pos")), "parent").join(at.withColumnRenamed("head", "to_head").withColumnRenamed("pos", "to_pos"), "node"), "ways")
    entries = materialise(lab.where("parent is null").select("head", "pos", F.array().cast("array<string>").alias("above")), "entries")
    out = None
    while entries.limit(1).count():
        strung = entries.join(chains, "head")
        rows = strung.select(F.posexplode(F.slice("chain", F.col("pos").cast("int") + 1, F.size("chain"))).alias("k", "node"), "above", "pos", "chain").select(
            "node", F.concat("above", F.slice("chain", F.col("pos").cast("int") + 1, F.col("k") + 1)).alias("path"))
        out = rows if out is None else out.unionByName(rows)
        entries = materialise(
            strung.join(ways, (F.col("head") == F.col("from_head")) & (F.col("pos") <= F.col("from_pos")))
            .select(F.col("to_head").alias("head"), F.col("to_pos").alias("pos"), F.concat("above", F.slice("chain", F.col("pos").cast("int") + 1, (F.col("from_pos") - F.col("pos") + 1).cast("int"))).alias("above")), "entries")
    return out if out is not None else lab.select("node", F.array().cast("array<string>").alias("path")).limit(0)


def ancestry(labels: DataFrame, grafts: DataFrame) -> DataFrame:
    """``(ancestor, node)``: every node below every other one, whatever way leads there, grafts included; one row each.

    A node's ancestors on one chain are all up to the deepest at which some way down to the node leaves it.  Each round takes
    the ways that enter the chains met last, so rounds are bounded by the changes of chain on a path.  A cycle is one node.
    """
    lab = materialise(labels.select("node", "parent", "head", "pos"), "labels")
    light = lab.where("parent is not null and pos = 0").select("parent", "node")
    at = lab.select("node", "head", "pos")
    ways = light.unionByName(grafts.select("parent", "node")).join(at.select(F.col("node").alias("parent"), F.col("head").alias("from_head"), F.col("pos").alias("from_pos")), "parent").join(at.withColumnRenamed("pos", "to_pos"), "node")
    ways = materialise(ways.select("head", "to_pos", "from_head", "from_pos").distinct(), "ways")
    best = new = at
    while new.limit(1).count():
        moved = new.join(ways, "head").where("to_pos <= pos").groupBy("node", F.col("from_head").alias("head")).agg(F.max("from_pos").alias("pos"))
        new = materialise(moved.join(best.select("node", "head", F.col("pos").alias("was")), ["node", "head"], "left").where("was is null or was < pos").select("node", "head", "pos"), "entered")
        best = materialise(best.unionByName(new).groupBy("node", "head").agg(F.max("pos").alias("pos")), "met")
    above = at.select(F.col("node").alias("ancestor"), "head", F.col("pos").alias("place"))
    return best.join(above, "head").where("place <= pos and ancestor <> node").select("ancestor", "node")


def with_descendants(labels: DataFrame, grafts: DataFrame, cyclic: DataFrame) -> DataFrame:
    """``labels``, one row for each node, with the number of nodes below each by any way, ``descendants``; nodes on a cycle are below each other."""
    weight = cyclic.groupBy(F.col("scc").alias("node")).agg(F.count(F.lit(1)).alias("w"))
    n = ancestry(labels, grafts).join(weight, "node", "left").groupBy(F.col("ancestor").alias("node")).agg(F.sum(F.coalesce("w", F.lit(1))).alias("n"))
    each = labels.join(n, "node", "left").join(weight, "node", "left").withColumn("descendants", F.coalesce("n", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).drop("n", "w")
    return each_member(each, "node", cyclic)


def descendants(labels: DataFrame, grafts: DataFrame, cyclic: DataFrame) -> DataFrame:
    """``(ancestor, node)``: every node below every other one, by any way, nodes on a cycle below each other; one row each."""
    inside = cyclic.select(F.col("scc").alias("ancestor"), F.col("scc").alias("node")).distinct()
    pairs = ancestry(labels, grafts).unionByName(inside)
    return each_member(each_member(pairs, "ancestor", cyclic), "node", cyclic).where("ancestor <> node")
