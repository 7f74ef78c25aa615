import random
from collections import defaultdict

import pytest

from grovekit.operators import hierarchy


def links_of(spark, pairs):
    return hierarchy.clean_links(spark.createDataFrame(pairs or [], "p string, c string"), "p", "c")


def brute_cycles(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            out[a].add(b)

    def reach(a):
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    return {a for a in list(out) if a in reach(a)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_cycles_against_reachability(spark, limit):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)] + [("s", "s"), (None, "x"), ("x", None)]
    got = hierarchy.cyclic_nodes(links_of(spark, pairs), limit).collect()
    assert {r.node for r in got} == brute_cycles(pairs)
    assert all(r.scc <= r.node for r in got)


def test_no_links(spark):
    assert hierarchy.cyclic_nodes(links_of(spark, [])).count() == 0
    labels, grafts, cyclic = hierarchy.label(links_of(spark, []))
    assert labels.count() == grafts.count() == cyclic.count() == 0
    assert hierarchy.full_paths(labels, grafts).count() == 0


@pytest.mark.parametrize("limit", [1000, 0])
def test_paths_depths_and_intervals(spark, limit):
    rng = random.Random(7)
    pairs = [(f"{rng.randrange(i):02d}", f"{i:02d}") for i in range(1, 40)] + [("05", "30"), ("07", "30"), ("09", "98"), ("98", "99"), ("99", "98"), ("99", "97"), ("96", "96")]
    links = links_of(spark, pairs)
    labels, grafts, cyclic = hierarchy.label(links, spark.createDataFrame([("zz",), (None,)], "id string"), limit)
    lab = {r.node: r for r in labels.collect()}
    assert {(r.node, r.scc) for r in cyclic.collect()} == {("98", "98"), ("99", "98"), ("96", "96")}
    parent = {n: r.parent for n, r in lab.items()}
    assert parent["zz"] is None and lab["zz"].size == 1 and "99" not in lab

    def up(n):
        return [] if n is None else [*up(parent[n]), n]

    below = defaultdict(set)
    for n in lab:
        for a in up(n)[:-1]:
            below[a].add(n)
    for n, r in lab.items():
        assert (r.root, r.depth, r.size) == (up(n)[0], len(up(n)) - 1, len(below[n]) + 1)
        assert {m for m, x in lab.items() if x.root == r.root and r.pre < x.pre < r.pre + r.size} == below[n]
        assert up(n)[-1 - r.pos] == r.head
    kids = defaultdict(set)
    for a, b in pairs:
        a, b = ("98" if x == "99" else x for x in (a, b))
        if a != b:
            kids[a].add(b)
    want = set()

    def walk(path):
        want.add(path)
        for k in kids[path[-1]]:
            walk((*path, k))

    for n in lab:
        if parent[n] is None:
            walk((n,))
    got = [tuple(r.path) for r in hierarchy.full_paths(labels, grafts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert up("97")[-2:] == ["98", "97"] and lab["97"].root == lab["09"].root


def reachable(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seen = {}
    for a in list(out):
        todo, got = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in got:
                got.add(x)
                todo += out[x] if x in out else ()
        seen[a] = got
    return seen


@pytest.mark.parametrize("limit", [1000, 0])
def test_long_chain(spark, limit):
    n = 200
    labels, grafts, _ = hierarchy.label(links_of(spark, [(f"{i:04d}", f"{i + 1:04d}") for i in range(n)]), None, limit)
    last = labels.where(f"node = '{n:04d}'").first()
    assert (last.depth, last.root, last.pos, last.pre) == (n, "0000", n, n)


def test_both_ways_of_labelling_agree(spark):
    rng = random.Random(12)
    links = links_of(spark, [(f"{rng.randrange(i)}", f"{i}") for i in range(1, 60)])
    a, b = ({tuple(r) for r in hierarchy.label(links, None, k)[0].collect()} for k in (1000, 0))
    assert a == b


@pytest.mark.parametrize("limit", [1000, 0])
def test_descendants_by_any_way(spark, limit):
    rng = random.Random(21)
    pairs = [(f"{rng.randrange(max(0, i - 9), i):02d}", f"{i:02d}") for i in range(1, 40) for _ in range(2)] + [("30", "25"), ("12", "11"), ("12", "12")]
    labels, grafts, cyclic = hierarchy.label(links_of(spark, pairs), spark.createDataFrame([("zz",)], "id string"), limit)
    reach = reachable(pairs)
    got = [tuple(r) for r in hierarchy.descendants(labels, grafts, cyclic).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in reach for b in reach[a] if a != b}
    assert {r.node: r.descendants for r in hierarchy.with_descendants(labels, grafts, cyclic).collect()} == {n: len(reach.get(n, set()) - {n}) for n in [*(f"{i:02d}" for i in range(40)), "zz"]}


def test_what_lies_behind_a_cycle(spark):
    labels, grafts, cyclic = hierarchy.label(links_of(spark, [("r", "x"), ("x", "y"), ("y", "x"), ("y", "z")]))
    assert {(r.node, r.root, r.depth) for r in hierarchy.each_member(labels, "node", cyclic).collect()} == {("r", "r", 0), ("x", "r", 1), ("y", "r", 1), ("z", "r", 2)}
    assert {tuple(r.path) for r in hierarchy.full_paths(labels, grafts).collect()} == {("r",), ("r", "x"), ("r", "x", "z")}


def test_shared_children_count_for_each_parent(spark, tmp_path):
    from grovekit.plans import core_queries

    rows = [(1, [(3,)]), (2, [(3,)]), (3, [(4,)]), (4, None)]
    spark.createDataFrame(rows, "id long, sub_categories array<struct<id:long>>").selectExpr("*", "timestamp'2024-01-01' as fetched_at").write.parquet(f"{tmp_path}/raw_categories.parquet")
    tree = core_queries.p3_tree(spark, str(tmp_path))
    assert {r.node: r.descendants for r in tree.collect()} == {"1": 2, "2": 2, "3": 1, "4": 0}
    assert {tuple(r) for r in core_queries.queries()["p3_descendants"](spark, str(tmp_path)).collect()} == {("1", "3"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")}
    spark.createDataFrame([("s", [["a", "c", "d"], ["b", "c"]])], "id string, paths array<array<string>>").selectExpr("*", "timestamp'2024-01-01' as ingested_at").write.parquet(f"{tmp_path}/linearised_samples.parquet")
    assert {r.node: r.descendants for r in core_queries.p3_steps(spark, str(tmp_path)).collect()} == {"a": 2, "b": 2, "c": 1, "d": 0}
