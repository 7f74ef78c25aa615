import random
from collections import Counter, defaultdict
import itertools

import pytest
from pyspark.sql import functions as F

from grovekit.graph import TaxoGraph
from grovekit.operators import motif, tables, traverse


def graph(spark, rows, root="r"):
    return TaxoGraph.of_edges(spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src string, dst string, weight double"), root)


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


@pytest.mark.parametrize("limit", [traverse.ONE_TASK_LINKS, 0])
def test_bfs(spark, limit):
    rng = random.Random(2)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)] + [(None, "n1"), ("n1", None)]
    e = spark.createDataFrame(rows, "src string, dst string")
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
    for cutoff in (None, 2):
        want, front, d = {"n0": 0, "n1": 0}, ["n0", "n1"], 0
        while front and (cutoff is None or d < cutoff):
            d += 1
            front = sorted({b for a in front for b in out[a] if b is not None and b not in want})
            want.update(dict.fromkeys(front, d))
        got = traverse.bfs(e, ids(spark, "n0", "n1", None), cutoff, limit)
        assert {r.id: r.depth for r in got.collect()} == want
    assert traverse.bfs(e.limit(0), ids(spark, "z"), None, limit).count() == 1
    assert traverse.bfs(e, ids(spark, "n0").limit(0), None, limit).count() == 0


def test_ego_keeps_edges_among_what_stays(spark):
    g = graph(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("b", "r"), ("c", "a")])
    assert {(r.src, r.dst) for r in g.ego(2).edges.collect()} == {("r", "a"), ("a", "b"), ("b", "r")}
    assert g.ego(0).edges.count() == 5 and g.ego(None).edges.count() == 5
    assert {(r.src, r.dst) for r in g.reversed().edges.collect()} == {(b, a) for a, b in [("r", "a"), ("a", "b"), ("b", "c"), ("b", "r"), ("c", "a")]}
    assert g.undirected().edges.count() == 10


def test_simple_paths_against_depth_first_search(spark):
    rng = random.Random(3)
    rows = list({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(18)}) + [("r", "n0"), ("r", "n1")]
    want = set()

    def walk(p):
        want.add(p)
        if len(p) < 4:
            for a, b in rows:
                if a == p[-1] and b not in p:
                    walk((*p, b))

    walk(("r",))
    got = [tuple(r.path) for r in traverse.simple_paths(graph(spark, rows).edges, "r", 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_linearise(spark):
    g = graph(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c")])
    pages = spark.createDataFrame([("p", "P", "x"), ("q", "Q", None), ("lost", "L", "")], "id string, title string, abstract string")
    listed = spark.createDataFrame([("c", "p"), ("c", "p"), ("r", "q"), ("zz", "lost")], "node_id string, page_id string")
    got = {r.id: r.paths for r in traverse.linearise(TaxoGraph(g.nodes, g.edges, "r", pages, listed), 4).collect()}
    assert got == {"p": [["r", "a", "c"], ["r", "b", "c"]], "q": [["r"]]}
    stats = {r.what: r for r in traverse.path_statistics(spark.createDataFrame(list(got.items()), "id string, paths array<array<string>>")).collect()}
    assert stats["paths"].mean == 1.5 and stats["titles"].p50 == 3.0
    steps = spark.createDataFrame([("r", "a")], "src string, dst string")
    assert traverse.uncovered_edges(g.edges, steps).count() == 3


def test_split_covers_its_level(spark):
    rows = [("r", f"a{i}") for i in range(5)] + [(f"a{i}", f"b{i % 3}") for i in range(5)] + [("b0", "c")]
    g = graph(spark, rows)
    test, train = traverse.depth_split(g, 1, 0.5)
    a, b = ({r.id for r in x.nodes.collect()} for x in (test, train))
    level = {f"a{i}" for i in range(5)}
    assert len(a & level) == 2 and (a | b) >= level and not (a & b & level) and "r" in a & b
    none, rest = traverse.depth_split(g, 9, 0.5)
    assert none.nodes.count() == rest.nodes.count() == g.nodes.count()  # nothing at that depth: only what is above it
    cover = {r.depth: r for r in traverse.split_coverage(traverse.bfs(g.edges, ids(spark, "r")), test.nodes.select("id"), train.nodes.select("id")).collect()}
    assert (cover[0].shared, cover[1].in_a, cover[1].covered) == (1.0, 0.4, 1.0)
    assert {r.depth for r in traverse.edge_depths(g.edges, traverse.bfs(g.edges, ids(spark, "r"))).collect()} == {0, 1, 2}


def test_taxonomy(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    groups = t([("g", "G", None), ("test", "T", True)], "id string, title string, is_test boolean")
    archives = t([("a", "A", "g", None), ("old", "O", "g", False)], "id string, title string, parent string, is_test boolean")
    cats = t([("a.x", "X", "a"), ("a", "A", "a"), ("o.y", "Y", "old")], "id string, title string, parent string")
    g = traverse.taxonomy("R", groups, archives, cats, t([("old", "a")], "alias string, canonical string"))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("R", "g"), ("g", "a"), ("a", "a.x"), ("a", "o.y")}


@pytest.mark.parametrize("n,m", [(7, 14), (9, 30), (4, 12), (5, 3)])
def test_motifs_against_triples(spark, n, m):
    rng = random.Random(n * m)
    rows = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(0, 0)}
    want = Counter()
    for t in itertools.combinations(range(n), 3):
        code = sum(1 << i for i, (x, y) in enumerate(motif._PLACES) if (t[x], t[y]) in rows)
        if sum(any(code >> j & 1 for j in p) for p in ((0, 1), (2, 3), (4, 5))) >= 2:
            want[motif.canonical(code)] += 1
    e = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "src string, dst string")
    assert {r.motif: r.n for r in motif.census(e).collect()} == dict(want)


def test_motif_classes_and_distance(spark):
    connected = {motif.canonical(c) for c in range(64) if sum(any(c >> j & 1 for j in p) for p in ((0, 1), (2, 3), (4, 5))) >= 2}
    assert len(connected) == 13
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    c, none = motif.census(e), motif.census(e.limit(0))
    assert motif.distance(c, c).first()[0] == 0.0
    assert motif.distance(c, motif.census(spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string"))).first()[0] == 1.0
    assert motif.distance(c, none).first()[0] is None


def test_tables(spark):
    cats = spark.createDataFrame([("1", [5, 6, None, 5]), ("2", None)], "id string, pages array<bigint>")
    pages = spark.createDataFrame([(5, "P", "a")], "id bigint, title string, abstract string")
    found, missing = tables.node_pages(cats, pages)
    assert [r.pos for r in found.orderBy("pos").collect()] == [0, 3] and [r.page_id for r in missing.collect()] == [6]
    assert tables.pages_with_categories(found).first().categories == ["1"]
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 1)], "k string, v int")
    assert {tuple(r) for r in tables.first_of_each(rows, "k", "v").collect()} == {("a", 1), ("b", 3), (None, 1)}
    assert {r.k for r in tables.not_done(rows, rows.where("k = 'a' or k is null"), "k").collect()} == {"b", None}
    known, unknown = tables.known_and_unknown(rows, "k", ids(spark, "a"))
    assert (known.count(), unknown.count()) == (2, 2)
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id int, t string")
    got = {r.batch: r.text for r in tables.text_batches(texts, "id", "t", 10, 3).collect()}
    assert got == {b: "\n".join(f"t{i}" for i in range(b * 10, min(25, b * 10 + 10))) for b in range(3)}
    ex = spark.createDataFrame([(str(i), f"e{i}") for i in range(4)], "id string, title string")
    shots = tables.few_shot(texts, "id", ex, 2).collect()
    assert all(len({e.id for e in r.examples}) == 2 for r in shots) and len({tuple(e.id for e in r.examples) for r in shots}) > 1
    assert [r.id for r in tables.drawn(texts, "id", 5).collect()] == [r.id for r in tables.drawn(texts.orderBy(F.desc("id")), "id", 5).collect()]
