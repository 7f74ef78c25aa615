import json

import pytest
from pyspark.sql import functions as F

from grovekit import models
from grovekit.graph import SAMPLE
from grovekit.sources import files, limits
from grovekit.streaming import resume

DOC = {"directed": True, "multigraph": False, "graph": {"root": "r"}, "nodes": [{"id": "r", "title": "R", "pages": [{"id": "p", "title": "P", "abstract": "x"}]}, {"id": "a", "title": "A", "pages": []}, {"id": "b", "title": "B"}], "links": [{"source": "r", "target": "a"}, {"source": "a", "target": "b", "weight": 2.0}]}


def test_node_link_round_trip(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps(DOC, indent=1))
    g = files.load_graph(spark, str(path))
    assert g.root == "r" and {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {("r", "a", 1.0), ("a", "b", 2.0)}
    assert g.node_pages.count() == 1 and files.load_graph(spark, str(path), 1).nodes.count() == 2
    back = json.loads(files.node_link(g).first().value)
    assert back["graph"] == {"root": "r"} and {n["id"] for n in back["nodes"]} == {"r", "a", "b"} and len(back["links"]) == 2
    files.save_graph(g, str(tmp_path / "g"))
    h = files.open_graph(spark, str(tmp_path / "g"))
    assert h.root == "r" and h.edges.count() == 2 and h.pages.first().title == "P"


def test_lines(spark, tmp_path):
    for name, text in (("a", '{"id":"1","title":"T","paths":[["x","y"]]}\nbroken\n'), ("b", '{"id":"2"}\n')):
        (tmp_path / name).write_text(text)
    rows = files.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")], SAMPLE).collect()
    assert sorted(r.id or "" for r in rows) == ["", "1", "2"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_lines(spark, str(tmp_path / "a"), SAMPLE, strict=True).collect()
    out = str(tmp_path / "out")
    for i in range(2):
        files.append_lines(spark.createDataFrame([(i,)], "i int"), out)
    assert spark.read.json(out).count() == 2


def test_small_formats(spark, tmp_path):
    (tmp_path / "x.conll").write_text("a cat ||| animal ||| such as 1\nO\n\n")
    assert [tuple(r) for r in files.read_pattern_lines(spark, str(tmp_path / "x.conll")).collect()] == [("a cat", "animal")]
    (tmp_path / "s.tsv").write_text("hypo\thyper\tsim\tis_oov\na\tb\t0.5\t0\nc\td\t0.1\t1\n")
    assert [tuple(r) for r in files.read_scores(spark, str(tmp_path / "s.tsv")).collect()] == [("a", "b", 0.5)]
    files.write_text_batches(spark.createDataFrame([(0, "x\ny"), (1, "z")], "batch long, text string"), str(tmp_path / "t"))
    assert {(r.batch, r.value) for r in spark.read.text(str(tmp_path / "t")).collect()} == {(0, "x"), (0, "y"), (1, "z")}
    df = spark.createDataFrame([("a", 2), ("b", None)], "k string, n int")
    assert [json.loads(r.value) for r in files.json_row(df).collect()] == [{"k": "a", "n": 2}, {"k": "b", "n": None}]
    assert json.loads(files.counted_json(df.where("n > 0"), "k", "n").first().value) == {"a": 2}


def test_api_records(spark):
    one = {"category": {"id": 1, "title": "Category:Top"}, "query": {"categorymembers": [{"pageid": 5, "ns": 0, "title": "P"}, {"pageid": 2, "ns": 14, "title": "Category:Sub"}, {"pageid": 9, "ns": 0, "title": "Gone", "missing": True}]}}
    two = {"category": {"id": 1, "title": "Category:Top"}, "query": {"categorymembers": [{"pageid": 6, "ns": 0, "title": "Q"}, {"pageid": 8, "ns": 6, "title": "File:x"}]}}
    none = {"category": {"id": 3, "title": "Category:Empty"}, "query": {"categorymembers": []}}
    df = spark.read.schema(files.CATEGORY_RESPONSE).json(spark.sparkContext.parallelize([json.dumps(x) for x in (one, two, none)]))
    got = {r.id: r for r in files.category_records(df).collect()}
    assert got[1].title == "Top" and got[1].pages == [5, 6] and [tuple(s) for s in got[1].sub_categories] == [(2, "Sub")] and got[3].pages == []
    pages = spark.createDataFrame([(([(1, "A", "text", None), (2, "B", " ", None), (3, "C", "x", True), (1, "A", "text", None)],),)], files.EXTRACT_RESPONSE)
    assert [r.id for r in files.page_records(pages).collect()] == [1]
    req = spark.createDataFrame([(["a", "b"], [3, None])], "ids array<string>, results array<int>")
    assert [tuple(r) for r in files.citations(req).collect()] == [("a", 3)]


def test_crawl_takes_each_category_once_at_its_smallest_depth(spark):
    web = spark.createDataFrame([(1, [(2,), (3,)]), (2, [(3,), (1,)]), (3, [(4,)]), (4, [])], "id bigint, sub_categories array<struct<id:bigint>>")
    seeds = spark.createDataFrame([(1,)], "id bigint")
    got = files.crawl(spark, seeds, lambda ids: web.join(ids, "id"), 2).collect()
    assert sorted((r.id, r.depth) for r in got) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert files.crawl(spark, seeds, lambda ids: web.join(ids, "id"), 0).count() == 1


def test_limits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = limits.RateLimit(2, 1.0, lambda: now[0], sleep)
    for _ in range(5):
        with limit:
            pass
    assert now[0] == pytest.approx(2.0)
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert limits.retried(fails, 3, slept.append) == "ok" and slept[-2:] == [1, 2]
    with pytest.raises(ZeroDivisionError):
        limits.retried(lambda: 1 / 0, 2, lambda s: None)


def test_resume_in_batches_and_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    out, schema = str(tmp_path / "out"), "id string, n int"
    work = lambda d: d.withColumn("n", F.lit(1))
    assert resume.resume(rows.limit(2), "id", out, work, schema) == 2
    assert resume.resume(rows, "id", out, work, schema) == 1
    assert resume.resume(rows, "id", out, work, schema) == 0
    src = tmp_path / "in"
    src.mkdir()
    target = str(tmp_path / "streamed")
    for i in range(2):
        (src / f"{i}.json").write_text('{"id":"x"}\n{"id":"x"}\n{"id":"y%d"}\n' % i)
        q = resume.resume_stream(spark, str(src), "id string", "id", target, str(tmp_path / "ck"), work, schema)
        q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.json(target).collect()) == ["x", "y0", "y1"]


def test_models(spark):
    nodes = spark.createDataFrame([("cat",), ("dog",), ("cat",), (None,)], "title string")
    known = spark.createDataFrame([("dog", [1.0])], "title string, embed array<float>")
    got = {r.title: list(r.embed) for r in models.embed_titles(nodes, known, lambda: models.HashEmbedder(8)).collect()}
    assert got["dog"] == [1.0] and len(got["cat"]) == 8 and got["cat"] == models.HashEmbedder(8).embed(["cat"])[0].tolist()
    chats = spark.createDataFrame([("k", [("user", "a\n\nb")]), ("e", None)], "id string, m array<struct<role:string,content:string>>")
    assert {r.id: r.out for r in models.generate(chats, "id", "m", "out", models.EchoGenerator).collect()} == {"k": "a", "e": ""}
    two = models.two_rounds(spark.createDataFrame([("k", "first")], "id string, p string"), "id", "p", "second", lambda: models.EchoGenerator(str.upper)).first()
    assert (two.description, two.hierarchy) == ("FIRST", "SECOND")
    s = models.score_pairs(spark.createDataFrame([("a b", "b c"), ("x", "y")], "src string, dst string"), models.OverlapScorer).collect()
    assert s[0].weight > 0.5 > s[1].weight
