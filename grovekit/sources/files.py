"""Readers and writers: node-link graphs, JSON lines, pattern lines, score tables, API responses, text batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pattern_line
from ..graph import TaxoGraph
from ..keys import is_blank

NODE_LINK = (
    "directed boolean, multigraph boolean, graph struct<root:string>, nodes array<struct<id:string,title:string,pages:array<struct<id:string,title:string,abstract:string>>>>, "
    "links array<struct<source:string,target:string,weight:double>>"
)


def load_graph(spark: SparkSession, path: str, depth: int | None = None) -> TaxoGraph:
    """A graph from a node-link JSON file, cut to ``depth`` steps from its root where that is above 0."""
    doc = spark.read.schema(NODE_LINK).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), F.coalesce("l.weight", F.lit(1.0)).alias("weight"))
    row = doc.select("graph.root").first()
    pages = nodes.select(F.col("id").alias("node_id"), F.posexplode("pages").alias("pos", "p")).select("node_id", "pos", F.col("p.id").alias("page_id"), "p.title", "p.abstract")
    one = pages.groupBy(F.col("page_id").alias("id")).agg(F.min_by(F.struct("title", "abstract"), F.struct("node_id", "pos")).alias("t")).select("id", "t.*")
    g = TaxoGraph(nodes.select("id", "title"), edges, row[0] if row else None, one, pages.select("node_id", "page_id", "pos"))
    return g.ego(depth)


def save_graph(g: TaxoGraph, path: str, depth: int | None = None) -> None:
    """The graph as Parquet tables below ``path``: nodes, edges, pages and node_pages, and its root."""
    g = g.ego(depth)
    for name in ("nodes", "edges", "pages", "node_pages"):
        if (df := getattr(g, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    g.nodes.sparkSession.createDataFrame([(g.root,)], "root string").coalesce(1).write.mode("overwrite").json(f"{path}/graph")


def open_graph(spark: SparkSession, path: str) -> TaxoGraph:
    """A graph written by :func:`save_graph`."""
    def table(name):
        try:
            return spark.read.parquet(f"{path}/{name}")
        except Exception:  # noqa: BLE001 - a table that was not written
            return None

    return TaxoGraph(table("nodes"), table("edges"), spark.read.schema("root string").json(f"{path}/graph").first()[0], table("pages"), table("node_pages"))


def node_link(g: TaxoGraph) -> DataFrame:
    """One row ``value``: the graph as one node-link JSON document, for graphs that fit one document."""
    if g.node_pages is not None:
        per = g.node_pages.join(g.pages.select(F.col("id").alias("page_id"), "title", "abstract"), "page_id").groupBy(F.col("node_id").alias("id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "page_id", "title", "abstract"))), lambda p: F.struct(p["page_id"].alias("id"), p["title"].alias("title"), p["abstract"].alias("abstract"))).alias("pages"))
        nodes = g.nodes.join(per, "id", "left")
    else:
        nodes = g.nodes.withColumn("pages", F.array().cast("array<struct<id:string,title:string,abstract:string>>"))
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "title", F.coalesce("pages", F.array().cast("array<struct<id:string,title:string,abstract:string>>")).alias("pages")))).alias("nodes"))
    l = g.edges.agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("weight", F.lit(1.0)).alias("weight")))).alias("links"))
    both = n.withColumn("_one", F.lit(1)).join(l.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.struct(F.lit(g.root).alias("root")).alias("graph"), "nodes", "links")).alias("value"))


def read_lines(spark: SparkSession, paths: str | Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of one or several files by a fixed schema; bad lines become nulls, or fail where ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json([paths] if isinstance(paths, str) else list(paths))


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_pattern_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(child, parent)`` of the lines ``child|||parent|||rule`` of one-column files; other lines are ignored."""
    child, parent = pattern_line(F.col("value"))
    return spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(child.alias("child"), parent.alias("parent")).where("child is not null and child <> '' and parent <> ''")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(l, r, score)`` of a tab-separated table with a header, rows out of vocabulary left out."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("hypo string, hyper string, sim double, is_oov string").csv(path)
    return rows.where(~F.lower(F.coalesce("is_oov", F.lit("0"))).isin("1", "true")).select(F.col("hypo").alias("l"), F.col("hyper").alias("r"), F.col("sim").alias("score"))


def write_text_batches(batches: DataFrame, path: str) -> None:
    """``(batch, text)`` as one text file for each batch below ``path/batch=n``."""
    batches.select("batch", "text").repartition("batch").write.mode("overwrite").partitionBy("batch").text(path)


def json_row(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in ``value``, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def counted_json(counts: DataFrame, key: str, n: str) -> DataFrame:
    """A two-column table as one JSON object from key to number."""
    return counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, n))))).alias("value"))


CATEGORY_RESPONSE = "category struct<id:bigint,title:string>, query struct<categorymembers:array<struct<pageid:bigint,ns:int,title:string,missing:boolean>>>"


def category_records(responses: DataFrame) -> DataFrame:
    """Raw categories from downloaded member listings, one row for each response, several for a category that continues.

    Members of name space 14 are sub-categories, those of 0 pages; missing ones are dropped, and the prefix of category
    titles goes.
    """
    m = responses.select("category.*", F.explode("query.categorymembers").alias("m")).where(~F.coalesce("m.missing", F.lit(False)))
    bare = lambda c: F.regexp_replace(c, "^Category:", "")
    subs = F.array_sort(F.collect_set(F.when(F.col("m.ns") == 14, F.struct(F.col("m.pageid").alias("id"), bare(F.col("m.title")).alias("title")))))
    pages = F.array_sort(F.collect_set(F.when(F.col("m.ns") == 0, F.col("m.pageid"))))
    every = responses.select("category.*").distinct().withColumn("title", bare(F.col("title")))
    got = m.groupBy("id").agg(pages.alias("pages"), subs.alias("sub_categories"))
    return every.join(got, "id", "left").select("id", "title", F.coalesce("pages", F.array().cast("array<bigint>")).alias("pages"), F.coalesce("sub_categories", F.array().cast("array<struct<id:bigint,title:string>>")).alias("sub_categories"))


EXTRACT_RESPONSE = "query struct<pages:array<struct<pageid:bigint,title:string,extract:string,missing:boolean>>>"


def page_records(responses: DataFrame) -> DataFrame:
    """``(id, title, abstract)`` from downloaded extracts; missing and empty ones are dropped, repeated ones fall together."""
    p = responses.select(F.explode("query.pages").alias("p")).where(~F.coalesce("p.missing", F.lit(False)))
    return p.select(F.col("p.pageid").alias("id"), F.col("p.title").alias("title"), F.col("p.extract").alias("abstract")).where(~is_blank(F.col("abstract"))).dropDuplicates(["id"])


def citations(requests: DataFrame) -> DataFrame:
    """``(id, citation_count)`` from ``(ids, results)``: results stand in the order of the ids, null where none was found."""
    z = requests.select(F.explode(F.arrays_zip("ids", "results")).alias("z"))
    return z.where("z.results is not null").select(F.col("z.ids").alias("id"), F.col("z.results").alias("citation_count"))


def crawl(spark: SparkSession, seeds: DataFrame, fetch, most: int) -> DataFrame:
    """Raw categories up to ``most`` steps from ``seeds(id)``, level by level; ``fetch(ids) -> raw categories`` asks the source.

    A category is fetched once, at its smallest depth, in which the result differs from a crawl whose order decides.
    """
    from ..session import materialise

    front = materialise(seeds.select("id").distinct(), "front")
    seen, out = front, None
    for depth in range(most + 1):
        got = materialise(fetch(front).withColumn("depth", F.lit(depth)), "level")
        out = got if out is None else out.unionByName(got)
        new = got.select(F.explode("sub_categories").alias("s")).select("s.id").where("id is not null").distinct().join(seen, "id", "left_anti")
        front = materialise(new, "front")
        seen = seen.unionByName(front)
        if not front.limit(1).count():
            break
    return out
