"""The rooted property graph: nodes ``(id, title)``, edges ``(src, dst, weight)``, pages and their bridge."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("weight", T.DoubleType())])
PAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType())])
NODE_PAGES = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("pos", T.IntegerType())])
RAW_CATEGORY = "id bigint, title string, pages array<bigint>, sub_categories array<struct<id:bigint,title:string>>"
RAW_PAPER = "id string, title string, abstract string, categories string, versions array<struct<version:string,created:string>>"
SAMPLE = "id string, title string, abstract string, paths array<array<string>>"
TRIPLETS = "id string, title string, abstract string, triplets array<struct<head:string,type:string,tail:string>>"


@dataclass(frozen=True)
class TaxoGraph:
    """A directed graph held in DataFrames; ids are strings, a null weight reads as one, ``root`` may be unknown."""

    nodes: DataFrame
    edges: DataFrame
    root: str | None = None
    pages: DataFrame | None = None
    node_pages: DataFrame | None = None

    @classmethod
    def of_edges(cls, edges: DataFrame, root: str | None = None) -> "TaxoGraph":
        """A graph whose nodes are the ends of its edges; titles are ids."""
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(ids.select("id", F.col("id").alias("title")), edges, root)

    def titled_edges(self) -> DataFrame:
        """``(src, dst, weight)`` with titles for ids."""
        a = self.nodes.select(F.col("id").alias("src"), F.col("title").alias("ts"))
        b = self.nodes.select(F.col("id").alias("dst"), F.col("title").alias("td"))
        return self.edges.join(a, "src").join(b, "dst").select(F.col("ts").alias("src"), F.col("td").alias("dst"), "weight")

    def induced(self, ids: DataFrame) -> "TaxoGraph":
        """The subgraph on ``ids(id)``: edges with both ends in it."""
        keep = ids.select("id").distinct()
        e = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, nodes=self.nodes.join(keep, "id", "left_semi"), edges=e.select("src", "dst", "weight"))

    def reversed(self) -> "TaxoGraph":
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def undirected(self) -> "TaxoGraph":
        """Both directions of each edge, once."""
        e = self.edges.select("src", "dst").union(self.edges.select("dst", "src")).distinct()
        return replace(self, edges=e.withColumn("weight", F.lit(1.0)))

    def ego(self, depth: int | None) -> "TaxoGraph":
        """What is within ``depth`` steps of the root, edges among it included; 0 and null mean no limit."""
        if not depth or depth < 0:
            return self
        from .operators.traverse import bfs

        if self.root is None:
            raise ValueError("a depth needs a root")
        return self.induced(bfs(self.edges, self.nodes.where(F.col("id") == self.root).select("id"), depth).select("id"))
