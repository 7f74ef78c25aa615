"""Joins and clean-up between pages, categories and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import first, numbered


def node_pages(cats: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)`` of ``cats(id, pages)``: (node_id, page_id, pos, title, abstract) in list order, and references without a page."""
    refs = cats.select(F.col("id").alias("node_id"), F.posexplode("pages").alias("pos", "page_id")).where("page_id is not null")
    p = pages.select(F.col("id").alias("page_id"), "title", "abstract")
    return refs.join(p, "page_id"), refs.join(p.select("page_id"), "page_id", "left_anti")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done; rows without a key stay."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def known_and_unknown(rows: DataFrame, key: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known node, and the rejects."""
    ids = nodes.select(F.col("id").alias(key)).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def pages_with_categories(refs: DataFrame) -> DataFrame:
    """``(page_id, title, abstract, categories)``: the categories of each page sorted, its text from the first reference."""
    text = F.min_by(F.struct("title", "abstract"), F.struct("node_id", "pos"))
    return refs.groupBy("page_id").agg(text.alias("t"), F.array_sort(F.collect_set("node_id")).alias("categories")).select("page_id", "t.title", "t.abstract", "categories")


def text_batches(pages: DataFrame, key: str, text: str, size: int = 1000, parts: int | None = None) -> DataFrame:
    """``(batch, text)``: texts in order of the key, ``size`` to a batch, joined by line breaks.

    Keys are numbered from counts by range, so no task orders all of them.
    """
    n = numbered(pages.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")), "n", "k", "t", parts=parts)
    return n.groupBy(F.floor(F.col("n") / size).cast("long").alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))


def few_shot(rows: DataFrame, key: str, examples: DataFrame, k: int, seed: int = 0, example_key: str = "id") -> DataFrame:
    """Rows with ``examples``: k of a bounded example set, drawn by hash for each row, as an array of structs.

    The set must be small (it is asked for in prompts); more than 10,000 examples are refused.
    """
    got = examples.limit(10_001).collect()
    if len(got) > 10_000:
        raise ValueError("more than 10,000 examples")
    if not got:
        return rows.withColumn("examples", F.lit(None))
    local = rows.sparkSession.createDataFrame(got, examples.schema)
    all_ = local.agg(F.collect_list(F.struct(*examples.columns)).alias("_all")).withColumn("_one", F.lit(1))
    order = lambda e: F.struct(F.md5(F.concat_ws("/", F.col(key).cast("string"), e[example_key].cast("string"), F.lit(str(seed)))).alias("h"), e.alias("e"))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(all_), "_one").withColumn("examples", F.transform(F.slice(F.array_sort(F.transform("_all", order)), 1, k), lambda x: x["e"])).drop("_one", "_all")


def drawn(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in a seeded random order."""
    return first(rows, n, F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key)
