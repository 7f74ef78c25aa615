"""Items that appear together (problem 7).

Method: changed baskets emit signed pair and marginal deltas, which are merged into hash-bucketed persistent counts; the
scores of the pairs affected are then computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .deltas import CountStore, changes_of_log, changes_of_snapshots

KEYS, MEASURES = ("item_a", "item_b"), ("n",)


def _deltas(changes: DataFrame) -> DataFrame:
    """Signed pairs in order, single items (second null) and the basket itself (both null), each counted once for a basket.

    A basket is taken apart item by item, so that of a long one no row holds all pairs.
    """
    basket = lambda items, sign, on: F.struct(F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))).alias("s"), F.lit(sign).cast("bigint").alias("sign"), on.alias("on"))
    has = F.col("has") if "has" in changes.columns else F.lit(True)
    sides = F.array(basket(F.col("new"), 1, has), basket(F.col("old"), -1, F.col("had")))
    x = changes.select(F.explode(F.filter(sides, lambda v: v["on"])).alias("v")).select("v.s", "v.sign")
    whole = x.select(F.lit(None).cast("string").alias("item_a"), F.lit(None).cast("string").alias("item_b"), "sign")
    each = x.select(F.posexplode("s").alias("i", "item_a"), "s", "sign")
    single = F.array(F.lit(None).cast("string"))
    rest = each.select("item_a", F.explode(F.concat(single, F.slice("s", F.col("i") + 2, F.size("s")))).alias("item_b"), "sign")
    return whole.unionByName(rest).select("item_a", "item_b", F.col("sign").alias("n"))


def pair_deltas_of_log(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Deltas of a batch ``(id, at, items)`` against ``known(id, items)``; items may repeat in a basket, a null id is no basket."""
    return _deltas(changes_of_log(log.where(F.col("id").isNotNull()), ["id"], "at", "items", known))


def pair_deltas_of_snapshots(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return _deltas(changes_of_snapshots(old, new, ["id"], "items"))


class PairStore(CountStore):
    """Counts of pairs, items and baskets, and the scores of pairs, of which a merge recomputes those that it affects: pairs whose own
    count or either item's changed.  The number of all baskets, which changes every ratio alike, comes in when scores are read."""

    def scores_schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), *(T.StructField(c, T.LongType()) for c in ("n_ab", "n_a", "n_b"))])

    def scored(self, m: dict, delta: DataFrame, attempt: str) -> None:
        c = self._read(m, "counts", self.schema)
        pairs = c.where("item_b is not null")
        fresh = not m["parts"].get("scores")
        if not fresh:
            items = delta.where("item_a is not null and item_b is null").select(F.col("item_a").alias("item"))
            hit = pairs.select(*KEYS).join(items, F.col("item_a") == F.col("item"), "left_semi").unionByName(pairs.select(*KEYS).join(items, F.col("item_b") == F.col("item"), "left_semi"))
            keys = materialise(hit.unionByName(delta.where("item_b is not null").select(*KEYS)).distinct(), "affected")
            pairs = pairs.join(keys, list(KEYS), "left_semi")
        single = c.where("item_a is not null and item_b is null")
        new = pairs.withColumnRenamed("n", "n_ab").join(single.select("item_a", F.col("n").alias("n_a")), "item_a").join(single.select(F.col("item_a").alias("item_b"), F.col("n").alias("n_b")), "item_b").select(*KEYS, "n_ab", "n_a", "n_b")
        touched = list(range(m["buckets"])) if fresh else self._touched(keys, KEYS, m["buckets"])
        if not fresh:
            new = self._read(m, "scores", self.scores_schema(), touched).join(keys, list(KEYS), "left_anti").unionByName(new)
        self._write(m, "scores", new, KEYS, touched, attempt)

    def scores(self) -> DataFrame:
        return self._read(self.manifest(), "scores", self.scores_schema())


def open_store(spark, path: str, buckets: int = 16) -> PairStore:
    return PairStore(spark, path, KEYS, MEASURES, buckets, ("id",))


def deliver(store: PairStore, log: DataFrame, batch: str | None = None, gone: str | None = None) -> bool:
    """Takes in versions ``(id, at, items)`` of baskets; see :meth:`CountStore.deliver`."""
    return store.deliver(log, "at", "items", _deltas, batch, gone)


def associations(store: PairStore, min_together: int = 1) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift)``; lift is the count over that expected by chance, n_ab * n / (n_a * n_b)."""
    total = store.read().where("item_a is null").select(F.col("n").alias("n"), F.lit(1).alias("_one"))  # one row
    return (
        store.scores().where(F.col("n_ab") >= min_together).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
        .withColumn("lift", F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b").cast("double")))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift")
    )


def strong(assoc: DataFrame, times: int = 3) -> DataFrame:
    """Pairs at least ``times`` as often together as by chance, compared in whole numbers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return assoc.where(big("n_ab") * big("n") >= big("n_a") * big("n_b") * F.lit(times))
