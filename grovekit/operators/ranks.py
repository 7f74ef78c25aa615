"""Places in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Up to so many first rows are gathered in one task.
FEW = 10_000


def _parts(rows: DataFrame) -> int:
    """As many parts as the session's shuffles have."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows in ``order``, columns of which should tell all rows apart; many are found by their place, with the same result."""
    if k <= FEW:
        return rows.orderBy(*order).limit(k)
    return numbered(rows, "_place_", *order).where(F.col("_place_") < k).drop("_place_")


def numbered(rows: DataFrame, name: str, *order, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: their place from 0 in ``order``, columns of which should tell all rows apart.

    Rows are parted by range, counted, and numbered within their part from the number of those ahead; the table of parts has
    ``parts`` rows at most.
    """
    parts = parts or _parts(rows)
    ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = ranged.groupBy("_part").count().withColumn("_ahead", ahead).select("_part", "_ahead")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(off), "_part").withColumn(name, F.col("_place") - 1 + F.col("_ahead")).drop("_part", "_place", "_ahead")


def running_sum(rows: DataFrame, name: str, key: str, value: str, *order, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same key up to this one in ``order``.

    A key that holds a large share of all rows lies in several ranges; each is summed by itself, and a key has at most
    ``parts`` sums to add up.  Nulls add nothing.
    """
    parts = parts or _parts(rows)
    ranged = materialise(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    ahead = F.sum("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    off = ranged.groupBy(key, "_part").agg(F.sum(value).alias("_sum")).withColumn("_ahead", F.coalesce(ahead, F.lit(0.0))).select(key, "_part", "_ahead")
    here = F.sum(value).over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_here", here).join(off, [key, "_part"]).withColumn(name, F.col("_ahead") + F.col("_here")).drop("_part", "_here", "_ahead")
