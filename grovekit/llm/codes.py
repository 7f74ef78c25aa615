"""Category codes: split, lower case, aliases made canonical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import SPACE

#: Up to this many aliases are looked up in a literal inside the plan; more are joined.
LITERAL_ALIASES = 256


def raw_codes(categories: Column) -> Column:
    """The codes of an array of elements in order, repeated ones kept; nulls and blanks hold none."""
    parts = F.flatten(F.transform(F.filter(categories, lambda c: c.isNotNull()), lambda c: F.split(F.lower(c), SPACE)))
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda c: c != "")


def with_codes(df: DataFrame, aliases: DataFrame, source: str, to: str) -> DataFrame:
    """``df`` with the array ``to`` of canonical codes of its array ``source``.

    An alias that stands twice takes its smallest canonical code.  A long alias table is joined to the distinct code
    lists and not to the rows.
    """
    table = (
        aliases.select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("canonical")).alias("canonical"))
        .where("alias is not null and canonical is not null and alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    )
    few = table.limit(LITERAL_ALIASES + 1).collect()
    df = df.withColumn(to, raw_codes(F.col(source)))
    if not few:
        return df
    if len(few) <= LITERAL_ALIASES:
        known = F.create_map(*[F.lit(x) for r in few for x in (r.alias, r.canonical)])
        return df.withColumn(to, F.transform(to, lambda c: F.coalesce(F.try_element_at(known, c), c)))
    lists = df.select(F.col(to).alias("_k")).distinct()
    named = (
        lists.select("_k", F.posexplode("_k").alias("_p", "alias")).join(table, "alias", "left")
        .groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("canonical", "alias").alias("c")))), lambda x: x["c"]).alias("_v"))
    )
    return df.join(named, df[to] == named["_k"], "left").withColumn(to, F.coalesce("_v", to)).drop("_k", "_v")
