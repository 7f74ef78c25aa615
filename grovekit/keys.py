"""Column expressions for title keys, words and standing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of any script, tabs, no-break spaces and separators included.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
NO_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"
#: A word: a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def title_key(c: Column) -> Column:
    """White space runs made one blank, ends trimmed, lower case; null for null and blank titles."""
    k = F.trim(F.lower(F.regexp_replace(c, SPACE, " ")))
    return F.when(k != "", k)


def title_keys(titles: Column) -> Column:
    """The keys of an array of titles in order, without those that are no titles."""
    return F.filter(F.transform(titles, title_key), lambda k: k.isNotNull())


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space; a text is read no further than its first other sign."""
    return ~F.coalesce(c.rlike(NO_SPACE), F.lit(False))


def words(c: Column) -> Column:
    """The words of a text in order, lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def standing(df: DataFrame, key: str, at: str, *payload: str) -> DataFrame:
    """The standing row of every ``key``: that with the latest ``at``.

    Derive small payload columns first: only key, time and payload are shuffled.  Rows without a key are no records and
    are left out; a null time is older than any other; rows that tie on the time are told apart by a hash of their
    payload, so that a retried task picks the same one.
    """
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*payload) if payload else F.lit(0))
    return (
        df.select(key, at, *payload).where(F.col(key).isNotNull())
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, *payload)
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
