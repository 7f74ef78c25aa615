"""How often every term occurs, in how many records, and which terms tell records apart (problem 1).

Method: incremental signed deltas merged into persistent partitioned counts; see :mod:`.deltas`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deltas import CountStore, changes_of_log, changes_of_snapshots, signed

KEYS, MEASURES = ("field", "term"), ("occurrences", "records")


def _parts(terms: Column) -> Column:
    """One record's contributions: each occurrence, each distinct term, and the record itself under the null term."""
    terms = F.coalesce(terms, F.array().cast("array<string>"))

    def part(x: Column, occ: int, rec: int) -> Column:
        return F.struct(x.cast("string").alias("term"), F.lit(occ).cast("bigint").alias("o"), F.lit(rec).cast("bigint").alias("r"))

    return F.concat(F.transform(terms, lambda x: part(x, 1, 0)), F.transform(F.array_distinct(terms), lambda x: part(x, 0, 1)), F.array(part(F.lit(None), 0, 1)))


def _deltas(changes: DataFrame) -> DataFrame:
    x = signed(changes, ["field"], _parts)
    return x.select("field", "term", (F.col("o") * F.col("sign")).alias("occurrences"), (F.col("r") * F.col("sign")).alias("records"))


def term_deltas_of_log(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Deltas of a batch ``(field, id, at, terms)`` against ``known(field, id, terms)``: any number of versions of a record.

    A null id is no record.  Null terms are an empty list; null elements of it must be removed by the caller.
    """
    return _deltas(changes_of_log(log.where(F.col("id").isNotNull()), ["field", "id"], "at", "terms", known))


def term_deltas_of_snapshots(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Deltas between two snapshots ``(field, id, terms)`` with one row per record."""
    return _deltas(changes_of_snapshots(old, new, ["field", "id"], "terms"))


def open_store(spark, path: str, buckets: int = 16) -> CountStore:
    return CountStore(spark, path, KEYS, MEASURES, buckets, ("field", "id"))


def deliver(store: CountStore, log: DataFrame, batch: str | None = None, gone: str | None = None) -> bool:
    """Takes in versions ``(field, id, at, terms)`` of records; see :meth:`CountStore.deliver`."""
    return store.deliver(log, "at", "terms", _deltas, batch, gone)


def frequencies(store: CountStore) -> DataFrame:
    """``(field, term, occurrences, records, of_records)`` of every term; ``of_records`` counts all records of the field."""
    counts = store.read()
    n = counts.where("term is null").select("field", F.col("records").alias("of_records"))  # one row per field
    return counts.where("term is not null").join(F.broadcast(n), "field")


def marked(freq: DataFrame, rare_below: int = 3, common_above: int = 10) -> DataFrame:
    """With ``mark``: ``rare`` in fewer than ``rare_below`` records, else ``common`` in more than one in ``common_above`` of all, else null."""
    return freq.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_above > F.col("of_records"), "common"))
