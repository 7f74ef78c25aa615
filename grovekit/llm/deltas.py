"""Signed deltas and the persistent, hash-bucketed counts they are merged into.

Records are delivered in batches, some of them more than once.  What a batch changes of a record gives a signed delta:
``+1`` for what its new version holds, ``-1`` for what the known one held, and nothing where both hold the same.
Deltas of any number of batches add up to the counts over the standing versions, so a batch costs what it changes and
not what the collection holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Rows of a bucket, on average, beyond which there are twice as many.
BUCKET_ROWS = 4_000_000


def standing_of_log(log: DataFrame, key: Sequence[str], at: str, items: str, keep_time: bool = False) -> DataFrame:
    """``(key.., items)``: the newest version of each record; null times are oldest.

    Versions are thinned out before they are shuffled, so a record delivered very often is no single task.
    """
    w = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(items))
    return log.select(*key, at, items).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, *([at] if keep_time else []), items)


def changes_of_log(log: DataFrame, key: Sequence[str], at: str, items: str, known: DataFrame | None = None) -> DataFrame:
    """``(key.., new, old, had)`` of a batch of delivered versions, against what is ``known`` of the records so far.

    Versions within the batch that do not stand cancel out and are not looked at; records that are not in the batch are
    unchanged; a record whose items are as known makes no row.
    """
    new = standing_of_log(log, key, at, items).withColumnRenamed(items, "new")
    if known is None:
        return new.withColumn("old", F.lit(None).cast(new.schema["new"].dataType)).withColumn("had", F.lit(False))
    old = known.select(*key, F.col(items).alias("old"), F.lit(True).alias("had"))
    j = new.join(old, list(key), "left").withColumn("had", F.coalesce("had", F.lit(False)))
    return j.where(~F.col("had") | ~F.col("new").eqNullSafe(F.col("old")))


def changes_of_snapshots(old: DataFrame | None, new: DataFrame, key: Sequence[str], items: str) -> DataFrame:
    """The same from two snapshots with one row per record: added, changed and deleted records only; without ``old`` all are added."""
    if old is None:
        return new.select(*key, F.col(items).alias("new"), F.lit(None).cast(new.schema[items].dataType).alias("old"), F.lit(False).alias("had"))
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col(items).alias("old"), F.lit(True).alias("had"))
    n = new.select(*key, F.col(items).alias("new"), F.lit(True).alias("has"))
    on = [F.col(k) == F.col(f"o_{k}") for k in key]
    return (
        n.join(o, on, "full_outer")
        .where(F.col("has").isNull() | F.col("had").isNull() | ~F.col("new").eqNullSafe(F.col("old")))
        .select(*[F.coalesce(k, f"o_{k}").alias(k) for k in key], "new", "old", F.coalesce("had", F.lit(False)).alias("had"), F.coalesce("has", F.lit(False)).alias("has"))
    )


def signed(changes: DataFrame, keep: Sequence[str], contributions) -> DataFrame:
    """Explodes the changes: ``contributions(items) -> array<struct>`` of what one version adds, with a column ``sign``."""
    def one(items: Column, sign: int) -> Column:
        return F.transform(contributions(items), lambda x: F.struct(x.alias("c"), F.lit(sign).cast("bigint").alias("sign")))

    has = F.col("has") if "has" in changes.columns else F.lit(True)
    empty = F.filter(one(F.col("new"), 1), lambda _: F.lit(False))
    both = F.concat(F.when(has, one(F.col("new"), 1)).otherwise(empty), F.when(F.col("had"), one(F.col("old"), -1)).otherwise(empty))
    return changes.select(*keep, F.explode(both).alias("_x")).select(*keep, "_x.c.*", F.col("_x.sign").alias("sign"))


class CountStore:
    """Counts by key, and what is known of the records behind them, kept as Parquet in hash buckets.

    A merge writes the buckets that its deltas touch to a folder of its own and then publishes a manifest under the next
    number, by one rename.  The newest manifest holds, so a merge that dies anywhere before leaves everything as it was and can
    be tried again; a batch whose id is in the manifest is not counted twice.  Buckets double when they hold more than
    ``BUCKET_ROWS`` rows on average.  Null is a key like any other, and rows whose measures all come to zero are dropped.  A
    store has one writer at a time; old folders stay for readers of older manifests.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: Sequence[str], buckets: int = 16, record: Sequence[str] = ()):
        self.spark, self.path, self.keys, self.measures, self.first_buckets, self.record = spark, path.rstrip("/"), list(keys), list(measures), buckets, list(record)
        self.schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField(m, T.LongType()) for m in measures])
        self.known_schema = T.StructType([T.StructField(k, T.StringType()) for k in record] + [T.StructField("at", T.TimestampType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("gone", T.BooleanType())])

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The newest manifest: number, buckets, parts (table to bucket to folder), rows, batches."""
        fs, p = self._fs("manifests")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().startswith((".", "_"))) if fs.exists(p) else []
        if not names:
            return {"number": 0, "buckets": self.first_buckets, "parts": {}, "rows": 0, "batches": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def _publish(self, m: dict) -> None:
        fs, tmp = self._fs(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        _, p = self._fs(f"manifests/{m['number']:012d}")
        if fs.exists(p) or not fs.rename(tmp, p):
            raise RuntimeError(f"{p.toString()} is there: another merge came first")

    def _read(self, m: dict, what: str, schema: T.StructType, only: Sequence[int] | None = None) -> DataFrame:
        folders = sorted(f"{self.path}/{folder}/bucket={b}" for b, folder in m["parts"].get(what, {}).items() if only is None or int(b) in only)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self.manifest(), "counts", self.schema)

    def known(self) -> DataFrame:
        """``(*record, at, items)`` of the records that stand."""
        return self._read(self.manifest(), "known", self.known_schema).where("not gone").drop("gone")

    def _bucket(self, keys: Sequence[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _write(self, m: dict, what: str, rows: DataFrame, keys: Sequence[str], touched: Sequence[int], attempt: str) -> None:
        """Writes the new content of the touched buckets; ``m`` then names it."""
        folder = f"{attempt}/{what}"
        rows.withColumn("bucket", self._bucket(keys, m["buckets"])).repartition(m["buckets"], "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(folder)
        there = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")}
        parts = m["parts"].setdefault(what, {})
        for b in touched:
            parts.pop(str(b), None)
            if b in there:
                parts[str(b)] = folder

    def _touched(self, rows: DataFrame, keys: Sequence[str], n: int) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(keys, n).alias("b")).distinct().collect())  # at most n rows

    def _grown(self, m: dict, attempt: str) -> None:
        """Twice as many buckets, all rewritten, as often as they hold too many rows."""
        n = m["buckets"]
        while m["rows"] > n * BUCKET_ROWS:
            n *= 2
        if n != m["buckets"]:
            old, m["buckets"] = {k: dict(v) for k, v in m["parts"].items()}, n
            for what, schema, keys in (("counts", self.schema, self.keys), ("known", self.known_schema, self.record), ("scores", self.scores_schema(), self.keys)):
                if old.get(what):
                    m["parts"][what] = {}
                    self._write(m, what, self._read({"parts": old}, what, schema), keys, range(n), f"{attempt}-grown")

    def scores_schema(self) -> T.StructType:
        return T.StructType([])

    def scored(self, m: dict, delta: DataFrame, attempt: str) -> None:
        """A hook for what is derived from the counts; called before they are published."""

    def _merge_counts(self, m: dict, deltas: DataFrame, attempt: str) -> None:
        sums = [F.sum(c).cast("bigint").alias(c) for c in self.measures]
        some = None
        for x in self.measures:
            some = (F.col(x) != 0) if some is None else some | (F.col(x) != 0)
        delta = materialise(deltas.groupBy(*self.keys).agg(*sums).where(some), "delta")
        fresh = not m["parts"].get("counts")
        touched = list(range(m["buckets"])) if fresh else self._touched(delta, self.keys, m["buckets"])
        new = delta if fresh else self._read(m, "counts", self.schema, touched).unionByName(delta).groupBy(*self.keys).agg(*sums).where(some)
        self._write(m, "counts", new, self.keys, touched, attempt)
        self.scored(m, delta, attempt)
        m["rows"] = self._read(m, "counts", self.schema).count()  # from the files' footers
        self._grown(m, attempt)

    def _next(self, batch: str | None) -> tuple[dict, str] | None:
        m = self.manifest()
        if batch is not None and batch in m["batches"]:
            return None
        m["number"] += 1
        m["batches"] += [batch] if batch is not None else []
        return m, f"{m['number']:012d}-{uuid.uuid4().hex}"

    def merge(self, deltas: DataFrame, batch: str | None = None) -> bool:
        """Adds ``deltas``, which has the keys and measures, several rows to a key or none; false where the batch is in already."""
        if (x := self._next(batch)) is None:
            return False
        self._merge_counts(x[0], deltas, x[1])
        self._publish(x[0])
        return True

    def deliver(self, log: DataFrame, at: str, items: str, deltas_of: Callable[[DataFrame], DataFrame], batch: str | None = None, gone: str | None = None) -> bool:
        """Takes in delivered versions of records and advances the counts and what is known, together.

        Of a record's versions, those known included, the newest counts; an older one that comes late changes nothing, nor does
        one as old as that known.  A version with ``gone`` deletes its record, and stands like others, so that an older one
        that comes later doesn't bring it back.  Rows without a full record key are no records.  False where the batch is in
        already.
        """
        if (x := self._next(batch)) is None:
            return False
        m, attempt = x
        log = log.select(*[F.col(k).cast("string").alias(k) for k in self.record], F.col(at).cast("timestamp").alias("at"), F.col(items).alias("items"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
        log = log.where(" and ".join(f"{k} is not null" for k in self.record)).withColumn("_v", F.struct("items", "gone"))
        new = standing_of_log(log, self.record, "at", "_v", keep_time=True).select(*self.record, "at", "_v.*")
        fresh = not m["parts"].get("known")
        if fresh:
            touched = list(range(m["buckets"]))
            won = new.withColumn("old", F.lit(None).cast("array<string>")).withColumn("had", F.lit(False)).withColumn("wins", F.lit(True))
        else:
            new = materialise(new, "versions")  # read for the touched buckets too
            touched = self._touched(new, self.record, m["buckets"])
            known = self._read(m, "known", self.known_schema, touched)
            o = known.select(*[F.col(k).alias(f"_{k}") for k in self.record], F.col("at").alias("_at"), F.col("items").alias("_items"), F.col("gone").alias("_gone"))
            j = new.join(o, [F.col(k) == F.col(f"_{k}") for k in self.record], "full_outer")
            here, there = F.col(self.record[0]).isNotNull(), F.col(f"_{self.record[0]}").isNotNull()
            wins = here & (~there | F.coalesce(F.col("at") > F.col("_at"), F.col("at").isNotNull() & F.col("_at").isNull()))
            pick = lambda c: F.when(wins, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
            won = j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in self.record], pick("at"), pick("items"), pick("gone"), F.col("_items").alias("old"), (there & ~F.col("_gone")).alias("had"), wins.alias("wins"))
        if not fresh:
            won = materialise(won, "won")
        self._write(m, "known", won.select(*self.record, "at", "items", "gone"), self.record, touched, attempt)
        if fresh:
            won = self._read(m, "known", self.known_schema).withColumn("old", F.lit(None).cast("array<string>")).withColumn("had", F.lit(False)).withColumn("wins", F.lit(True))
        changed = won.where("wins").select(*self.record, F.col("items").alias("new"), "old", "had", (~F.col("gone")).alias("has")).where("has <> had or (has and had and not (new <=> old))")
        self._merge_counts(m, deltas_of(changed), attempt)
        self._publish(m)
        return True
