"""Idempotent resume: rows that are done are skipped, in batches and on a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import not_done


def resume(rows: DataFrame, key: str, out: str, work: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Runs ``work`` on the rows whose key the JSON lines below ``out`` lack, and appends; gives the number of new rows."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(schema).json(out) if there else spark.createDataFrame([], schema)
    before = done.count()
    work(not_done(rows, done, key)).write.mode("append").json(out)
    return spark.read.schema(schema).json(out).count() - before


def resume_stream(spark: SparkSession, source: str, schema: str, key: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], out_schema: str):
    """The same for files that arrive in ``source``: each is read once, a micro-batch that is repeated adds nothing."""
    files = spark.readStream.schema(schema).json(source)
    return files.writeStream.foreachBatch(lambda batch, _: resume(batch.dropDuplicates([key]), key, out, work, out_schema) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
