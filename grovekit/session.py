"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of ours on this machine that goes when the driver ends, but only if all runs on this
    machine (master ``local``); on a cluster it must be set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="grovekit-")
        atexit.register(shutil.rmtree, own, True)
        base = "file://" + own
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/grovekit/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`materialise`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/grovekit/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
