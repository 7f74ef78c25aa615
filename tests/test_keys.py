import datetime

from pyspark.sql import functions as F

from grovekit import keys


def test_title_keys_and_words(spark):
    rows = [(" A  b\t\n",), ("",), (None,), ("  　 ",), ("Ünïx_9 ²",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.k for r in df.select(keys.title_key(F.col("t")).alias("k")).collect()]
    assert got == ["a b", None, None, None, "ünïx_9 ²"]
    assert [r.w for r in df.select(keys.words(F.col("t")).alias("w")).collect()] == [["a", "b"], [], [], [], ["ünïx", "9", "²"]]


def test_standing(spark):
    d = datetime.datetime
    rows = [("a", d(2020, 1, 1), "old"), ("a", d(2021, 1, 1), "new"), ("a", None, "never"), ("b", None, "only"), (None, d(2022, 1, 1), "x"), ("c", d(2020, 1, 1), "t"), ("c", d(2020, 1, 1), "t")]
    df = spark.createDataFrame(rows, "id string, at timestamp, v string").withColumn("_extra", F.lit(1))
    assert {tuple(r) for r in keys.standing(df, "id", "at", "v").collect()} == {("a", "new"), ("b", "only"), ("c", "t")}
    assert keys.standing(df.limit(0), "id", "at", "v").count() == 0
