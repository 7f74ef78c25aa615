"""Results by key where a few keys hold most rows (problem 5).

Counts and histograms are merged before they are shuffled, so a hot key costs its number of bins and not its number of
rows.  Quantiles are exact: a histogram of each key's values between its known bounds is refined, bin by bin, until the
bin of each wanted rank holds one value only.  No step gathers the values of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialise

BINS = 64
#: A key's distinct values are dealt to so many groups by hash, each of which meets the key's goals.
SALTS = 64


def key_totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, lo, hi)``: rows by key, and the bounds of its non-null, non-NaN values with their number ``n_values``."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def exact_quantiles(rows: DataFrame, key: str, value: str, qs: Sequence[float], totals: DataFrame | None = None) -> DataFrame:
    """``(key, q, value)``: the smallest value that at least a share q of the key's values do not exceed.

    Null and NaN values do not count; a key without values has no row.
    """
    t = materialise(key_totals(rows, key, value) if totals is None else totals, "totals")
    data = materialise(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")), "values")
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_values"))).cast("long")
    goal = t.where("n_values > 0").select(F.col(key).alias("k"), F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "n_values", "lo", "hi").select("k", "q", rank.alias("rank"), "lo", "hi")
    goal = materialise(goal, "goal")
    data = data.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    done = None
    while True:
        got = goal.where("lo = hi").select("k", "q", F.col("lo").alias("v"))
        done = got if done is None else done.unionByName(got)
        goal = materialise(goal.where("lo < hi"), "goal")
        if not goal.limit(1).count():
            break
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).cast("int")
        hist = (
            data.join(goal.select("*", salts), ["k", "salt"]).where("v between lo and hi").withColumn("bin", bin_)
            .groupBy("k", "q", "rank", "bin").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        per = F.array_sort(F.collect_list(F.struct("bin", "c", "lo", "hi")))  # at most BINS bins
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
        walk = F.aggregate("bins", start, lambda s, b: F.when(s["lo"].isNull() & (s["before"] + b["c"] >= F.col("rank")), F.struct((s["before"] + b["c"]).alias("before"), (F.col("rank") - s["before"]).alias("rank"), b["lo"].alias("lo"), b["hi"].alias("hi"))).otherwise(F.struct((s["before"] + b["c"]).alias("before"), s["rank"].alias("rank"), s["lo"].alias("lo"), s["hi"].alias("hi"))))
        goal = materialise(hist.groupBy("k", "q", "rank").agg(per.alias("bins")).withColumn("w", walk).select("k", "q", F.col("w.rank").alias("rank"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")), "goal")
    return done.select(F.col("k").alias(key), "q", F.col("v").alias("value"))


def distinct_by_key(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``(key, name)``: distinct non-null values by key, through pairs, so that a hot key's values spread over all tasks."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.lit(1).alias("_1")).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def dominant(totals: DataFrame, key: str, share_over: int = 20) -> DataFrame:
    """Keys with more than one in ``share_over`` of all counted rows, with ``n`` and ``of``."""
    every = totals.agg(F.sum("n").alias("of")).withColumn("_one", F.lit(1))  # one row
    return totals.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").where(F.col("n") * share_over > F.col("of")).select(key, "n", "of")
