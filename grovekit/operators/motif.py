"""Connected subgraphs of three nodes by isomorphism class, and the distance between two censuses.

Open triples are counted from each node's numbers of neighbours by kind of link, without listing pairs of neighbours;
only triangles are listed, from the end of lower degree.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# bits of a code: ab, ba, ac, ca, bc, cb
_PLACES = [(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)]


def canonical(code: int) -> int:
    """The smallest code of a triple under all orders of its nodes."""
    links = {p for i, p in enumerate(_PLACES) if code >> i & 1}
    return min(sum(1 << i for i, (x, y) in enumerate(_PLACES) if (s[x], s[y]) in links) for s in itertools.permutations(range(3)))


def _open_code(t1: str, t2: str) -> int:
    """Class of a centre a whose links to b and c are of kinds o (out), i (in) and m (both)."""
    bits = {"o": (1, 0), "i": (0, 1), "m": (1, 1)}
    (ab, ba), (ac, ca) = bits[t1], bits[t2]
    return canonical(ab | ba << 1 | ac << 2 | ca << 3)


def dyads(edges: DataFrame) -> DataFrame:
    """``(a, b, k)`` for each linked pair a < b: k is 1 for a to b, 2 for b to a, 3 for both; self-loops are dropped."""
    e = edges.where("src <> dst and src is not null and dst is not null")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("k"))


def census(edges: DataFrame) -> DataFrame:
    """``(motif, n)``: connected triples by class; the class is the smallest 6-bit code of its links."""
    d = materialise(dyads(edges), "dyads")
    spark = d.sparkSession
    flip = F.when(F.col("k") == 3, 3).otherwise(3 - F.col("k"))
    both = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), flip.alias("k")))
    kinds = both.groupBy("a").agg(*[F.count(F.when(F.col("k") == i, 1)).alias(n) for i, n in ((1, "o"), (2, "i"), (3, "m"))])
    combos = list(itertools.combinations_with_replacement("oim", 2))
    num = lambda x, y: F.expr(f"cast({x} as decimal(38,0)) * ({x} - 1) / 2" if x == y else f"cast({x} as decimal(38,0)) * {y}")
    wedges = kinds.agg(*[F.sum(num(x, y)).cast("long").alias(x + y) for x, y in combos])
    # triangles: each link points to its end of higher degree, each node joins its links
    deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    x = d.join(deg.withColumnRenamed("deg", "da"), "a").join(deg.select(F.col("a").alias("b"), F.col("deg").alias("db")), "b")
    up = F.struct("da", "a") <= F.struct("db", "b")
    o = materialise(x.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"), F.when(up, F.col("k")).otherwise(flip).alias("k")), "oriented")
    one = o.select(F.col("s"), F.col("t").alias("b"), F.col("k").alias("k1"))
    two = o.select(F.col("s"), F.col("t").alias("c"), F.col("k").alias("k2"))
    three = o.select(F.col("s").alias("b"), F.col("t").alias("c"), F.col("k").alias("k3"))
    bits = lambda c, at: F.shiftleft(F.col(c).bitwiseAND(1), at) + F.shiftleft(F.shiftright(F.col(c), 1), at + 1)
    code = bits("k1", 0) + bits("k2", 2) + bits("k3", 4)
    closed = materialise(one.join(three, "b").join(two, ["s", "c"]).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")), "triangles")
    # at most 64 rows from here on
    counts = {x + y: v or 0 for (x, y), v in zip(combos, wedges.first())}
    out: dict[int, int] = {}
    for code_, n in closed.collect():
        out[canonical(code_)] = out.get(canonical(code_), 0) + n
        links = {p for i, p in enumerate(_PLACES) if code_ >> i & 1}
        for centre in range(3):
            t = ["m" if (centre, v) in links and (v, centre) in links else "o" if (centre, v) in links else "i" for v in range(3) if v != centre]
            counts["".join(sorted(t, key="oim".index))] -= n
    for (x, y) in combos:
        c = _open_code(x, y)
        out[c] = out.get(c, 0) + counts[x + y]
    return spark.createDataFrame([(c, n) for c, n in sorted(out.items()) if n], "motif int, n long")


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(motif_dist)``: half the sum of differences between the shares of two censuses; null where one has no triples."""
    total = lambda d, c: d.agg(F.sum("n").alias(c)).withColumn("_one", F.lit(1))
    x = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "motif", "full_outer").withColumn("_one", F.lit(1))
    x = x.join(F.broadcast(total(a, "ta")), "_one").join(F.broadcast(total(b, "tb")), "_one")
    share: list[Column] = [F.coalesce(F.col(n), F.lit(0)) / F.col(t) for n, t in (("na", "ta"), ("nb", "tb"))]
    return x.agg((F.sum(F.abs(share[0] - share[1])) / 2).alias("motif_dist"))
