"""Records of evaluation splits that also stand, exactly or almost, in the training split (problem 2).

Method: the sparse suffix array of :mod:`.suffixes`.  Adjacent suffixes of the two splits give shared spans, and records that
one training record covers by half are proposed as pairs.  How much of each record the training split covers is counted
from all runs of words that the two share, and not from the array's sampled suffixes.  Words in common may stand in any order, so spans alone can't find all pairs; an exact prefix filter proposes
the rest: the words of a text, counted with repetition, are tokens (word, how manieth), put into one order for all texts,
rare words first.  Texts of n and m words with four fifths of the longer's in common have their first common token among
the first ``n // 5 + 1`` of one and the first ``m // 5 + 1`` of the other, so every pair meets under one of these as a
key, whatever its lengths and the order of its words.  Pairs that meet are sifted by a bound that none can miss: each of
the tokens not in common changes one bit of a text's ``BITS`` parity bits at most.  All pairs proposed are compared word
by word.

Exact copies are one text with members, so copies of one text cost one text.  A key with very many pairs is dealt in
blocks to many tasks; none of its pairs is left out.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import keys as K
from ..session import materialise
from . import suffixes
from .suffixes import flat, scramble

#: A key's texts of either side are dealt in blocks, such that no two blocks have more pairs than this.
HOT_PAIRS = 100_000_000
#: Parity bits of a text.
BITS = 256
_BITS = [f"b{k}" for k in range(BITS // 64)]
#: Words are ordered by their number in all texts, counted in this many cells by hash; results don't depend on it.
CELLS = 1 << 20
#: Pairs sifted at once.
AT_ONCE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts to compare are told to all tasks if they are no more than this (16 bytes each); more are joined.
TOLD = 500_000
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by cell, of a task's rows ``(words)``."""
    n = np.zeros(CELLS, np.int64)
    for b in batches:
        n += np.bincount((flat(b.column(0))[0] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])


def _tokens(words: np.ndarray, offsets: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(record, token, place)`` of all words, each record's in the common order."""
    counts = np.diff(offsets)
    record = np.repeat(np.arange(len(counts)), counts)
    w = words[np.lexsort((words, often[(words % np.uint64(CELLS)).astype(np.int64)], record))]
    i = np.arange(len(w))
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (record[1:] != record[:-1])
    again = i - np.maximum.accumulate(np.where(new, i, 0))
    return record, scramble(w + again.astype(np.uint64) * MIX), i - offsets[record]


def _filing(often: np.ndarray):
    """Rows ``(ref, side, words)`` to ``(key, ref, meta, b0, ...)``: first tokens of each record; meta packs words and side, b0 and on are its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, offsets = flat(b.column(2))
            counts = np.diff(offsets)
            with np.errstate(over="ignore"):
                rec, tok, place = _tokens(words, offsets, often)
            bit = np.uint64(1) << (tok >> np.uint64(58))
            part = (tok >> np.uint64(32)) % np.uint64(BITS // 64)
            bits = [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), offsets[:-1]).view(np.int64) for k in range(BITS // 64)]
            at = np.flatnonzero(place <= counts[rec] // 5)
            rec = rec[at]
            meta = counts << 2 | np.asarray(b.column(1), np.int64)
            ref = np.asarray(b.column(0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tok[at].view(np.int64), ref[rec], meta[rec], *(x[rec] for x in bits))], names=["key", "ref", "meta", *_BITS])

    return run


def _often_filed(often: np.ndarray, block: int):
    """Rows ``(side, words)`` to ``(key, side)``: of the keys that :func:`_filing` gives, those of words that stand more than ``block`` times in all texts.

    No other key can have more than ``block`` texts.  As rare words come first, texts with enough of them to be filed under need no sorting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, offsets = flat(b.column(1))
            counts = np.diff(offsets)
            rare = np.add.reduceat((often[(words % np.uint64(CELLS)).astype(np.int64)] <= block).astype(np.int64), offsets[:-1])
            some = rare <= counts // 5
            words, rare, side = words[np.repeat(some, counts)], rare[some], np.asarray(b.column(0), np.int64)[some]
            counts = counts[some]
            if not len(counts):
                continue
            with np.errstate(over="ignore"):
                rec, tok, place = _tokens(words, np.concatenate([[0], np.cumsum(counts)]), often)
            at = np.flatnonzero((place >= rare[rec]) & (place <= counts[rec] // 5))
            yield pa.RecordBatch.from_arrays([pa.array(tok[at].view(np.int64)), pa.array(side[rec[at]])], names=["key", "side"])

    return run


def _sift(t: list[np.ndarray], e: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one key's training and evaluation rows ``(ref, words, b0, ...)`` that may have four fifths in common."""
    t, e = ([c[o] for c in x] for x in (t, e) for o in [np.argsort(x[1], kind="stable")])
    at = 0
    while at < len(t[0]):
        step = max(1, AT_ONCE // len(e[0]))
        if step > 64 and len(t[0]) * len(e[0]) > AT_ONCE:
            step = 64
        ref, n, *bits = (c[at : at + step] for c in t)
        at += step
        lo, hi = np.searchsorted(e[1], -(-n[0] * 4 // 5)), np.searchsorted(e[1], n[-1] * 5 // 4, "right")
        ref_e, m, *bits_e = (c[lo:hi] for c in e)
        apart = sum(np.bitwise_count(x[:, None] ^ y) for x, y in zip(bits, bits_e))  # 256 becomes 0, which is compared in full
        i, j = np.nonzero(apart <= np.minimum(m * 2 // 5, 255).astype(np.uint8))  # at most two fifths of the shorter
        longer = np.maximum(n[i], m[j])
        ok = (apart[i, j] <= n[i] + m[j] - 2 * ((4 * longer + 4) // 5)) & (np.minimum(n[i], m[j]) * 5 >= longer * 4) & (ref[i] != ref_e[j])
        yield ref[i[ok]], ref_e[j[ok]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, block_t, block_e, mine, ref, meta, b0, ...)`` sorted by the first three to ``(ref_t, ref_e)``; mine is the side a row is here for."""
    rest = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            cols = [np.asarray(b.column(i), np.int64) for i in range(b.num_columns)]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
        else:
            cols = rest
        if cols is None or not len(cols[0]):
            continue
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        ends = [*new.tolist(), len(cols[0])] if b is None else new.tolist()
        starts = [0, *ends]
        rest = [c[starts[len(ends)] :] for c in cols]
        _, _, _, mine, ref, meta, *bits = cols
        of = [ref, meta >> 2, *(x.view(np.uint64) for x in bits)]
        out_t, out_e = [], []
        is_t = mine == 1
        below = np.concatenate([[0], np.cumsum(is_t)])
        first, last = np.array(starts[: len(ends)], np.int64), np.array(ends, np.int64)
        mine_t = below[last] - below[first]
        both = (mine_t > 0) & (mine_t < last - first)
        for s, e in zip(first[both].tolist(), last[both].tolist()):
            a, z = s + np.flatnonzero(is_t[s:e]), s + np.flatnonzero(~is_t[s:e])
            for x, y in _sift([c[a] for c in of], [c[z] for c in of]):
                out_t.append(x)
                out_e.append(y)
        if out_t:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t)), pa.array(np.concatenate(out_e))], names=["ref_t", "ref_e"])


def _near(reps: DataFrame) -> DataFrame:
    """``(ref_t, ref_e)``: all pairs of texts ``(ref, class, side, w)``, w their word hashes, with four fifths of their words in common, and a few others."""
    spark = reps.sparkSession
    got = reps.select("w").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[got["cell"].to_numpy()] = got["n"].to_numpy()
    told = spark.sparkContext.broadcast(often)
    filed = reps.select("ref", "side", "w").mapInArrow(lambda b: _filing(told.value)(b), "key long, ref long, meta long, " + ", ".join(f"{c} long" for c in _BITS))
    side = F.col("meta").bitwiseAND(3)
    here = F.explode(F.when(side == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(side.cast("int"))))
    block = max(1, math.isqrt(HOT_PAIRS))
    number = lambda k: F.count(F.when(F.col("side").bitwiseAND(k) > 0, 1))
    hot = reps.select("side", "w").mapInArrow(lambda b: _often_filed(told.value, block)(b), "key long, side long").groupBy("key").agg(number(1).alias("nt"), number(2).alias("ne")).where(f"nt > 0 and ne > 0 and (nt > {block} or ne > {block})")
    hot = materialise(hot.select("key", F.ceil(F.col("nt") / block).cast("int").alias("bt"), F.ceil(F.col("ne") / block).cast("int").alias("be")), "hot")
    rows = filed.join(F.broadcast(hot), "key", "left").select("*", here.alias("mine"))
    # a row stands in its own block, once for each block of the other side
    own = lambda n: F.pmod(F.xxhash64("ref"), F.coalesce(n, F.lit(1))).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    is_t = F.col("mine") == 1
    rows = rows.withColumn("block_t", F.explode(F.when(is_t, F.array(own(F.col("bt")))).otherwise(all_(F.col("bt")))))
    rows = rows.withColumn("block_e", F.explode(F.when(is_t, all_(F.col("be"))).otherwise(F.array(own(F.col("be"))))))
    by = ["key", "block_t", "block_e"]
    rows = rows.select(*by, "mine", "ref", "meta", *_BITS).repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(_meet, "ref_t long, ref_e long").distinct()


def share_of_words(a: list[str], b: list[str]) -> float:
    """Words in common, counted with repetition, relative to the longer list; 0 where one is empty."""
    if not a or not b:
        return 0.0
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = [t.split(" ") for t in b["norm_t"]]
        y = [t.split(" ") for t in b["norm_e"]]
        b["common"] = [sum((Counter(p) & Counter(q)).values()) for p, q in zip(x, y)]
        b["longer"] = [max(len(p), len(q)) for p, q in zip(x, y)]
        ok = b["common"] * 5 >= b["longer"] * 4
        yield b.loc[ok, ["class_t", "class_e", "common", "longer"]]


class Overlaps(NamedTuple):
    """pairs (class_t, class_e, common, longer), members (class, id, side, split, ...), texts (ref, class, side, norm, w)."""

    pairs: DataFrame
    members: DataFrame
    texts: DataFrame

    @property
    def coverage(self) -> DataFrame:
        """``(class, words, covered)``: words of each evaluation text that shares any, and those that lie in shared runs; made anew at each call."""
        n = F.size("w").cast("long")
        got = suffixes.covered(suffixes.shared_runs(self.texts), "ref_e")
        got = got.join(self.texts.where("side = 2").select(F.col("ref").alias("ref_e"), "class"), "ref_e").select("class", "words", "covered")
        return got.unionByName(self.texts.where("side = 3").select("class", n.alias("words"), n.alias("covered")))


def overlaps(samples: DataFrame, key: str = "id", split: str = "split", texts: tuple[str, ...] = ("title", "abstract"), at: str | None = None, keep: tuple[str, ...] = ()) -> Overlaps:
    """Pairs of texts of training and evaluation samples with at least four fifths of their words in common; members of every
    text with both sides' samples; and the texts, of which the words are counted that lie in runs shared with the training split.

    Splits are trimmed and in lower case: ``train`` against ``eval`` and ``test``.  Samples with another or no split, a null
    or blank text or a text without words are left out; a text that both sides hold is a pair with itself, and covered as a
    whole.  With ``at``, only the standing row of each key counts.
    """
    blank = F.lit(False)
    for t in texts:
        blank = blank | K.is_blank(F.col(t))
    sp = F.trim(F.lower(F.regexp_replace(split, K.SPACE, " ")))
    norm = F.when(~blank, F.array_join(K.words(F.concat_ws(" ", *texts)), " "))
    base = samples.select(F.col(key).cast("string").alias("id"), *([F.col(at).alias("_at")] if at else []), sp.alias("split"), norm.alias("norm"), *keep)
    base = base.withColumn("ref", F.xxhash64("norm")).withColumn("more", F.hash("norm"))
    rows = base.withColumn("has", F.col("split").isin("train", "eval", "test") & (F.coalesce("norm", F.lit("")) != "")).drop("norm")
    if at:  # texts stay where they are: which row stands is told by times and hashes alone
        rows = K.standing(rows, "id", "_at", "split", "ref", "more", "has", *keep)
    rows = rows.where("has").withColumn("side", F.when(F.col("split") == "train", 1).otherwise(2).cast("long"))
    rows = materialise(rows.select("id", F.struct("ref", "more").alias("class"), "side", "split", *keep), "samples")
    members = rows
    first = rows.groupBy("class").agg(F.bit_or("side").alias("side"), F.min("id").alias("id"))
    # each text is moved once, to one row of those that bear it; repeated rows of that record fall together there.  There is
    # no filter on the text itself, which would make it twice: rows without one have no class among the members
    reps = base.where("split in ('train', 'eval', 'test')").select("id", F.struct("ref", "more").alias("class"), "norm").join(first, ["id", "class"])
    hashes = F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))
    reps = reps.dropDuplicates(["id", "class"]).select(F.monotonically_increasing_id().alias("ref"), "class", "side", "norm", hashes.alias("w"))
    reps = materialise(reps, "texts")
    proposed = suffixes.covered(suffixes.spans(reps), "ref_t", "ref_e").where("covered * 2 >= words").select("ref_t", "ref_e")
    near = materialise(_near(reps).union(proposed).distinct(), "near")
    refs = near.select(F.col("ref_t").alias("ref")).union(near.select("ref_e")).distinct()
    refs = materialise(refs, "refs")
    texts = reps.join(F.broadcast(refs) if refs.count() <= TOLD else refs, "ref", "left_semi")
    a = texts.select(F.col("ref").alias("ref_t"), F.col("class").alias("class_t"), F.col("norm").alias("norm_t"))
    b = texts.select(F.col("ref").alias("ref_e"), F.col("class").alias("class_e"), F.col("norm").alias("norm_e"))
    cls = "struct<ref:bigint,more:int>"
    checked = near.join(a, "ref_t").join(b, "ref_e").select("class_t", "class_e", "norm_t", "norm_e").mapInPandas(_compare, f"class_t {cls}, class_e {cls}, common int, longer int")
    n = F.size(F.split("norm", " "))
    both = reps.where("side = 3")
    same = both.select(F.col("class").alias("class_t"), F.col("class").alias("class_e"), n.alias("common"), n.alias("longer"))
    return Overlaps(materialise(checked.unionByName(same), "pairs"), members, reps)


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id_t, id_e, split, common, longer, covered)``: every pair of a training and an evaluation sample."""
    t = members.where("side = 1").select(F.col("class").alias("class_t"), F.col("id").alias("id_t"))
    e = members.where("side = 2").select(F.col("class").alias("class_e"), F.col("id").alias("id_e"), *[c for c in members.columns if c not in ("class", "id", "side")])
    return pairs.join(t, "class_t").join(e, "class_e").drop("class_t", "class_e")


def report(found: Overlaps, by: tuple[str, ...] = ("split", "source")) -> DataFrame:
    """Evaluation samples by ``by``: all, with a copy in training, and with an exact one, and the mean share of their words in spans
    that the training split holds too; copies are not expanded into pairs."""
    e = found.members.where("side = 2")
    hit = found.pairs.groupBy(F.col("class_e").alias("class")).agg(F.max(F.col("class_t") == F.col("class_e")).alias("exact"))
    share = found.coverage.select("class", (F.col("covered") / F.col("words")).alias("share"))
    return e.join(hit, "class", "left").join(share, "class", "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.count("exact").alias("overlapping"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.round(F.avg(F.coalesce("share", F.lit(0.0))), 6).alias("coverage"))
