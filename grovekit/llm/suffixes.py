"""A sparse suffix array over the partitioned, concatenated texts of two sides, and the spans they share (problem 2).

Each task concatenates the word hashes of its texts.  Suffixes that begin at a sampled word are the array: of any
``WINDOW`` runs of ``LENGTH`` words in a row the one with the smallest hash is sampled, so texts that share a span of
``LENGTH + WINDOW - 1`` words have a sampled suffix in common.  The array is sorted by range over all tasks: first by the
leading words, then by those that follow and by those ahead, nearest first.  Next to an evaluation suffix, on either side, stand
the training suffixes with the longest common prefix; that prefix, and what the two have in common ahead of it, is a
shared span.  The ends of each range are told to all, so a run of equal suffixes may lie in any number of ranges.

How much of a text the other side holds is counted from all its runs of ``LENGTH`` words and not from the sampled ones
(:func:`shared_runs`).

Suffixes and runs that no text of the other side can share are left out beforehand, by bit tables of fixed size (``CELLS``);
these let some pass that need not, and never stop one that must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

LENGTH, WINDOW = 5, 7
#: Words behind the leading ones, and ahead of them, that a suffix is compared by; 16 bits of each word's hash.
AROUND = 8
#: Bits of a table that tells which suffixes the other side has: 4 MB.
CELLS = 1 << 25
#: Suffixes of one range.
RANGE = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CONTENT = ["key", "r1", "r2", "l1", "l2"]
_ROW = ", ".join(f"{c} long" for c in [*_CONTENT, "ref", "place", "words"])
_OUT = f"kind int, part int, {_ROW}, ref_t long, lo long, hi long"
SPAN, OPEN, EDGE = 0, 1, 2


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x81DADEF4BC2DD44D)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text begins."""
    offsets = np.asarray(lists.offsets, np.int64)
    return np.asarray(lists.values, np.int64).view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashed(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs, those across two texts too."""
    n = len(words) - LENGTH + 1
    return scramble(sum((words[i : i + n] * _MIX[i] for i in range(LENGTH)), np.zeros(n, np.uint64)))


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, at, key)`` of all runs of ``LENGTH`` words."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:n] == text[LENGTH - 1 :])
    return text[at], at, _hashed(words)[at]


def sampled(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, at, key)`` of the sampled suffixes; of texts with fewer than ``WINDOW`` runs all are."""
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _hashed(words)
    inside = text[:n] == text[LENGTH - 1 :]
    keep = (counts < LENGTH + WINDOW - 1)[text[:n]]
    m = n - WINDOW + 1
    if m > 0:
        low = g[:m].copy()
        for o in range(1, WINDOW):
            np.minimum(low, g[o : o + m], out=low)
        whole = text[:m] == text[LENGTH + WINDOW - 2 :]
        for o in range(WINDOW):
            keep[o : o + m] |= whole & (g[o : o + m] == low)
    at = np.flatnonzero(keep & inside)
    return text[at], at, g[at]


def _cells(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return key % np.uint64(CELLS), (key >> np.uint64(29)) % np.uint64(CELLS)


def _has(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = np.ones(len(key), bool)
    for c in _cells(key):
        ok &= (table[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _mark(table: np.ndarray, key: np.ndarray) -> None:
    for c in _cells(key):
        np.bitwise_or.at(table, (c >> np.uint64(6)).astype(np.int64), np.uint64(1) << (c & np.uint64(63)))


def _marks(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """Parts of the bit table, of a task's rows."""
    table = np.zeros(CELLS >> 6, np.uint64)
    for b in batches:
        _mark(table, keys(b))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], names=["cell", "bits"])


def _table(parts: DataFrame) -> np.ndarray:
    """The bit table of all tasks; at most ``CELLS / 64`` rows come to the driver, whatever the data."""
    got = parts.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(CELLS >> 6, np.uint64)
    table[got["cell"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def _packed(code: np.ndarray, at: np.ndarray, step: int, ends: np.ndarray) -> list[np.ndarray]:
    """Eight words from ``at`` on, in the direction of ``step``, as two numbers; zeros beyond the text."""
    out = []
    for half in range(2):
        x = np.zeros(len(at), np.uint64)
        for o in range(AROUND // 2):
            i = at + step * (half * AROUND // 2 + o)
            ok = i < ends if step > 0 else i >= ends
            x = x << np.uint64(16) | np.where(ok, code[np.clip(i, 0, len(code) - 1)], np.uint64(0))
        out.append(x.view(np.int64))
    return out


def _rows(told):
    """Rows ``(ref, words)`` to the sampled suffixes that the other side may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = flat(b.column(1))
            with np.errstate(over="ignore"):
                text, at, key = sampled(words, offsets)
            ok = _has(told.value, key)
            text, at, key = text[ok], at[ok], key[ok]
            code = np.maximum(words >> np.uint64(48), np.uint64(1))
            start, end = offsets[:-1][text], offsets[1:][text]
            right = _packed(code, at + LENGTH, 1, end)
            left = _packed(code, at - 1, -1, start)
            ref = np.asarray(b.column(0), np.int64)[text]
            cols = [key.view(np.int64), *right, *left, ref, at - start, end - start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*_CONTENT, "ref", "place", "words"])

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Leading words that two contexts, packed in two numbers each, have in common."""
    first, second = (sum(((x ^ y).view(np.uint64) >> np.uint64(s) == 0).astype(np.int64) for s in (48, 32, 16, 0)) for x, y in zip(a, b))
    return np.where(first == AROUND // 2, first + second, first)


def _span(e: list[np.ndarray], t: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ok, lo, hi)``: where in the evaluation text the span lies that its suffix shares with a training one; both ``[*content, ref, place, words]``."""
    ok = e[0] == t[0]
    lo = e[6] - np.minimum(_common(e[3:5], t[3:5]), e[6])
    return ok, lo, np.minimum(e[6] + LENGTH + _common(e[1:3], t[1:3]), e[7])


def _batch(kind: int, part: int, rows: list[np.ndarray], ref_t=None, lo=None, hi=None) -> pa.RecordBatch:
    n = len(rows[0])
    none = pa.nulls(n, pa.int64())
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), *[pa.array(c) for c in rows], *[none if c is None else pa.array(c) for c in (ref_t, lo, hi)]]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "part", *_CONTENT, "ref", "place", "words", "ref_t", "lo", "hi"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted array ``(*content, ref, place, words, mine)``: spans of evaluation suffixes with the training suffixes next to
    them; those with none on one side as open rows; and the first and last training suffix of the range as its edges."""
    part = TaskContext.get().partitionId()
    got = [[np.asarray(c, np.int64) for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return
    *rows, mine = (np.concatenate(x) for x in zip(*got))
    i = np.arange(len(mine))
    up = np.maximum.accumulate(np.where(mine == 1, i, -1))
    down = np.minimum.accumulate(np.where(mine == 1, i, len(i))[::-1])[::-1]
    trains = np.flatnonzero(mine == 1)
    if len(trains):
        yield _batch(EDGE, part, [c[trains[[0, -1]]] for c in rows])
    for near in (up, down):
        at = np.flatnonzero((mine == 2) & (near >= 0) & (near < len(i)))
        e, t = [c[at] for c in rows], [c[near[at]] for c in rows]
        ok, lo, hi = _span(e, t)
        yield _batch(SPAN, part, [c[ok] for c in e], t[5][ok], lo[ok], hi[ok])
    open_ = np.flatnonzero((mine == 2) & ((up < 0) | (down >= len(i))))
    yield _batch(OPEN, part, [c[open_] for c in rows])


def _close(edges: list[tuple]):
    """Open rows to their spans with the edges of the ranges ahead and behind."""
    parts = np.array([e[0] for e in edges], np.int64)
    table = [np.array([e[1 + k] for e in edges], np.int64) for k in range(8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, *rows = (np.asarray(c, np.int64) for c in b.columns)
            for near in (np.searchsorted(parts, part) - 1, np.searchsorted(parts, part, "right")):
                at = np.flatnonzero((near >= 0) & (near < len(parts)))
                e, t = [c[at] for c in rows], [c[near[at]] for c in table]
                ok, lo, hi = _span(e, t)
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (e[5], e[7], t[5], lo, hi)], names=["ref_e", "words", "ref_t", "lo", "hi"])

    return run


def spans(texts: DataFrame) -> DataFrame:
    """``(ref_e, words, ref_t, lo, hi)``: spans of words ``[lo, hi)`` of each evaluation text that a training text holds too.

    ``texts`` has ``(ref, side, w)``: side 1 training, 2 evaluation, 3 both (taken as training: it is a copy as a whole), w the
    array of word hashes.  Every word in a shared span of ``LENGTH + WINDOW - 1`` words lies beside a sampled suffix; a span is
    given up to ``AROUND`` words to either side of the leading words, with at most two training texts for each suffix.
    Empty texts and tables give no rows.
    """
    spark = texts.sparkSession
    train, held = texts.where("side in (1, 3)").select("ref", "w"), texts.where("side = 2").select("ref", "w")

    def keys_of_texts(b: pa.RecordBatch) -> np.ndarray:
        with np.errstate(over="ignore"):
            return sampled(*flat(b.column(0)))[2]

    table = spark.sparkContext.broadcast(_table(held.select("w").mapInArrow(lambda b: _marks(b, keys_of_texts), "cell long, bits long")))
    t = materialise(train.mapInArrow(_rows(table), _ROW), "suffixes")
    back = spark.sparkContext.broadcast(_table(t.select("key").mapInArrow(lambda b: _marks(b, lambda x: np.asarray(x.column(0), np.int64).view(np.uint64)), "cell long, bits long")))
    e = held.mapInArrow(_rows(back), _ROW)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // RANGE))
    order = [*_CONTENT, "mine", "ref", "place"]
    array = t.withColumn("mine", F.lit(1).cast("long")).unionByName(e.withColumn("mine", F.lit(2).cast("long")))
    out = materialise(array.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _OUT), "neighbours")
    edges = out.where(F.col("kind") == EDGE).select("part", *_CONTENT, "ref", "place", "words").orderBy("part", *_CONTENT, "ref", "place").collect()  # at most two for each range
    closed = out.where(F.col("kind") == SPAN).select(F.col("ref").alias("ref_e"), "words", "ref_t", "lo", "hi")
    late = out.where(F.col("kind") == OPEN).select("part", *_CONTENT, "ref", "place", "words").mapInArrow(_close([tuple(x) for x in edges]), "ref_e long, words long, ref_t long, lo long, hi long")
    return closed.unionByName(late)


def shared_runs(texts: DataFrame) -> DataFrame:
    """``(ref_e, words, lo, hi)``: every run of ``LENGTH`` words ``[lo, hi)`` of each evaluation text that a training text holds too.

    ``texts`` as for :func:`spans`.  A shared span of any length from ``LENGTH`` on is the union of its runs; runs are told by
    64 bits of hash.
    """
    spark = texts.sparkSession
    train, held = texts.where("side in (1, 3)").select("w"), texts.where("side = 2").select("w", "ref")

    def keys_of_texts(b: pa.RecordBatch) -> np.ndarray:
        with np.errstate(over="ignore"):
            return runs(*flat(b.column(0)))[2]

    table = spark.sparkContext.broadcast(_table(held.mapInArrow(lambda b: _marks(b, keys_of_texts), "cell long, bits long")))

    def of_train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = keys_of_texts(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[_has(table.value, key)]).view(np.int64))], names=["key"])

    t = materialise(train.mapInArrow(of_train, "key long"), "runs")
    back = spark.sparkContext.broadcast(_table(t.mapInArrow(lambda b: _marks(b, lambda x: np.asarray(x.column(0), np.int64).view(np.uint64)), "cell long, bits long")))

    def of_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = flat(b.column(0))
            with np.errstate(over="ignore"):
                text, at, key = runs(words, offsets)
            ok = _has(back.value, key)
            text, at, key = text[ok], at[ok], key[ok]
            lo = at - offsets[:-1][text]
            cols = [key.view(np.int64), np.asarray(b.column(1), np.int64)[text], np.diff(offsets)[text], lo, lo + LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "ref_e", "words", "lo", "hi"])

    e = held.mapInArrow(of_held, "key long, ref_e long, words long, lo long, hi long")
    return e.join(t, "key", "left_semi").drop("key")


def covered(spans_: DataFrame, *by: str) -> DataFrame:
    """``(*by, words, covered)``: words of a text that lie in its spans; a text has no more spans than twice its words."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], s["end"]))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end"))
    got = spans_.groupBy(*by, "words").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    return got.select(*by, "words", F.aggregate("s", start, step)["n"].alias("covered"))
