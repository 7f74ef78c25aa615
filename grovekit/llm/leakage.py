"""Evaluation passages inside a corpus (problem 9).

Method: the word n-grams of the evaluation items are a broadcast set; each task slides over the words of its documents,
looks windows up, and checks hits against the items' own words.  A document's window can only be an item's if all its
words are some item's, so words are first mapped to the items' vocabulary and only unbroken runs of it are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items that are broadcast at once (about 150 bytes each); more items are scanned for in several passes.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower case."""
    if not text:
        return []
    return "\n".join(_WORD.findall(text)).lower().split("\n") if not text.isascii() else _WORD.findall(text.lower())


class Passages:
    """The items of one block: vocabulary, item texts as numbers, and where each n-gram begins."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        self.grams: dict[int, list[tuple[int, int]]] = {}
        for item, text in items:
            w = words_of(text)
            if len(w) < n:
                continue
            a = np.fromiter((self.number.setdefault(x, len(self.number) + 1) for x in w), np.int32, len(w))
            self.items[item] = a
            for i in range(len(a) - n + 1):
                self.grams.setdefault(hash(a[i : i + n].tobytes()), []).append((item, i))

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item, first word, words)`` of each longest stretch of at least n consecutive words that ``text`` and an item share."""
        n, get = self.n, self.number.get
        w = words_of(text)
        if len(w) < n:
            return []
        a = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
        stops = np.concatenate([[-1], np.flatnonzero(a == 0), [len(a)]])
        out = []
        for k in np.flatnonzero(np.diff(stops) > n):
            lo, hi = int(stops[k]) + 1, int(stops[k + 1])
            reach: dict[tuple[int, int], int] = {}  # (item, place in item minus place in text) -> end of the last stretch
            for i in range(lo, hi - n + 1):
                for item, j in self.grams.get(hash(a[i : i + n].tobytes()), ()):
                    b = self.items[item]
                    if reach.get((item, j - i), -1) > i or not np.array_equal(a[i : i + n], b[j : j + n]):
                        continue
                    m = min(hi - i, len(b) - j)
                    differ = np.flatnonzero(a[i : i + m] != b[j : j + m])
                    m = int(differ[0]) if len(differ) else m
                    reach[item, j - i] = i + m
                    out.append((item, i, m))
        return out


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 15, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(key, item, first_word, n_words)``: one row for each stretch of at least n words that a document shares with an item.

    Documents and items with null or shorter texts leak nothing; rows with a null item key are left out.  Keys must be
    whole numbers.  Repeated documents give their rows again.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null")
    total = items.agg(F.sum(F.length("t") / 2)).first()[0] or 0  # no text has more words
    blocks = max(1, -(-int(total) // block_words))
    out = None
    for block in range(blocks):
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value, n)
            for b in batches:
                rows = [(k, *hit) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in passages.find(t)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=[key, "item", "first_word", "n_words"])

        got = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_t")).where("length(_t) > 0").mapInArrow(run, f"`{key}` long, item long, first_word int, n_words int")
        out = got if out is None else out.unionByName(got)
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``(first word, words)`` spans and what stands between them; the rest is unchanged."""
    if text is None or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for first, n in sorted(spans):
        lo, hi = at[first][0], at[first + n - 1][1]
        if hi > last:
            out.append(text[last : max(lo, last)])
            last = hi
    return "".join(out) + text[last:]


def without_leaks(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``(key, text)`` of every document, leaked stretches removed; keys must be unique."""
    spans = found.groupBy(key).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_s"))  # bounded by one text's words
    whole = docs.select(key, text).join(spans, key, "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], text: [remove_spans(t, [(s["first_word"], s["n_words"]) for s in x]) for t, x in zip(b[text], b["_s"])]})

    schema = whole.select(key, text).schema
    return whole.where(F.col("_s").isNull()).select(key, text).unionByName(whole.where(F.col("_s").isNotNull()).mapInPandas(cut, schema))
