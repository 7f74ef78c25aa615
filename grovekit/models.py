"""Models behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class TextGenerator(Protocol):
    def generate(self, chats: Sequence[list[dict]]) -> list[str]: ...


class PairScorer(Protocol):
    def logits(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray: ...


class HashEmbedder:
    """Sums of signed hashes of a text's words and character triples."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            t = (t or "").lower()
            for part in [*t.split(), *(t[j : j + 3] for j in range(len(t) - 2))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 32 & 1 else -1
        return out


class EchoGenerator:
    """Answers with the last message, changed by ``rule``."""

    def __init__(self, rule: Callable[[str], str] = str):
        self.rule = rule

    def generate(self, chats: Sequence[list[dict]]) -> list[str]:
        return [self.rule(c[-1]["content"]) if c else "" for c in chats]


class OverlapScorer:
    """Logits from the words that two titles share."""

    def logits(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        return np.array([(0.0, 4.0 * len(set(a.lower().split()) & set(b.lower().split())) - 2.0) for a, b in pairs]).reshape(-1, 2)


def embed_titles(nodes: DataFrame, known: DataFrame | None, make: Callable[[], Embedder], batch: int = 256) -> DataFrame:
    """``(title, embed)`` of distinct titles; those that ``known(title, embed)`` holds are not embedded again."""
    todo = nodes.select("title").where("title is not null").distinct()
    if known is not None:
        todo = todo.join(known.select("title"), "title", "left_anti")

    def run(batches):
        model = make()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b["title"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"title": part, "embed": [v.tolist() for v in model.embed(part)]})

    new = todo.mapInPandas(run, "title string, embed array<float>")
    return new if known is None else known.select("title", "embed").unionByName(new)


def generate(rows: DataFrame, key: str, messages: str, out: str, make: Callable[[], TextGenerator], batch: int = 5000, stop: str | None = "\n\n") -> DataFrame:
    """``(key, out)``: the answer to each chat ``array<struct<role, content>>``, cut before the stop string."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches):
        model = make()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                chats = [[{"role": m["role"], "content": m["content"]} for m in (c if c is not None else [])] for c in part[messages]]
                got = [a.split(stop)[0] if stop else a for a in model.generate(chats)]
                yield pd.DataFrame({key: part[key], out: got})

    return rows.select(key, messages).mapInPandas(run, f"`{key}` {kind}, `{out}` string")


def two_rounds(rows: DataFrame, key: str, first: str, second: str, make: Callable[[], TextGenerator]) -> DataFrame:
    """``(key, description, hierarchy)``: the first answer becomes part of the chat that the second prompt ends."""
    one = rows.select(key, F.array(F.struct(F.lit("user").alias("role"), F.col(first).alias("content"))).alias("m1"))
    said = one.join(generate(one, key, "m1", "description", make, 2000, None), key)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = said.withColumn("m2", F.concat("m1", F.array(turn("assistant", F.col("description")), turn("user", F.lit(second)))))
    return said.select(key, "description").join(generate(chat, key, "m2", "hierarchy", make, 2000), key)


def score_pairs(pairs: DataFrame, make: Callable[[], PairScorer], batch: int = 2048) -> DataFrame:
    """``(src, dst, weight)``: the probability of a link from src to dst."""
    def run(batches):
        model = make()
        for b in batches:
            for i in range(0, len(b), batch):
                p = b.iloc[i : i + batch]
                z = model.logits(list(zip(p["src"], p["dst"])))
                yield pd.DataFrame({"src": p["src"], "dst": p["dst"], "weight": 1 / (1 + np.exp(z[:, 0] - z[:, 1]))})

    return pairs.select("src", "dst").mapInPandas(run, "src string, dst string, weight double")
