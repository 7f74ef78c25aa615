"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Method: the vocabulary is written as a sentencepiece BPE model: each piece is a token's bytes, mapped to printable
characters, scored by the negative of its rank, with identity normalisation.  Texts are cut by the public pre-tokenizer
pattern, each distinct pre-token is encoded once per task, and ids are strung together.  Decoding inverts the mapping.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on texts of ASCII characters only, for the faster library.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A task forgets its pre-tokens when it holds this many; they are then encoded anew.
CACHE = 400_000
#: Longer pre-tokens are not remembered.
CACHED_CHARS = 64


def byte_chars() -> list[str]:
    """Printable bytes stand for themselves, the others, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def vocabulary(path: str) -> list[str]:
    """Byte-mapped pieces in order of id, from a tokenizers JSON or a file of base64 tokens with ranks; special tokens left out."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        special = {x["content"] for x in j.get("added_tokens", [])}
        pieces = sorted(((i, p) for p, i in j["model"]["vocab"].items() if p not in special))
    else:
        chars = byte_chars()
        with open(path, "rb") as f:
            pieces = sorted((int(r), "".join(chars[b] for b in base64.b64decode(t))) for t, r in (x.split() for x in f if x.strip()))
    if [i for i, _ in pieces] != list(range(len(pieces))):
        raise ValueError(f"the ids of {path} have gaps")
    return [p for _, p in pieces]


def _field(n: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, a whole number or a 32-bit float."""
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, bytes):
        return varint(n << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(n << 3 | 5) + struct.pack("<f", value)
    return varint(n << 3) + varint(value)


def model_proto(pieces: Sequence[str]) -> bytes:
    """A sentencepiece model of the pieces; the unknown piece it must have comes last and is never used."""
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, p.encode()) + _field(2, float(-i)) + _field(3, normal)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>".encode()) + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    spec = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join([*out, _field(2, trainer), _field(3, spec)])


class Encoder:
    def __init__(self, pieces: Sequence[str]):
        import sentencepiece

        self.pieces = list(pieces)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(pieces))
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN).findall
        self.chars = byte_chars()
        self.of_char = {c: b for b, c in enumerate(self.chars)}
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.known: dict[str, list[int]] = {}

    def learn(self, tokens: Sequence[str]) -> list[list[int]]:
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in tokens]
        return self.sp.encode(mapped, num_threads=1)

    def cut_text(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.cut_ascii(text) if text.isascii() else self.cut(text)

    def encode_flat(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has: none for null and empty texts."""
        known = self.known
        cut = [self.cut_text(t) for t in texts]
        new = [t for t in set(itertools.chain.from_iterable(cut)) if t not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(itertools.chain.from_iterable(cut)))
            known.update(zip(new, self.learn(new)))
        ids = [[known[t] for t in tokens] for tokens in cut]
        counts = np.fromiter((sum(map(len, x)) for x in ids), dtype=np.int64, count=len(ids))
        chain = itertools.chain.from_iterable
        flat = np.fromiter(chain(chain(ids)), dtype=np.int32, count=int(counts.sum()))
        for t in new:
            if len(t) > CACHED_CHARS:
                del known[t]
        return flat, counts

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []

    def decode(self, ids: Sequence[int]) -> str:
        return bytes(self.of_char[c] for i in ids for c in self.pieces[i]).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(vocabulary(path))


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row; null and empty texts get an empty list.

    The vocabulary file must be readable at ``vocabulary_path`` on every executor.  Other columns are ignored; rows with a
    null or repeated key keep their rows.  Strings of special tokens are ordinary text.
    """
    kind = docs.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                flat, counts = enc.encode_flat(b.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), True))])
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, key: str, ids: str, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, text)``, the inverse of :func:`encode_corpus`; null texts come back empty."""
    kind = encoded.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    from pyspark.sql import types as T

    return encoded.select(key, ids).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())]))
