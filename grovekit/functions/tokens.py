"""Token sequences with masks for weighted training."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(ids: Sequence[int], mark: Sequence[int]) -> int:
    """Where the tokens behind the first ``mark`` begin; -1 without one."""
    ids, mark = list(ids), list(mark)
    for i in range(len(ids) - len(mark) + 1):
        if ids[i : i + len(mark)] == mark:
            return i + len(mark)
    return -1


def masks(ids: Sequence[int], mark: Sequence[int], arrow: int, newline: int, eos: int, decode: Callable[[list[int]], str], weights: dict[tuple[str, str], float], draw: Callable[[int], float]) -> tuple[list[bool], list[bool]] | None:
    """``(ignores, ignores_detailed)`` of one sequence, or null where it has no response or a step is unknown.

    All up to the mark is ignored.  In the detailed mask the tokens of a title behind an arrow are ignored together where
    ``draw(position)`` exceeds the weight of the step that leads to it; first titles, arrows, line breaks and the end never.
    """
    start = after(ids, mark)
    if start < 0:
        return None
    detailed = [True] * start
    word: list[int] = []
    before: str | None = None
    for at in range(start, len(ids)):
        token = ids[at]
        if token in (arrow, newline):
            title = decode(word)
            hidden = False
            if before is not None:
                if (before, title) not in weights:
                    return None
                hidden = draw(at) > weights[before, title]
            detailed += [hidden] * len(word) + [False]
            word, before = [], title if token == arrow else None
        elif token == eos:
            if word:
                return None
            detailed.append(False)
        else:
            word.append(token)
    return ([True] * start + [False] * (len(ids) - start), detailed) if len(detailed) == len(ids) else None


def padded_length(longest: int, multiple: int = 8, most: int = 2**31 - 1) -> int:
    """A batch's common length: always another block, also where the longest fits exactly; at most ``most``."""
    return min((longest // multiple + 1) * multiple, most)


def pad(ids: Column, mask: Column, length: Column, pad_id: int) -> tuple[Column, Column, Column]:
    """``(ids, mask, labels)`` of one common length; labels are -100 where the mask is set."""
    n = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    i = F.concat(ids, F.array_repeat(F.lit(pad_id), n))
    m = F.concat(mask, F.array_repeat(F.lit(True), n))
    return i, m, F.zip_with(i, m, lambda a, b: F.when(b, F.lit(-100)).otherwise(a))


def with_reject(df: DataFrame, ids: str, most: int) -> DataFrame:
    """``df`` with ``reject``: why a sequence can't be used (``no tokens`` for null, ``too long`` beyond ``most``), or null."""
    return df.withColumn("reject", F.when(F.col(ids).isNull(), "no tokens").when(F.size(ids) > most, "too long"))


def mask_tokens(df: DataFrame, key: str, ids: str, mark: Sequence[int], arrow: int, newline: int, eos: int, words: dict[int, str], weights: dict[tuple[str, str], float], seed: int = 0) -> DataFrame:
    """``(key, ids, ignores, ignores_detailed)``; sequences without masks are left out.

    Draws depend on seed, key and position only, so that a repeated run hides the same titles.  ``words`` and ``weights``
    describe a vocabulary and a taxonomy and are sent to the executors.
    """
    import xxhash

    def run(batches):
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[ids]):
                x = [int(i) for i in x] if x is not None else []
                got = masks(x, mark, arrow, newline, eos, lambda w: "".join(words.get(i, "") for i in w).strip(), weights, lambda at: xxhash.xxh64_intdigest(f"{k}\0{at}", seed) / 2**64)
                if got:
                    rows.append((k, x, *got))
            yield pd.DataFrame(rows, columns=[key, ids, "ignores", "ignores_detailed"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, ids).mapInPandas(run, f"`{key}` {kind}, `{ids}` array<int>, ignores array<boolean>, ignores_detailed array<boolean>")
