"""Wrapper induction: what pages of one host have in common is template, what varies is content (for problem 6).

The pages of a host are aligned, by simple tree matching, with one of them, the host's pattern.  A node of the pattern whose
text is the same on almost all pages that have it belongs to the template; other nodes are slots, and their text is content.
Each page meets the pattern alone, so a host of any size is spread over all tasks; only counts by node are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may be nested; what lies deeper belongs to the deepest one.
DEPTH = 200


class Node:
    def __init__(self, tag: str):
        self.tag, self.kids, self.text = tag, [], []


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag)
        if len(self.open) < DEPTH:
            self.open[-1].kids.append(n)
            if tag not in _VOID:
                self.open.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self.open[-1].text.append(" ".join(data.split()))


def tree(html: str | None) -> Node:
    """The elements of a text, unclosed ones closed at its end; text without any is the root's own."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    return r.root


def size(n: Node) -> int:
    return 1 + sum(map(size, n.kids))


def align(a: Node, b: Node) -> list[tuple[Node, str]]:
    """Simple tree matching of a page with a pattern: its nodes with the place of their counterpart, as a path of child numbers."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def best(x: Node, y: Node) -> tuple[int, list]:
        if x.tag != y.tag:
            return 0, []
        if (id(x), id(y)) in memo:
            return memo[id(x), id(y)]
        n, m = len(x.kids), len(y.kids)
        score = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + best(x.kids[i], y.kids[j])[0])
        pairs, i, j = [], n, m
        while i and j:
            if score[i][j] == score[i - 1][j]:
                i -= 1
            elif score[i][j] == score[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[id(x), id(y)] = 1 + score[n][m], pairs[::-1]
        return memo[id(x), id(y)]

    out: list[tuple[Node, str]] = []

    def walk(x: Node, y: Node, path: str) -> None:
        out.append((x, path))
        for i, j in best(x, y)[1]:
            walk(x.kids[i], y.kids[j], f"{path}/{j}")

    if best(a, b)[0]:
        walk(a, b, "")
    return out


def induce(pages: DataFrame, host: str, html: str, share: float = 0.8, least: int = 3) -> DataFrame:
    """``(host, pattern, constant)``: each host's pattern page and the places of its template nodes.

    A node is constant where at least ``share`` of the pages that have it, and ``least`` pages, bear the same text there.  Pages
    without a host are left out; a host of fewer pages than ``least`` has no constants.
    """
    p = pages.select(F.col(host).cast("string").alias("host"), F.coalesce(html, F.lit("")).alias("html")).where("host is not null")
    pattern = materialise(p.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("pattern")), "patterns")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, known = [], {}
            for h, t, q in zip(b["host"], b["html"], b["pattern"]):
                y = known[h] if h in known else known.setdefault(h, tree(q))
                rows += [(h, path, " ".join(x.text)) for x, path in align(tree(t), y) if x.text]
            yield pd.DataFrame(rows, columns=["host", "place", "text"])

    seen = p.join(pattern, "host").mapInPandas(texts, "host string, place string, text string")
    per = seen.groupBy("host", "place", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "place").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    fixed = per.where((F.col("top") >= least) & (F.col("top") >= share * F.col("n"))).groupBy("host").agg(F.collect_list("place").alias("constant"))  # no more than the pattern has nodes
    return pattern.join(fixed, "host", "left").select("host", "pattern", F.coalesce("constant", F.array().cast("array<string>")).alias("constant"))


def content(pages: DataFrame, key: str, host: str, html: str, wrappers: DataFrame) -> DataFrame:
    """``(key, content, slots, template)``: the text of each page outside the template of its host, and how many of its texts are either."""
    p = pages.select(F.col(key).alias("_key"), F.col(host).cast("string").alias("host"), F.coalesce(html, F.lit("")).alias("html")).join(wrappers, "host", "left")
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, q, c in zip(b["_key"], b["html"], b["pattern"], b["constant"]):
                page = tree(t)
                fixed = set(c) if c is not None else set()
                template = {id(x) for x, path in align(page, tree(q)) if path in fixed} if fixed else set()
                kept, gone, todo = [], 0, [page]
                while todo:
                    x = todo.pop()
                    if x.text and id(x) in template:
                        gone += 1
                    elif x.text:
                        kept.append(" ".join(x.text))
                    todo += reversed(x.kids)
                rows.append((k, "\n".join(kept), len(kept), gone))
            yield pd.DataFrame(rows, columns=["_key", "content", "slots", "template"])

    return p.mapInPandas(run, f"_key {kind}, content string, slots long, template long").withColumnRenamed("_key", key)
