"""Hypernym patterns over tagged tokens.

A sentence is an array of ``(word, lemma, tag)``; tags come from outside, as no tagger is at hand.  Each pattern is a row of
parts: head and tail phrases, plain noun phrases, and literal tokens.  Tokens are written one after the other as
``word/lemma/TAG`` with a closing blank, so that a pattern becomes one regular expression over whole tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLASH, _BLANK = "∕", "␣"


def _token(word: str = "[^/ ]*", lemma: str = "[^/ ]*", tag: str = "[^/ ]*") -> str:
    return f"(?:{word}/{lemma}/{tag} )"


def _words(*alternatives: str) -> str:
    return _token("(?:" + "|".join(map(re.escape, alternatives)) + ")")


_NOUN = _token(tag="N[^/ ]+")
_PHRASE = f"{_NOUN}+(?:{_words('of', '--', chr(39) + 's')}{_NOUN}+)?"
_ADVERBS = _token(tag="RB[^/ ]?") + "*"
_ADJECTIVE = f"(?:{_ADVERBS}{_token(tag='(?:JJ|JJR|JJS)')})?"
_MODIFIER = f"(?:{_ADVERBS}{_token(tag='(?:JJ|JJR|JJS|VBN)')})?"
_QUOTE = _words('"', "``", "''") + "?"
_BE, _COMMA = _token(lemma="be"), _words(",")


def _span(name: str, modifier: str = _MODIFIER) -> str:
    return f"{_QUOTE}(?P<{name}>{modifier}{_PHRASE}){_QUOTE}"


_HEAD, _TAIL, _ADJ_HEAD = _span("head"), _span("tail"), _span("head", _ADJECTIVE)
_MAYBE_COMMA = f"{_COMMA}?"
_OTHER = _words("and", "or") + _words("any", "some") + "?" + _words("other")
_EXAMPLE = _words("which") + "?" + _BE + _words("a", "an") + _token(tag="JJ") + "?" + _token(lemma="(?:subgenus|example|class|group|form|type|kind)") + _words("of")
_SUCH = _words("such") + _words("as")
_INCLUDING = _words("including")
_NOT = lambda *w: f"(?!{_words(*w)}){_token()}"


def rules() -> list[tuple[str, str]]:
    """``(id, expression)`` of the 28 patterns, in order."""
    listed = lambda n: f"(?:{_PHRASE}{_COMMA}){{{n}}}"
    more = lambda n: f"(?:{_COMMA}{_PHRASE}){{{n}}}"
    out = [
        ("example of", _TAIL + _MAYBE_COMMA + _EXAMPLE + _HEAD),
        ("and other 0", _TAIL + _MAYBE_COMMA + _OTHER + _HEAD),
        ("which is called", _TAIL + _MAYBE_COMMA + _words("which") + _BE + _words("called") + _HEAD),
        ("is JJS", _TAIL + _MAYBE_COMMA + _BE + _token(tag="JJS") + _words("most") + "?" + _HEAD),
        ("special case of", _TAIL + _BE + _words("a") + _words("special") + _words("case") + _words("of") + _token(tag="DT") + "?" + _HEAD),
        ("is an X that", _TAIL + _BE + _words("a", "an") + "?" + _ADJ_HEAD + _words("that")),
        ("is a [!part]", _token(tag="DT") + _TAIL + _BE + _words("a", "an") + _NOT("member", "part", "given") + _HEAD),
        ("!features such as", _NOT("features", "properties") + _NOT("of") + _HEAD + _SUCH + _TAIL),
    ]
    out += [(f"such as {n}", _HEAD + _MAYBE_COMMA + _SUCH + listed(n) + _TAIL) for n in range(1, 7)]
    out.append(("such as &", _HEAD + _MAYBE_COMMA + _SUCH + listed("1,9") + _PHRASE + _MAYBE_COMMA + _words("and") + _TAIL))
    out += [(f"and other {n}", _TAIL + more(n) + _MAYBE_COMMA + _OTHER + _HEAD) for n in range(1, 6)]
    out.append(("like most", _words("Unlike", "Like") + _words("most", "all", "any", "other") + _HEAD + _COMMA + _token(tag="DT") + "?" + _TAIL))
    out.append(("including 0", _HEAD + _MAYBE_COMMA + _INCLUDING + _TAIL))
    out += [(f"including {n}", _HEAD + _MAYBE_COMMA + _INCLUDING + listed(n) + _TAIL) for n in range(1, 6)]
    out.append(("including &", _HEAD + _MAYBE_COMMA + _INCLUDING + _PHRASE + more("0,10") + _MAYBE_COMMA + _words("and") + _TAIL))
    return [(name, r"(?<![^ ])" + rx) for name, rx in out]


_RULES = [(name, re.compile(rx)) for name, rx in rules()]


def match(tokens: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str, int]]:
    """``(tail, head, rule, head words)`` of every match, by rule and place; matches of one rule don't overlap."""
    clean = lambda s: (s or "").replace("/", _SLASH).replace(" ", _BLANK)
    text = "".join(f"{clean(w)}/{clean(lm)}/{clean(t)} " for w, lm, t in tokens)
    plain = lambda s: " ".join(p.split("/")[0] for p in s.split()).replace(_SLASH, "/").replace(_BLANK, " ")
    return [(plain(m["tail"]), plain(m["head"]), name, len(m["head"].split())) for name, rx in _RULES for m in rx.finditer(text)]


def pattern_matches(sentences: DataFrame, key: str, tokens: str, once_per_head_word: bool = False) -> DataFrame:
    """``(key, child, parent, rule)``; with ``once_per_head_word`` a match gives as many rows as its head has words, as where
    every token of a head is annotated and written.  Null sentences match nothing."""
    kind = sentences.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, ts in zip(b[key], b[tokens]):
                for tail, head, rule, n in match([(t["word"], t["lemma"], t["tag"]) for t in ts] if ts is not None else []):
                    rows += [(k, tail, head, rule)] * (n if once_per_head_word else 1)
            yield pd.DataFrame(rows, columns=[key, "child", "parent", "rule"])

    return sentences.select(key, F.col(tokens)).mapInPandas(run, f"`{key}` {kind}, child string, parent string, rule string")
