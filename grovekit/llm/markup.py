"""Clean text from documents with HTML, Markdown, wiki and LaTeX residue (problem 6).

The method listed, wrapper induction over pages of one host, can't decide this: records are single fields without pages
or hosts, and no two share a template.  Instead a field is read by one tolerant grammar of the four notations.  Each piece
of markup is taken as a node, what it encloses is read in turn, and the nodes are written again in one plain form:
``# heading``, ``- item``, ``1. item``, fenced code, ``$formula$``, ``> quote`` and ``a | b`` rows; all else is text.

A sign is markup only in a form that its notation gives a meaning: comparisons, prices, intervals, references in square
brackets, names with underscores or sharps, single ampersands and the like are none.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements of HTML and of the article tag set that publishers use.
ELEMENTS = (
    "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math "
    "meta nav noscript object ol option p param pre q ref references s samp script section select small span strike strong style sub summary sup svg "
    "table tbody td textarea tfoot th thead time title tr tt u ul var video wbr nowiki gallery bold italic sec xref ext-link inline-formula "
    "disp-formula list list-item abstract mml tex-math alternatives fig graphic label source onlyinclude includeonly noinclude poem syntaxhighlight"
).split()
# LaTeX environments that hold formulas, and those that hold code.
FORMULA_ENVIRONMENTS = "equation align eqnarray gather multline displaymath math array matrix pmatrix bmatrix cases split aligned".split()
CODE_ENVIRONMENTS = "verbatim lstlisting minted alltt".split()
# LaTeX commands whose argument is no text of the document.
SILENT_COMMANDS = "cite citep citet ref eqref label pageref autoref nocite index bibliography bibliographystyle includegraphics vspace hspace usepackage documentclass".split()
# Combining signs of LaTeX accents.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
_HEADS = re.compile(r"h[1-6]|title")

_ENV = "|".join(FORMULA_ENVIRONMENTS)
_CODE = "|".join(CODE_ENVIRONMENTS)
_ARGS = r"(?:\[[^\[\]\n]*\])?\{(?:[^{}]|\{[^{}]*\})*\}"
_PARTS = [
    ("comment", r"<!--[\s\S]*?-->|<!--|<!DOCTYPE[^>]*>|<!\[CDATA\[[\s\S]*?\]\]>|<\?xml[^>]*\?>"),
    ("code", r"```[^\n`]*\n[\s\S]*?(?:\n[ \t]*```|\Z)|<pre\b[^<>]*>[\s\S]*?</pre\s*>|<(?:code|tt|source|syntaxhighlight)\b[^<>]*>[\s\S]*?</(?:code|tt|source|syntaxhighlight)\s*>|\\begin\{(?:" + _CODE + r")\}[\s\S]*?\\end\{(?:" + _CODE + r")\}|```|(?<![`\\])`[^`\n]+`(?!['`])"),
    ("formula", r"\\begin\{(?P<env>" + _ENV + r")\*?\}[\s\S]*?\\end\{(?P=env)\*?\}|\$\$[^$]+\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|<math\b[^<>]*>[\s\S]*?</math\s*>|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$])\$(?![\d$])"),
    ("template", r"\{\{(?:[^{}]|\{\{[^{}]*\}\}|\{(?!\{)|\}(?!\}))*\}\}|\{\{(?=\w)|(?<=\w)\}\}"),
    ("wikitable", r"\{\|[\s\S]*?\n[ \t]*\|\}|\{\|[^\n]*|^[ \t]*\|[}\-+][^\n|]*$"),
    ("redirect", r"#REDIRECT\b"),
    ("wikilink", r"\[\[[^\[\]\n]+(?:\n[^\[\]\n]+)?\]\]"),
    ("mdlink", r"!?\[[^\[\]\n]*\]\((?:[A-Za-z][\w+.-]*:|/|#|\.)[^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"),
    ("extlink", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+[^\]\n]*)?\]|<(?:https?|ftp|mailto):[^\s<>]+>"),
    ("heading", r"^[ \t]*={2,6}[ \t]*[^=\n][^\n]*?[ \t]*={2,6}[ \t]*$|^[ \t]{0,3}#{1,6}[ \t]+[^\s#][^\n]*$|^[^\s|>][^\n]*\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$"),
    ("rule", r"^[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"),
    ("table", r"^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("quote", r"^[ \t]{0,3}>(?:[ \t]+(?=[^\s\d=])|[ \t]*$)"),
    ("ordered", r"^[ \t]*1[.)][ \t]+\S[^\n]*(?:\n[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*)+"),
    ("item", r"^[ \t]*(?:[*+-]|[*#:;]{2,5})[ \t]+(?=[^\s\d])|^[*#](?=\[\[|'')"),
    ("strong", r"(?<![\w*])\*{2,3}(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=[^\s*])\*{2,3}(?![\w*])|(?<![\w_])_{2,3}(?=[^\s_])[^\n]*?(?<=[^\s_])_{2,3}(?![\w_])|(?<![\w~])~~(?=\S)[^~\n]+?(?<=\S)~~(?![\w~])|(?<![\w*\\/])\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])|(?<![\w'`])'{2,5}(?=[^\s'])[^'\n]+?'{2,5}(?![\w'])"),
    ("texquote", r"``[^`\n]+?''"),
    ("accent", r"\\(?:[\"'`^~=.](?:\{\\?[A-Za-z]\}|\\?[A-Za-z])|[cvuHrk]\{[A-Za-z]\})|\\(?:ss|ae|oe|aa|o|l|i|j|AE|OE|AA|O|L)(?:\{\}|\b)"),
    ("switch", r"\{\\(?:it|bf|em|tt|sl|sc|rm|sf|large|small|cal|itshape|bfseries|scshape)\b[ \t]*(?:[^{}]|\{[^{}]*\})*\}"),
    ("command", r"~?\\[A-Za-z]+\*?(?:" + _ARGS + r")*"),
    ("escape", r"\\[%&$#_{}]|\\\\(?=[\s\[]|$)|(?<=[\w.])~(?=[\w\\])"),
    ("tag", r"</?(?:(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")|[a-z][\w.-]*:[a-z][\w.-]*)(?:\s+[^<>]*|/)?>|</?[A-Za-z][\w.:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))+\s*/?>"),
    ("entity", r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});|&(?:#\d{2,7}|#x[0-9a-f]{2,6}|" + "|".join(_LEGACY) + r")(?![\w;=])"),
]
GRAMMAR = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _PARTS), re.MULTILINE | re.IGNORECASE)
#: Where a piece of markup can begin.
START = re.compile(r"^|[<&$\\{}\[|*_~`'#!]", re.MULTILINE)
#: A field without any of these signs holds no markup and is not read further.
SIGNS = r"[<&$\\{}\[\]|*_~`'#=>]|(?m:^[ \t]*[-+:;][ \t])|(?m:^[ \t]*1[.)][ \t])|(?m:^[ \t]*(?:[-][ \t]*){3,}$)"
#: Markup nested deeper stays as it is; each level takes a few frames of the interpreter's stack.
DEPTH = 150
FAMILY = {
    "comment": "html", "tag": "html", "entity": "html", "code": "code", "formula": "math", "template": "wiki", "wikitable": "wiki", "redirect": "wiki", "wikilink": "wiki",
    "extlink": "wiki", "mdlink": "markdown", "heading": "heading", "rule": "markdown", "table": "table", "quote": "markdown", "ordered": "list", "item": "list", "strong": "markdown",
    "texquote": "latex", "accent": "latex", "switch": "latex", "command": "latex", "escape": "latex",
}
_ARG = re.compile(r"\{((?:[^{}]|\{[^{}]*\})*)\}")
_FORMULA_SIGN = re.compile(r"[\\^_{}=<>+*/|]|^[^\W\d_]$|^\(?[^\W\d_](?:[,;]? ?[^\W\d_]){0,3}\)?'?$|^-?\d+(?:\.\d+)?\s*[^\W\d_]?$")


def _is_money(inner: str) -> bool:
    return not _FORMULA_SIGN.search(inner)


class Reading:
    """One field: its clean text, and how many nodes of each kind it held."""

    def __init__(self, text: str):
        self.kinds: dict[str, int] = {}
        self.clean = self._tidy(self.read(text, 0))

    def _hit(self, kind: str) -> None:
        self.kinds[kind] = self.kinds.get(kind, 0) + 1

    def read(self, text: str, depth: int) -> str:
        if depth > DEPTH:
            return text
        out, last = [], 0
        pos = 0
        while (at := START.search(text, pos)) and at.start() < len(text):
            m = GRAMMAR.match(text, at.start())
            made = self.node(m.lastgroup if m.lastgroup != "env" else "formula", m.group(), depth) if m else None
            if made is None:  # no markup: read on behind the sign
                pos = at.start() + 1
                continue
            out.append(text[last : m.start()])
            out.append(made)
            last = pos = max(m.end(), m.start() + 1)
        out.append(text[last:])
        return "".join(out)

    def node(self, kind: str, s: str, depth: int) -> str | None:
        again = lambda t: self.read(t, depth + 1)
        if kind == "formula":
            inner = re.sub(r"^(?:\$\$?|\\[\[(]|\\begin\{[^}]*\}|<math\b[^<>]*>)|(?:\$\$?|\\[\])]|\\end\{[^}]*\}|</math\s*>)$", "", s, flags=re.I).strip()
            if s.startswith("$") and not s.startswith("$$") and _is_money(inner):
                return None
            self._hit("math")
            inner = re.sub(r"\\label\{[^}]*\}", "", inner).strip()
            inner = html.unescape(inner) if s[0] == "<" else inner
            return f"\n$${inner}$$\n" if s.startswith(("$$", "\\[", "\\begin")) else f"${inner}$"
        if kind == "entity":
            made = html.unescape(s if s.endswith(";") else s + ";")
            if made == s or made == s + ";":
                return None
            self._hit("html")
            more = html.unescape(made + ";") if made.startswith("&") else made
            return more.rstrip(";") if made.startswith("&") else made.replace("\xa0", " ")
        if kind == "tag":
            name = re.match(r"</?([\w.:-]+)", s).group(1).lower().split(":")[-1]
            self._hit("html")
            close = s.startswith("</")
            if _HEADS.fullmatch(name):
                self._hit("heading")
                return "\n" if close else "\n\n" + "#" * (int(name[1]) if name[0] == "h" else 1) + " "
            if name in ("li", "list-item"):
                self._hit("list")
                return "" if close else "\n- "
            if name in ("td", "th"):
                self._hit("table")
                return " | " if close else ""
            return "\n" if name in ("p", "br", "div", "tr", "table", "ul", "ol", "blockquote", "section", "hr", "dl", "dt", "dd", "sec", "abstract") else ""
        self._hit(FAMILY[kind])
        if kind == "comment":
            return ""
        if kind == "code":
            body = re.sub(r"^```[^\n`]*\n|\n?[ \t]*```$|^`|`$|</?(?:pre|code|tt|source|syntaxhighlight)\b[^<>]*>|\\(?:begin|end)\{[^}]*\}", "", s, flags=re.I)
            body = html.unescape(body) if s[0] == "<" else body
            return f"\n```\n{body.strip(chr(10))}\n```\n" if s.startswith(("```", "<pre", "<PRE", "\\begin", "<source", "<syntax")) else f"`{body}`"
        if kind == "template":
            parts = s.strip("{}").split("|")
            if len(parts) > 1 and parts[0].strip().lower() in ("lang", "transl", "nowrap", "math", "em", "nobold"):
                return again(parts[-1])
            pairs = [p.split("=", 1) for p in parts[1:] if "=" in p]
            if parts[0].strip().lower().startswith("infobox"):
                return "\n" + "".join(f"{again(k.strip())}: {again(v.strip())}\n" for k, v in pairs)
            return ""
        if kind == "wikitable":
            rows = re.split(r"\n[ \t]*\|-[^\n]*", re.sub(r"^\{\|[^\n]*|\n?[ \t]*\|\}$", "", s))
            cells = [[again(re.sub(r"^[^\[|]*\|(?!\|)", "", c).strip()) for c in re.split(r"\n[ \t]*[|!]|\|\||!!", r) if c.strip()] for r in rows]
            return "\n" + "".join(" | ".join(c) + "\n" for c in cells if c)
        if kind == "redirect":
            return ""
        if kind == "wikilink":
            target, _, shown = s[2:-2].partition("|")
            return "" if re.match(r"\s*(?:file|image|category)\s*:", target, re.I) else again(shown.rsplit("|", 1)[-1] or target)
        if kind == "mdlink":
            return again(s[s.index("[") + 1 : s.rindex("](")])
        if kind == "extlink":
            inner = s[1:-1].split(None, 1)
            return again(inner[1]) if len(inner) > 1 else inner[0]
        if kind == "heading":
            lines = s.strip().split("\n")
            level = len(s.lstrip()) - len(s.lstrip().lstrip("=#")) or (1 if lines[-1].strip().startswith("=") else 2)
            return f"\n{'#' * min(level, 6)} {again(lines[0].strip().strip('=#').strip())}\n"
        if kind == "rule":
            return "\n"
        if kind == "table":
            cells = [c.strip() for c in s.strip().strip("|").split("|")]
            return "" if all(re.fullmatch(r":?-+:?", c) for c in cells) else " | ".join(again(c) for c in cells)
        if kind == "quote":
            return "> "
        if kind == "ordered":
            return re.sub(r"(?m)^[ \t]*(\d+)[.)][ \t]+([^\n]*)", lambda m: f"{m.group(1)}. {again(m.group(2))}", s)
        if kind == "item":
            mark = s.strip()
            return "  " * (len(mark) - 1) + "- "
        if kind == "strong":
            return again(s.strip(s[0]))
        if kind == "texquote":
            return f"\u201c{again(s[2:-2])}\u201d"
        if kind == "accent":
            letter = re.sub(r"[\\{}]", "", s)
            if letter[0] in ACCENTS and len(letter) == 2:
                return unicodedata.normalize("NFC", letter[1] + ACCENTS[letter[0]])
            return {"ss": "ß", "ae": "æ", "oe": "œ", "aa": "å", "o": "ø", "l": "ł", "AE": "Æ", "OE": "Œ", "AA": "Å", "O": "Ø", "L": "Ł"}.get(letter, letter)
        if kind == "switch":
            return again(re.sub(r"^\{\\[A-Za-z]+[ \t]*|\}$", "", s))
        if kind == "command":
            name = re.match(r"~?\\([A-Za-z]+)", s).group(1)
            args = _ARG.findall(s)
            if name in ("begin", "end"):
                return "\n"
            if name == "item":
                self._hit("list")
                return "\n- "
            if name in ("section", "subsection", "subsubsection", "chapter", "paragraph", "title"):
                self._hit("heading")
                return f"\n{'#' * (1 + name.count('sub'))} {again(args[-1])}\n" if args else "\n"
            if name in ("texttt", "verb") and args:
                return f"`{args[-1]}`"
            if name in SILENT_COMMANDS:
                return ""
            if name == "footnote":
                return f" ({again(args[-1])})" if args else ""
            return again(args[-1]) if args else ""
        return " " if s == "~" else "\n" if s.startswith("\\\\") else s[1:]

    @staticmethod
    def _tidy(t: str) -> str:
        parts = re.split(r"(```\n[\s\S]*?\n```)", t)
        return re.sub(r"\n{3,}", "\n\n", "".join(p if i % 2 else re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ \t]{2,}", " ", p)) for i, p in enumerate(parts))).strip()


def clean_markup(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, clean, kinds)`` of every row and field.

    ``kinds`` maps each kind of markup found (html, math, code, heading, list, table, wiki, markdown, latex) to its number
    of nodes; it is empty where the field has none, and ``clean`` is then the field as it is.  Null stays null.  The key
    may be null or repeated; extra columns are ignored.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    long_ = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t")) for f in fields])).alias("_f")).select("_key", "_f.field", "_f.t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, kinds = [], []
            for t, may in zip(b["t"], b["may"]):
                r = Reading(t) if may else None
                texts.append(r.clean if r and r.kinds else t)
                kinds.append(r.kinds if r else {})
            yield pd.DataFrame({"_key": b["_key"], "field": b["field"], "clean": texts, "kinds": kinds})

    got = long_.withColumn("may", F.coalesce(F.col("t").rlike(SIGNS), F.lit(False))).mapInPandas(run, f"_key {kind}, field string, clean string, kinds map<string,int>")
    return got.withColumnRenamed("_key", key)
