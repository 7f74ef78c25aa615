"""Text grammars: paths, concepts, triplets, pattern lines, dates, chats and prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The root title, the arrow between titles, and the relations that make hierarchy links.
ROOT = "Main topic classifications"
ARROW = " -> "
HIERARCHY_RELATIONS = ("subclass of", "instance of", "member of", "part of")
#: Characters stripped from both ends of a concept.
CONCEPT_EDGES = " \n\t\"',."
#: White space as text ends are stripped of it.
STRIP = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, STRIP, "")


def lines(text: Column) -> Column:
    """The stripped lines of a text that are not blank; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def path_titles(line: Column) -> Column:
    """The titles of a line ``root -> a -> b``, padding kept, or null where the line is no such path."""
    parts = F.split(line, ARROW)
    bad = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: (p == "") | p.contains("->"))
    return F.when((F.size(parts) >= 2) & (parts[0] == ROOT) & ~bad, parts)


def steps(titles: Column) -> Column:
    """Consecutive pairs ``struct(src, dst)`` of an array; none for null or fewer than two."""
    n = F.greatest(F.size(titles) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(titles, 1, n), F.slice(titles, 2, n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return F.when(F.size(titles) >= 2, pairs)


def concepts(text: Column) -> Column:
    """Comma-separated concepts, quotes and stops trimmed; empty ones are kept."""
    return F.transform(F.split(text, ","), lambda x: F.btrim(x, F.lit(CONCEPT_EDGES)))


def joined_lines(text: Column) -> Column:
    """A text's lines stripped, blank ones dropped, joined by one blank."""
    return F.when(text.isNotNull(), F.array_join(lines(text), " "))


def version_date(created: Column) -> Column:
    """The time in ``Mon, 2 Apr 2007 19:18:42 GMT``; the day's name is not looked at."""
    return F.try_to_timestamp(F.regexp_replace(created, r"^\s*[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))


def first_version(versions: Column) -> Column:
    """``created`` of the version with the smallest number in ``array<struct<version, created>>``."""
    return F.array_min(F.transform(versions, lambda v: F.struct(F.regexp_extract(v["version"], r"(\d+)", 1).cast("int").alias("n"), v["created"].alias("created"))))["created"]


def pattern_line(line: Column) -> tuple[Column, Column]:
    """``(child, parent)`` of a line ``child|||parent|||rule``, both stripped; null for other lines.  The last bars that fit part them."""
    rx = r"^(.+)\|\|\|(.+)\|\|\|(.+)$"
    return tuple(F.when(line.rlike(rx), strip(F.regexp_extract(line, rx, i))) for i in (1, 2))


def triplets(text: Column) -> Column:
    """``array<struct<head, type, tail>>`` of linearised relations, by one pass over the words.

    ``<triplet>`` opens a head, ``<subj>`` a tail, ``<obj>`` a relation; special tokens are removed first.  A relation is
    given out when the next marker opens and it is not empty; at the end all three must be non-empty.
    """
    plain = F.replace(F.replace(F.replace(text, F.lit("<s>"), F.lit("")), F.lit("<pad>"), F.lit("")), F.lit("</s>"), F.lit(""))
    words = F.filter(F.split(plain, r"[\s\p{Z}]+"), lambda w: w != "")
    empty = F.array().cast("array<struct<head:string,type:string,tail:string>>")
    start = F.struct(F.lit("x").alias("st"), F.lit("").alias("h"), F.lit("").alias("r"), F.lit("").alias("t"), empty.alias("out"))

    def state(st, h, r, t, out):
        return F.struct(st.alias("st"), h.alias("h"), r.alias("r"), t.alias("t"), out.alias("out"))

    def given(s):
        one = F.array(F.struct(strip(s["h"]).alias("head"), strip(s["r"]).alias("type"), strip(s["t"]).alias("tail")))
        return F.when(s["r"] != "", F.concat(s["out"], one)).otherwise(s["out"])

    def step(s, w):
        no = F.lit("")
        grow = lambda c: F.concat(c, F.lit(" "), w)
        return (
            F.when(w == "<triplet>", state(F.lit("t"), no, no, s["t"], given(s)))
            .when(w == "<subj>", state(F.lit("s"), s["h"], s["r"], no, given(s)))
            .when(w == "<obj>", state(F.lit("o"), s["h"], no, s["t"], s["out"]))
            .when(s["st"] == "t", state(s["st"], grow(s["h"]), s["r"], s["t"], s["out"]))
            .when(s["st"] == "s", state(s["st"], s["h"], s["r"], grow(s["t"]), s["out"]))
            .when(s["st"] == "o", state(s["st"], s["h"], grow(s["r"]), s["t"], s["out"]))
            .otherwise(s)
        )

    end = F.aggregate(words, start, step, lambda s: F.when((s["h"] != "") & (s["r"] != "") & (s["t"] != ""), given(s)).otherwise(s["out"]))
    return F.when(text.isNotNull(), end)


# The wording of the prompts.
_TASK = (
    "A category is typically represented by a word or a short phrase, representing broader topics/concepts that the article is about. "
    'A category hierarchy is represented by a collection of paths from the generic root category "Main topic classifications" '
    "to a specific category suitable for the article. The topic titles should become more and more specific as you move from the root to the leaf. \n"
)
_FORMAT = (
    "You must answer in the format of:\nMain topic classifications -> Broad topic 1 -> Subtopic 1 -> ... -> Most specific topic 1\n"
    "Main topic classifications -> Broad topic 2 -> Subtopic 2 -> ... -> Most specific topic 2\n...\n"
)
_ARTICLE = "### ARTICLE ###\nTitle: {title}\n{abstract}\n### END ARTICLE ###\n"
_OPEN = "The following is an article's title and abstract. "
_CONCEPTS = _OPEN + "Suggest the categories that this article belongs to. A category is typically represented by a word or a short phrase, representing broader topics/concepts that the article is about. You should include both general and specific categories.\n\n"


def _fill(template: str, **columns: Column) -> Column:
    out = []
    rest = template
    for name, c in columns.items():
        before, rest = rest.split("{" + name + "}", 1)
        out += [F.lit(before), F.coalesce(c, F.lit(""))]
    return F.concat(*out, F.lit(rest))


def article_prompt(title: Column, abstract: Column) -> Column:
    return _fill("Title: {title}\n{abstract}", title=title, abstract=abstract)


def response(paths: Column) -> Column:
    """One line for each path, each ended by a line break."""
    return F.array_join(F.transform(paths, lambda p: F.concat(F.array_join(p, ARROW), F.lit("\n"))), "")


def hierarchy_prompt(title: Column, abstract: Column, examples: Column | None = None) -> Column:
    """The task with numbered examples ``array<struct<title, abstract, paths>>``, or with the format where there are none."""
    intro = _OPEN + "Your task is to assign this article to a suitable category hierarchy. " + _TASK
    article = _fill("\n" + _ARTICLE + "\n", title=title, abstract=abstract)
    ask = "Provide a category hierarchy for the above article. "
    plain = F.concat(F.lit(intro + _FORMAT), article, F.lit(ask + "Use the format described above.\n"))
    if examples is None:
        return plain

    def shown(e: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(F.lit("### EXAMPLE "), n, F.lit(" ###\n"), _fill(_ARTICLE, title=e["title"], abstract=e["abstract"]), response(e["paths"]), F.lit("### END EXAMPLE "), n, F.lit(" ###\n"))

    given = F.concat(F.lit(intro), F.array_join(F.transform(examples, shown), ""), article, F.lit(ask + "Use the same format as the examples above.\n"))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, given).otherwise(plain)


def reasoning_prompt(title: Column, abstract: Column) -> Column:
    """The first of two rounds: break the topics down."""
    return _fill(_OPEN + "Briefly break down the topics (both specific and general concepts) relevant to this article. Explain your reasoning step by step.\n\n" + _ARTICLE, title=title, abstract=abstract)


def second_round_prompt() -> str:
    return "Your task now is to assign this article to a suitable category hierarchy. " + _TASK + _FORMAT


def concept_prompt(title: Column, abstract: Column) -> Column:
    return _fill(_CONCEPTS + _ARTICLE + "\nGive your answer as a comma-separated string.\n", title=title, abstract=abstract)


def chat(messages: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """``array<struct<role, content>>`` as one string, or null where roles don't alternate from ``user`` on or others occur."""
    want = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    good = F.forall(F.transform(messages, lambda m, i: F.coalesce(m["role"] == want(i), F.lit(False))), lambda x: x)
    text = F.transform(messages, lambda m, i: F.when(m["role"] == "user", F.concat(F.lit("[INST] "), m["content"], F.lit(" [/INST]"))).otherwise(F.concat(m["content"], F.lit(eos))))
    return F.when(good, F.concat(F.lit(bos), F.array_join(text, "")))


def hierarchy_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, titles)``, a row for each non-blank line of each document; titles is null where the line is no path."""
    return docs.select(key, F.explode(lines(F.col(text))).alias("line")).select(key, path_titles(F.col("line")).alias("titles"))
