from pyspark.sql import functions as F

from grovekit.functions import text as T
from grovekit.functions import tokens

R = T.ROOT


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first().y


def test_path_grammar(spark):
    cases = {f"{R} -> A -> B": [R, "A", "B"], R: None, f"{R} -> A ->  -> B": None, f"{R} -> A->B": None, f"{R} -> A  -> B": [R, "A ", "B"], "A -> B": None, "": None, f"{R} -> A\rB": [R, "A\rB"]}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    assert {r.x: r.y for r in df.select("x", T.path_titles(F.col("x")).alias("y")).collect()} == cases | {None: None}


def test_lines_steps_concepts(spark):
    assert one(spark, " a \n\n\t\nb ", "x string", T.lines) == ["a", "b"]
    assert one(spark, None, "x string", T.lines) == []
    assert [tuple(s) for s in one(spark, ["a", "b", "c"], "x array<string>", T.steps)] == [("a", "b"), ("b", "c")]
    assert one(spark, ["a"], "x array<string>", T.steps) is None
    assert one(spark, 'a,, "b".', "x string", T.concepts) == ["a", "", "b"]
    assert one(spark, " x \n y\n\n", "x string", T.joined_lines) == "x y"


def test_dates_and_versions(spark):
    got = one(spark, "Mon, 2 Apr 2007 19:18:42 GMT", "x string", lambda c: T.version_date(c).cast("string"))
    assert got == "2007-04-02 19:18:42"
    assert one(spark, "nonsense", "x string", T.version_date) is None
    assert one(spark, [("v10", "late"), ("v2", "early")], "x array<struct<version:string,created:string>>", T.first_version) == "early"


def test_pattern_lines(spark):
    df = spark.createDataFrame([(" a b ||| c |||such as 1",), ("a|||b|||c|||d",), ("none",), (None,)], "x string")
    child, parent = T.pattern_line(F.col("x"))
    assert [tuple(r) for r in df.select(child, parent).collect()] == [("a b", "c"), ("a|||b", "c"), (None, None), (None, None)]


def triples(spark, text):
    out = one(spark, text, "x string", T.triplets)
    return None if out is None else [tuple(t) for t in out]


def test_triplets(spark):
    assert triples(spark, "<s><triplet> big cats <subj> animals <obj> subclass of</s><pad>") == [("big cats", "subclass of", "animals")]
    assert triples(spark, "<triplet> h <subj> t1 <obj> r1 <subj> t2 <obj> r2 <triplet> k <subj> u <obj> r3") == [("h", "r1", "t1"), ("h", "r2", "t2"), ("k", "r3", "u")]
    assert triples(spark, "<triplet> h <subj> t <obj>") == []
    assert triples(spark, "<obj> r <triplet> h") == [("", "r", "")]  # only the relation is looked at between markers
    assert triples(spark, "words only") == [] and triples(spark, "") == [] and triples(spark, None) is None


def test_prompts(spark):
    df = spark.createDataFrame([("Ti", "Ab", [("E", "Ea", [[R, "x"], [R, "y"]])], [])], "title string, abstract string, ex array<struct<title:string,abstract:string,paths:array<array<string>>>>, none array<struct<title:string,abstract:string,paths:array<array<string>>>>")
    c = [F.col("title"), F.col("abstract")]
    r = df.select(T.article_prompt(*c).alias("a"), T.hierarchy_prompt(*c, F.col("ex")).alias("b"), T.hierarchy_prompt(*c, F.col("none")).alias("c"), T.hierarchy_prompt(*c).alias("d"), T.concept_prompt(*c).alias("e")).first()
    assert r.a == "Title: Ti\nAb"
    assert f"from the root to the leaf. \n### EXAMPLE 1 ###\n### ARTICLE ###\nTitle: E\nEa\n### END ARTICLE ###\n{R} -> x\n{R} -> y\n### END EXAMPLE 1 ###\n\n### ARTICLE ###\nTitle: Ti\nAb\n### END ARTICLE ###\n\nProvide" in r.b
    assert r.b.endswith("article. Use the same format as the examples above.\n")
    assert r.c == r.d and "leaf. \nYou must answer in the format of:\n" in r.d and r.d.endswith("Use the format described above.\n")
    assert r.e.endswith("### END ARTICLE ###\n\nGive your answer as a comma-separated string.\n")


def test_chat(spark):
    kind = "x array<struct<role:string,content:string>>"
    assert one(spark, [("user", "u"), ("assistant", "a"), ("user", "v")], kind, T.chat) == "<s>[INST] u [/INST]a</s>[INST] v [/INST]"
    assert one(spark, [("system", "u")], kind, T.chat) is None
    assert one(spark, [("user", "u"), ("user", "u")], kind, T.chat) is None
    assert one(spark, [], kind, T.chat) == "<s>"


def test_masks_and_padding(spark):
    # 9 9 mark; 5 arrow, 6 newline, 7 end; 1 root, 2 and 3 titles
    ids = [4, 9, 9, 1, 5, 2, 2, 6, 1, 5, 3, 6, 7]
    words = {1: "r", 2: "a", 3: "b"}
    dec = lambda w: "".join(words[i] for i in w)
    weights = {("r", "aa"): 0.4, ("r", "b"): 1.0}
    plain, detailed = tokens.masks(ids, [9, 9], 5, 6, 7, dec, weights, lambda at: 0.5)
    assert plain == [True] * 3 + [False] * 10
    assert detailed == [True] * 3 + [False, False, True, True, False, False, False, False, False, False]
    assert tokens.masks(ids, [8], 5, 6, 7, dec, weights, lambda at: 0.5) is None
    assert tokens.masks(ids, [9, 9], 5, 6, 7, dec, {}, lambda at: 0.5) is None
    assert (tokens.padded_length(16), tokens.padded_length(15), tokens.padded_length(16, 8, 20)) == (24, 16, 20)
    df = spark.createDataFrame([([1, 2], [True, False])], "i array<int>, m array<boolean>")
    i, m, lab = tokens.pad(F.col("i"), F.col("m"), F.lit(4), 0)
    assert [list(x) for x in df.select(i, m, lab).first()] == [[1, 2, 0, 0], [True, False, True, True], [-100, 2, -100, -100]]
    got = tokens.mask_tokens(spark.createDataFrame([("a", ids), ("b", [1]), ("c", None)], "k string, ids array<int>"), "k", "ids", [9, 9], 5, 6, 7, words, weights).collect()
    assert [r.k for r in got] == ["a"] and len(got[0].ignores_detailed) == len(ids)
