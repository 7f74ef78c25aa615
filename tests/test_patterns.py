import pytest

from grovekit.functions import patterns

TAGS = {"is": ("be", "VBZ"), "are": ("be", "VBP"), "a": ("a", "DT"), "an": ("an", "DT"), "the": ("the", "DT"), "big": ("big", "JJ"), "very": ("very", "RB"), "biggest": ("big", "JJS"), "of": ("of", "IN"), "such": ("such", "JJ"), "as": ("as", "IN"), "and": ("and", "CC"), "or": ("or", "CC"), "other": ("other", "JJ"), "including": ("include", "VBG"), "like": ("like", "IN"), "Like": ("like", "IN"), "most": ("most", "RBS"), "which": ("which", "WDT"), "called": ("call", "VBN"), "special": ("special", "JJ"), "that": ("that", "WDT"), "run": ("run", "VBP"), ",": (",", ","), "some": ("some", "DT")}


def sent(text):
    return [(w, *TAGS.get(w, (w.rstrip("s"), "NNS" if w.endswith("s") else "NN"))) for w in text.split()]


def found(text):
    return {(t, h, r) for t, h, r, _ in patterns.match(sent(text))}


@pytest.mark.parametrize("text,want", [
    ("cats and other animals run", ("cats", "animals", "and other 0")),
    ("cats , dogs and other big animals run", ("cats", "big animals", "and other 1")),
    ("cats , dogs , cows , or some other animals", ("cats", "animals", "and other 2")),
    ("cats are a kind of animals", ("cats", "animals", "example of")),
    ("cats , which are called animals", ("cats", "animals", "which is called")),
    ("cats are the biggest animals", None),
    ("cats are biggest animals", ("cats", "animals", "is JJS")),
    ("lattice is a special case of the poset", ("lattice", "poset", "special case of")),
    ("cat is an animal that run", ("cat", "animal", "is an X that")),
    ("the cat is a very animal", None),
    ("the cat is a big animal", ("cat", "animal", "is a [!part]")),
    ("animals such as cats , dogs", ("dogs", "animals", "such as 1")),
    ("animals such as cats , dogs , cows", ("cows", "animals", "such as 2")),
    ("animals such as cats , dogs and cows", ("cows", "animals", "such as &")),
    ("run run animals such as cats", ("cats", "animals", "!features such as")),
    ("Like most animals , the cats run", ("cats", "animals", "like most")),
    ("animals , including cats", ("cats", "animals", "including 0")),
    ("animals including cats , dogs", ("dogs", "animals", "including 1")),
    ("animals including cats and dogs", ("dogs", "animals", "including &")),
    ("kings of spain and other kings of europe", ("kings of spain", "kings of europe", "and other 0")),
])
def test_patterns(text, want):
    got = found(text)
    assert (want in got) if want else all(r not in ("is JJS",) for _, _, r in got)


def test_there_are_28_rules():
    names = [n for n, _ in patterns.rules()]
    assert len(names) == len(set(names)) == 28


def test_operator_counts_head_words(spark):
    rows = [(1, sent("cats and other farm animals")), (2, []), (3, None), (4, [("a/b c", "x", "NN"), *sent("and other things")])]
    df = spark.createDataFrame(rows, "id int, tokens array<struct<word:string,lemma:string,tag:string>>")
    assert {tuple(r) for r in patterns.pattern_matches(df, "id", "tokens").collect()} == {(1, "cats", "farm animals", "and other 0"), (4, "a/b c", "things", "and other 0")}
    assert patterns.pattern_matches(df, "id", "tokens", True).where("id = 1").count() == 2
