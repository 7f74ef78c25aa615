import random

import pytest
from pyspark.sql import functions as F

from grovekit.llm import encode, leakage, markup, pii


def test_encoding_equals_the_public_library_and_back(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(encode.DEFAULT_VOCABULARY)
    ref.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["", "Hello  world's\n\n x", "a" * 3000, " " * 500, "<|endoftext|> <unk> ▁", "naïve 漢字 🙂​", "\x00\x1c \x85x"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x1F000), 32, 10])) for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = encode.encode_corpus(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[-1] == [] and got[0] == [] and len(got[None]) == 1
    assert [got[i] for i in range(len(texts))] == [x.ids for x in ref.encode_batch(texts, add_special_tokens=False)]
    back = {r.doc_id: r.text for r in encode.decode_corpus(out, "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_vocabulary_of_ranks_gives_the_same_pieces():
    assert encode.vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken") == encode.vocabulary(encode.DEFAULT_VOCABULARY)


def test_a_full_cache_is_forgotten(monkeypatch):
    monkeypatch.setattr(encode, "CACHE", 10)
    e = encode.encoder(encode.DEFAULT_VOCABULARY)
    texts = ["one two three four five six seven eight nine ten eleven", "one twelve " + "z" * 200, "z" * 200]
    assert [e.decode(x) for x in e.encode(texts)] == texts


def brute_leaks(docs, items, n):
    out = set()
    for d, t in docs:
        w = leakage.words_of(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, u in items:
            v = leakage.words_of(u)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [leakage.BLOCK_WORDS, 30])
def test_leaks_against_brute_force(spark, block):
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(12)}" for _ in range(rng.randrange(2, 25)))) for i in range(12)] + [(99, None), (98, ""), (97, "short one")]
    docs = []
    for d in range(60):
        w = [f"v{rng.randrange(14)}" for _ in range(rng.randrange(30))]
        src = rng.choice(items[:12])[1].split()
        k = rng.randrange(len(src))
        docs.append((d, " ".join(w[:5]) + " -- " + ", ".join(src[k : k + rng.randrange(1, 12)]).upper() + "!" + " ".join(w[5:])))
    docs += [(100, None), (101, ""), (102, (items[0][1] + " x ") * 300), (103, docs[0][1])]
    ds = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    its = spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaks(ds, "doc_id", "text", its, "item_id", "text", n=5, block_words=block)
    assert {(r.doc_id, r.item) for r in found.collect()} == brute_leaks(docs, items, 5)
    clean = {r.doc_id: r.text for r in leakage.without_leaks(ds, "doc_id", "text", found).collect()}
    assert clean[100] is None and clean[101] == ""
    first = {r.doc_id for r in found.collect()}
    assert all(clean[d] == t for d, t in docs if d not in first)
    again = leakage.leaks(spark.createDataFrame(list(clean.items()), "doc_id long, text string"), "doc_id", "text", its, "item_id", "text", n=5)
    assert again.count() < found.count()


MARKED = {
    "<i>a</i> b": "a b", "x &amp; y &#x2013; z &lt; 3": "x & y – z < 3", "H<sub>2</sub>O<br/>": "H2O", "<!-- no -->yes": "yes", "[[Rome|the city]] of {{lang|la|Roma}}": "the city of Roma",
    "== Head ==": "## Head", "**b** and __c__ and *d* and ~~e~~": "b and c and d and e", "[t](https://x.y/z) ![i](http://a.b/c.png)": "t i", "`f()` runs": "`f()` runs",
    r"\emph{word} \cite{k} 9\%": "word 9%", r"G\"odel and Nar\'{e}": "Gödel and Naré", "``q''": "“q”", r"of $\beta$-decay": r"of $\beta$-decay", r"\begin{itemize} \item a \item b \end{itemize}": "- a\n- b",
    "1. a\n2. b": "1. a\n2. b", "- a\n- b": "- a\n- b", "# T\n\ntext": "# T\n\ntext", "| a | b |\n|---|---|\n| 1 | 2 |": "a | b\n\n1 | 2", "<pre><code>x = 1</code></pre>": "```\nx = 1\n```", "'''b''' x": "b x", "> quoted text": "> quoted text", "an *old\n  rank* here": "an old\n  rank here",
}
PLAIN = [
    "", "a < b and c > d", "from $40 to $80 per day", "a_b_c column", "[1, 5] and [13]", "C# and F#", "R&D, Q&A; x", "9 * 3 grid", "C*-rank of a C*-algebra", "<21 mm but >4 mm", "#3 among ~16 km", "x <= 6 && y >= 0",
    "a -> b", 'x = "y"', "the set {b, y}", "64% & rising", "costs $5 million", "it's 'so'", "in 1604.\n12 Then", "a - b", "5' 2''", "1|2", "e.g. a/b\\",
]


def test_markup_and_what_only_looks_like_it():
    assert {t: markup.Reading(t).clean for t in MARKED} == MARKED
    assert not [t for t in MARKED if not markup.Reading(t).kinds]
    assert not [t for t in PLAIN if markup.Reading(t).kinds]


def test_markup_operator_on_odd_rows(spark):
    rows = [("a", "<b>x</b>", None), ("a", None, ""), (None, "plain", "y" * 200_000 + "<p>"), ("d", "<" * 5000, "$" * 5000 + "{" * 3000 + "[" * 3000)]
    df = spark.createDataFrame(rows, "id string, title string, abstract string").withColumn("field", F.lit(0)).withColumn("kinds", F.lit(0))
    got = markup.clean_markup(df, "id", ["title", "abstract"]).collect()
    assert len(got) == 8
    assert {(r.id, r.field) for r in got if r.kinds} >= {("a", "title"), (None, "abstract")}
    assert markup.clean_markup(df.limit(0), "id", ["title"]).count() == 0


def test_personal_data_on_lessons_never_seen():
    import numpy as np

    from grovekit.llm.pii_lessons import lesson

    rng = np.random.default_rng(5)
    models, right, found, true = pii.fitted(), 0, 0, 0
    for _ in range(500):
        text, gold = lesson(rng)
        want = {(k, text[a:z]) for k, a, z in gold}
        spans = pii.find_spans([text], models)[0]
        hit = sum(any(k == g and min(z, y) - max(a, x) > 0.6 * (y - x) for k, a, z in spans) for g, x, y in gold)
        right, found, true = right + hit, found + len(spans), true + len(gold)
        assert pii.redact(text, spans).count("[") >= len(spans) or not want
    assert right / found > 0.95 and right / true > 0.95


def test_personal_data_in_plain_cases(spark):
    rows = [
        (1, "Write to jane.roe@mail.example or call +1 (202) 555-0147."), (2, "The Oskar Basin and the Lamdor theorem; ISBN 978-0-00-081270-8, ISSN 1234-5678."), (3, None), (4, ""), (5, "Thanks to Dr. Petra Kelmor, 12 Lunbi Street, Ralgor."),
        (8, "lives at 15 JUNKODARAK ROAD, APT 26A, FAR; IN 1604 THE ROAD WAS CLOSED"), (6, "Please delete passport no. XZ6103515 from the page."), (7, "Ping @kelmor at 7"), (7, "x " * 50_000 + "ravi [at] lab [dot] kel [dot] org"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(0)).withColumn("clean", F.lit(0))
    got = pii.redacted(df, "doc_id", "text").collect()
    kinds = sorted(((r.doc_id, tuple(r.kinds)) for r in got))
    assert kinds == [(1, ("email", "phone")), (2, ()), (3, ()), (4, ()), (5, ("address", "name")), (6, ("id_number",)), (7, ()), (7, ("email",)), (8, ("address",))]
    assert next(r.clean for r in got if r.doc_id == 1) == "Write to [EMAIL] or call [PHONE]."
    assert pii.redacted(df.limit(0), "doc_id", "text").count() == 0


def test_names_outside_the_list_of_given_names():
    cases = {
        "Thanks to Jonathan Reyes for it.": "Jonathan Reyes", "Reviewed by K. Lindqvist and kept.": "K. Lindqvist", "Signed, Kowalska": "Kowalska", "I spoke with José Garcia on Monday.": "José Garcia",
        "JOHN SMITH asked twice for the raw files.": "JOHN SMITH", "Written by Сергей Волков in spring.": "Сергей Волков", "author=田中太郎;": "田中太郎",
    }
    got = pii.find_spans(list(cases), pii.fitted())
    assert [[t[a:z] for k, a, z in s if k == "name"] for t, s in zip(cases, got)] == [[x] for x in cases.values()]
    plain = ["Near Jorkagerak, readers may wait.", "### END ARTICLE ###", "Die Dichte der Gräser von Zorkovakov hängt ab.", "The Oskar Basin and the Lamdor theorem"]
    assert not any(k == "name" for s in pii.find_spans(plain, pii.fitted()) for k, _, _ in s)


def test_trees_learn_an_interaction():
    import numpy as np

    from grovekit.llm.boosting import BoostedTrees, Calibrated

    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (((BoostedTrees().fit(x[:1000], y[:1000]).score(x[1000:]) > 0) == (y[1000:] > 0)).mean()) > 0.95
    c = Calibrated().fit(x, y, np.arange(1500) % 3 == 0)
    assert c.best > 0.95 and 0 <= c.probability(x).min() <= c.probability(x).max() <= 1
