import random

import numpy as np

from grovekit.llm import overlap, suffixes

SCHEMA = "id string, split string, title string, abstract string, source string"


def run(spark, rows):
    found = overlap.overlaps(spark.createDataFrame(rows, SCHEMA), keep=("source",))
    return {(r.id_t, r.id_e) for r in overlap.expand(found.pairs, found.members).collect()}, overlap.report(found)


def brute(rows):
    good = [(i, s.strip().lower(), overlap_words(t, a)) for i, s, t, a, _ in rows if s and t and a and t.strip() and a.strip()]
    return {(i, j) for i, s, x in good if s == "train" for j, u, y in good if u in ("eval", "test") and overlap.share_of_words(x, y) >= 0.8 - 1e-12}


def overlap_words(t, a):
    return "".join(c if c.isalnum() else " " for c in f"{t} {a}".lower()).split()


def test_edited_copies(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([2, 4, 5, 8, 11, 14, 40, 90]))]
        rows.append((f"t{i}", " Train", "head", " ".join(words), "s"))
        w = list(words)
        if len(w) < 11:  # any edit that keeps four fifths
            rng.shuffle(w)
            for _ in range(rng.randrange(len(w) // 4 + 1)):
                w[rng.randrange(len(w))] = "new"
        else:
            for _ in range(rng.randrange(max(1, len(w) // 30) + 1)):
                w[rng.randrange(len(w))] = "new"
        rows.append((f"e{i}", rng.choice(["eval", "TEST "]), "Head!", " ".join(w), "s"))
    rows += [("x1", None, "a", "b", "s"), ("x2", "train", None, "b", "s"), ("x3", "eval", "a", "  ", None), ("x4", "eval", "!", "?", None), ("c1", "train", "same", "long " * 3000, None), ("c2", "test", "same", "long " * 3000, None), ("c3", "test", "same", "long " * 3000, None)]
    got, report = run(spark, rows)
    assert got == brute(rows)
    assert {(r.split, r.source): r.exact for r in report.collect()}[("test", None)] == 2


def test_hot_text_in_many_records(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 4)
    rng = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(30))
    rows = []
    for i in range(12):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(40))
        rows.append((f"t{i}", "train", "x", f"{hot} {own}", "s"))
        rows.append((f"e{i}", "eval", "x", f"{hot} {own} more" if i % 2 else f"{hot} other{i}", "s"))
        rows.append((f"q{i}", "train", "x", f"{hot} quoted{i}", "s"))
    got, _ = run(spark, rows)
    assert got == brute(rows) and len(got) > 12


def test_templated_copies_of_more_than_fifty_pairs(spark):
    base = [f"b{i}" for i in range(39)]
    rows = []
    for k in range(8):
        for s in ("train", "eval"):
            w = list(base)
            for at in (7, 15, 23, 31):
                w[at] = f"{s}{k}x{at}"
            rows.append((f"{s}{k}", s, "Head", " ".join(w), "s"))
            rows.append((f"short {s}{k}", s, "Other", " ".join([*(f"c{i}" for i in range(9)), f"{s}{k}"]), "s"))
    got, _ = run(spark, rows)
    assert got == brute(rows) and len(got) == 128


def test_lengths_on_both_sides_of_short(spark):
    rows = []
    for k, (n, more) in enumerate([(9, 2), (10, 1), (10, 2), (11, 1), (11, 2), (12, 3), (13, 3)]):
        w = [f"l{k}w{i}" for i in range(n)]
        rows += [(f"t{k}", "train", "Head", " ".join(w), "s"), (f"e{k}", "test", "Head", " ".join([*w[:4], *(f"m{k}{i}" for i in range(more)), *w[4:]]), "s")]
    got, _ = run(spark, rows)
    assert got == brute(rows) and len(got) == 7


def test_edits_spread_evenly(spark):
    rows = []
    for k, n in enumerate((44, 50, 98, 150)):
        w = [f"k{k}w{i}" for i in range(n)]
        rows += [(f"t{k}", "train", "Head", " ".join(w), "s"), (f"e{k}", "eval", "Head", " ".join(f"new{k}{i}" if i % 6 == 5 else x for i, x in enumerate(w)), "s")]
        rows.append((f"s{k}", "test", "Head", " ".join(sorted(w, key=lambda x: x[::-1])), "s"))
    got, _ = run(spark, rows)
    assert got == brute(rows) and len(got) == 8


def test_empty(spark):
    got, report = run(spark, [])
    assert got == set() and report.count() == 0


def spans_of(spark, train, held):
    side = lambda texts, k, first: [(first + i, k, [hash_of(w) for w in t]) for i, t in enumerate(texts)]
    rows = side(train, 1, 0) + side(held, 2, 1000)
    return suffixes.spans(spark.createDataFrame(rows, "ref long, side long, w array<long>"))


def hash_of(w):
    return (hash(("word", w)) * 0x9E3779B97F4A7C15 + 1) % 2**64 - 2**63


def test_spans_are_shared_and_long_ones_are_all_met(spark):
    rng = random.Random(5)
    boiler = [f"b{i}" for i in range(30)]
    train = [[f"v{rng.randrange(60)}" for _ in range(rng.choice([3, 9, 30, 80]))] + boiler * (i % 3 == 0) for i in range(40)]
    held = []
    for i in range(30):
        own = [f"u{rng.randrange(10**6)}" for _ in range(20)]
        t = rng.choice(train)
        at = rng.randrange(max(1, len(t) - 15))
        held.append(own[:7] + t[at : at + 15] + own[7:] + boiler * (i % 2))
    for parts in ("4", "23"):  # equal suffixes lie in several ranges
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = spans_of(spark, train, held).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        met = {}
        for r in got:
            e, t = held[r.ref_e - 1000], train[r.ref_t]
            x = e[r.lo : r.hi]
            assert len(x) >= 5 and any(t[k : k + len(x)] == x for k in range(len(t)))
            met.setdefault(r.ref_e, set()).update(range(r.lo, r.hi))
        long_ = suffixes.LENGTH + suffixes.WINDOW - 1
        grams = {tuple(t[k : k + long_]) for t in train for k in range(len(t) - long_ + 1)}
        for i, e in enumerate(held):
            for k in range(len(e) - long_ + 1):
                if tuple(e[k : k + long_]) in grams:
                    assert len(met[1000 + i] & set(range(k, k + long_))) >= suffixes.LENGTH


def test_coverage_of_copies_and_of_boilerplate(spark):
    boiler = [f"b{i}" for i in range(55)]
    rows = [("t1", "train", "Head", " ".join([*boiler, *(f"x{i}" for i in range(44))]), "s"), ("e1", "eval", "Head", " ".join([*boiler, *(f"y{i}" for i in range(44))]), "s")]
    rows += [("t2", "train", "Two", " ".join(f"z{i}" for i in range(60)), "s"), ("e2", "test", "Two", " ".join(f"z{i}" for i in range(60)), "s")]
    got, report = run(spark, rows)
    assert got == {("t2", "e2")} == brute(rows)
    assert {r.split: r.coverage for r in report.collect()} == {"eval": 0.56, "test": 1.0}


def test_union_of_spans(spark):
    s = spark.createDataFrame([(1, 9, 0, 4), (1, 9, 2, 6), (1, 9, 2, 6), (1, 9, 8, 9), (2, 5, 1, 3)], "ref_e long, words long, lo long, hi long")
    assert {(r.ref_e, r.covered) for r in suffixes.covered(s, "ref_e").collect()} == {(1, 7), (2, 2)}


def test_packed_words_in_common():
    a = np.array([3, 4, 5, 6, 7, 8, 9, 10], np.uint64)
    pack = lambda x, at=0: suffixes._packed(np.array(x, np.uint64), np.array([at]), 1, np.array([len(x)]))
    for k in range(9):
        b = a.copy()
        b[k:] += np.uint64(1)
        assert suffixes._common(pack(a), pack(b))[0] == k
    assert suffixes._common(pack(a[:3]), pack(a[:5]))[0] == 3


def test_words_and_hot_keys_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 4)  # blocks of two texts
    told, tables = [], {}
    sc, keep = spark.sparkContext, overlap.materialise
    broadcast = sc.broadcast
    monkeypatch.setattr(sc, "broadcast", lambda x: told.append(x) or broadcast(x))
    monkeypatch.setattr(overlap, "materialise", lambda df, what="step": tables.setdefault(what, keep(df, what)))
    rows = []
    for i in range(12):  # of nine words the two rarest are keys: "hot", in 7 training and 5 evaluation texts, and its repetition in 3 and 2
        side, of = (1, i) if i < 7 else (2, i - 7)
        w = ["hot"] + ["hot"] * (of < 4 - side) + [f"all{k}" for k in range(8 - (of < 4 - side))]
        rows.append((i, (4 * i + 1, 0), side, [hash_of(x) for x in w]))
    rows += [(20 + i, (4 * i + 2, 0), 1, [hash_of(f"all{k}") for k in range(8)] * 3) for i in range(12)]
    reps = spark.createDataFrame(rows, "ref long, class struct<ref:long,more:int>, side long, w array<long>")
    overlap._near(reps)
    often = np.zeros(overlap.CELLS, np.int64)
    for *_, w in rows:
        np.add.at(often, (np.array(w, np.int64).view(np.uint64) % np.uint64(overlap.CELLS)).astype(np.int64), 1)
    assert np.array_equal(told[0], often)
    keys = {}
    for _, _, side, w in rows:
        words = np.array(w, np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            _, tok, place = overlap._tokens(words, np.array([0, len(w)]), often)
        for k in tok[place <= len(w) // 5].view(np.int64).tolist():
            keys.setdefault(k, [0, 0])[side - 1] += 1
    hot = {(k, -(-t // 2), -(-e // 2)) for k, (t, e) in keys.items() if t and e and max(t, e) > 2}
    assert {tuple(r) for r in tables["hot"].collect()} == hot and {(t, e) for _, t, e in hot} >= {(4, 3), (2, 1)}


def test_coverage_counts_all_shared_runs(spark):
    rng = random.Random(9)
    rows, want = [], {}
    train = [[f"t{rng.randrange(500)}" for _ in range(40)] for _ in range(30)]
    rows += [(f"t{i}", "train", "Head", " ".join(w), "s") for i, w in enumerate(train)]
    grams = {tuple(w[k : k + 5]) for t in train for w in [["head", *t]] for k in range(len(w) - 4)}
    for i in range(40):
        w = [f"own{i}x{k}" for k in range(30)]
        for at in (3, 17):  # spans of 4 words don't count, those of 5 to 10 do
            n, t = rng.randrange(4, 11), rng.choice(train)
            k = rng.randrange(len(t) - n)
            w[at : at + n] = t[k : k + n]
        rows.append((f"e{i}", "eval", "Title", " ".join(w), "s"))
        w = ["title", *w]
        got = set().union(*(range(k, k + 5) for k in range(len(w) - 4) if tuple(w[k : k + 5]) in grams))
        want[f"e{i}"] = len(got)
    found = overlap.overlaps(spark.createDataFrame(rows, SCHEMA), keep=("source",))
    got = {r.id: r.covered for r in found.members.where("side = 2").join(found.coverage, "class").collect()}
    assert got == {k: n for k, n in want.items() if n} and len(got) > 30
