import datetime
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovekit.llm import codes, deltas, frequency, pairs
from grovekit.session import fresh_path

D = datetime.datetime


def snapshot(spark, rows):
    return spark.createDataFrame([("f", i, t) for i, t in rows.items()], "field string, id string, terms array<string>")


def brute(rows):
    occ, rec = Counter(), Counter()
    for t in rows.values():
        occ.update(t or [])
        rec.update(set(t or []))
    return {(k, occ[k], rec[k], len(rows)) for k in occ}


def counts(store):
    return {(r.term, r.occurrences, r.records, r.of_records) for r in frequency.frequencies(store).collect()}


def test_increments_equal_a_recount(spark):
    rng = random.Random(2)
    store = frequency.open_store(spark, fresh_path(spark, "t"), 4)
    old = {}
    for _ in range(3):
        new = {f"r{i}": [f"t{rng.randrange(6)}" for _ in range(rng.randrange(5))] or None for i in rng.sample(range(20), 12)}
        store.merge(frequency.term_deltas_of_snapshots(snapshot(spark, old), snapshot(spark, new)))
        assert counts(store) == brute(new)
        old = new
    store.merge(frequency.term_deltas_of_snapshots(snapshot(spark, old), snapshot(spark, {})))
    assert store.read().count() == 0


def test_log_with_late_repeated_and_null_rows(spark):
    log = [("f", "a", D(2020, 1, 1), ["x", "x"]), ("f", "a", D(2021, 1, 1), ["y"]), ("f", "a", D(2021, 1, 1), ["y"]), ("f", "b", None, ["x"]), ("f", "c", D(2020, 1, 1), None), ("f", None, D(2020, 1, 1), ["z"]), ("f", "d", D(2020, 1, 1), [])]
    store = frequency.open_store(spark, fresh_path(spark, "t"))
    store.merge(frequency.term_deltas_of_log(spark.createDataFrame(log, "field string, id string, at timestamp, terms array<string>")))
    assert counts(store) == {("x", 1, 1, 4), ("y", 1, 1, 4)}
    assert {r.mark for r in frequency.marked(frequency.frequencies(store)).collect()} == {"rare"}


def test_batches_against_what_is_known(spark):
    rng = random.Random(21)
    schema = "field string, id string, at timestamp, terms array<string>"
    store = frequency.open_store(spark, fresh_path(spark, "t"), 4)
    now = {}
    for day in range(1, 5):
        batch = [("f", f"r{rng.randrange(8)}", D(2020, 1, day, h), [f"t{rng.randrange(5)}" for _ in range(rng.randrange(4))]) for h in range(10)]
        known = snapshot(spark, now) if now else None
        store.merge(frequency.term_deltas_of_log(spark.createDataFrame(batch, schema), known))
        now |= {i: t for _, i, _, t in batch}
        assert counts(store) == brute(now)


def test_only_touched_buckets_are_rewritten(spark):
    store = frequency.open_store(spark, fresh_path(spark, "t"), 64)
    store.merge(frequency.term_deltas_of_snapshots(snapshot(spark, {}), snapshot(spark, {f"r{i}": [f"t{i}"] for i in range(50)})))
    store.merge(frequency.term_deltas_of_snapshots(snapshot(spark, {"r1": ["t1"]}), snapshot(spark, {"r1": ["t2"]})))
    assert len([f for f in store.manifest()["parts"]["counts"].values() if f.startswith("000000000002-")]) <= 3


LOG = "field string, id string, at timestamp, terms array<string>, dead boolean"


def test_deliveries_late_repeated_deleted_and_grown(spark, monkeypatch):
    monkeypatch.setattr(deltas, "BUCKET_ROWS", 1)
    rng = random.Random(31)
    store = frequency.open_store(spark, fresh_path(spark, "t"), 2)
    seen = {}
    for k in range(5):
        batch = [("f", f"r{rng.randrange(9)}", D(2020, 1, 1) + datetime.timedelta(hours=rng.randrange(60)), [f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))], rng.random() < 0.2) for _ in range(8)]
        batch += [("f", None, D(2030, 1, 1), ["z"], False), (None, "r", D(2030, 1, 1), ["z"], False)]
        batch = list({(b[1], b[2]): b for b in batch}.values())  # one version to a time
        batch = [b for b in batch if b[0] is None or b[1] is None or (b[1], b[2]) not in seen]
        seen |= {(b[1], b[2]): b for b in batch if b[0] and b[1]}
        df = spark.createDataFrame(batch, LOG)
        assert frequency.deliver(store, df, f"b{k}", "dead")
        assert not frequency.deliver(store, df, f"b{k}", "dead")  # the batch is in
        newest = {}
        for (i, t), b in sorted(seen.items()):
            newest[i] = b
        want = {i: b[3] for i, b in newest.items() if not b[4]}
        assert counts(store) == brute(want)
        assert {(r.id, tuple(r.items_)) for r in store.known().selectExpr("id", "items as items_").collect()} == {(i, tuple(t)) for i, t in want.items()}
    assert store.manifest()["buckets"] > 2


def test_a_merge_that_dies_leaves_all_as_it_was(spark, monkeypatch):
    store = frequency.open_store(spark, fresh_path(spark, "t"), 4)
    row = lambda i, day, terms: ("f", i, D(2020, 1, day), terms, False)
    frequency.deliver(store, spark.createDataFrame([row("a", 1, ["x"]), row("b", 1, ["x", "y"])], LOG), "one")
    before, late = counts(store), spark.createDataFrame([row("a", 2, ["y"]), row("b", 0 + 1, ["old"])], LOG)
    for step in ("_write", "_merge_counts", "_publish"):
        with monkeypatch.context() as m:
            real = getattr(store, step)

            def die(*args, real=real, step=step):
                if step == "_write":
                    real(*args)
                raise OSError("gone")

            m.setattr(store, step, die)
            with pytest.raises(OSError):
                frequency.deliver(store, late, "two")
        assert counts(store) == before and store.manifest()["number"] == 1
    assert frequency.deliver(store, late, "two")
    assert counts(store) == {("y", 2, 2, 2), ("x", 1, 1, 2)}


def test_scores_of_affected_pairs(spark):
    rng = random.Random(8)
    store = pairs.open_store(spark, fresh_path(spark, "t"), 4)
    last = {}
    for k in range(4):
        batch = {f"p{rng.randrange(25)}": [f"c{rng.randrange(9)}" for _ in range(rng.randrange(5))] for _ in range(9)}
        pairs.deliver(store, spark.createDataFrame([(i, D(2020, 1, 1 + k), t) for i, t in batch.items()], "id string, at timestamp, items array<string>"), str(k))
        last |= {i: sorted(set(t)) for i, t in batch.items()}
        n_ab, n_a = Counter(), Counter()
        for items in last.values():
            n_a.update(items)
            n_ab.update(itertools.combinations(items, 2))
        got = {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n) for r in pairs.associations(store).collect()}
        assert got == {(a, b, x, n_a[a], n_a[b], len(last)) for (a, b), x in n_ab.items()}


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    log, last = [], {}
    for i in range(60):
        for v in range(rng.randrange(1, 3)):
            items = [f"c{rng.randrange(7)}" for _ in range(rng.randrange(6))]
            log.append((f"p{i}", D(2020, 1, 1 + v), items))
            last[f"p{i}"] = sorted(set(items))
    log += [("n", D(2020, 1, 1), None), (None, D(2020, 1, 1), ["c1", "c2"])]
    last["n"] = []
    store = pairs.open_store(spark, fresh_path(spark, "t"), 4)
    store.merge(pairs.pair_deltas_of_log(spark.createDataFrame(log, "id string, at timestamp, items array<string>")))
    n_ab, n_a = Counter(), Counter()
    for items in last.values():
        n_a.update(items)
        n_ab.update(itertools.combinations(items, 2))
    got = {(r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n) for r in pairs.associations(store).collect()}
    assert got == {(a, b, k, n_a[a], n_a[b], len(last)) for (a, b), k in n_ab.items()}
    strong = {(r.item_a, r.item_b) for r in pairs.strong(pairs.associations(store), 1).collect()}
    assert strong == {(a, b) for (a, b), k in n_ab.items() if k * len(last) >= n_a[a] * n_a[b]}


def test_empty_tables(spark):
    store = pairs.open_store(spark, fresh_path(spark, "t"))
    store.merge(pairs.pair_deltas_of_log(spark.createDataFrame([], "id string, at timestamp, items array<string>")))
    assert pairs.associations(store).count() == 0


def test_codes_short_and_long_alias_tables(spark):
    df = spark.createDataFrame([(1, [" A.b  c", None, "", "X"]), (2, None), (3, [])], "id int, categories array<string>").withColumn("term", F.lit("clash"))
    small = spark.createDataFrame([("x", "Y.y"), ("X", "z"), (None, "q"), ("q", None)], "alias string, canonical string")
    want = {1: ["a.b", "c", "y.y"], 2: [], 3: []}
    assert {r.id: r.to for r in codes.with_codes(df, small, "categories", "to").collect()} == want
    large = small.unionByName(spark.range(400).select(F.concat(F.lit("w"), "id").alias("alias"), F.lit("v").alias("canonical")))
    assert {r.id: r.to for r in codes.with_codes(df, large, "categories", "to").collect()} == want
