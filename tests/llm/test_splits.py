import random
from collections import Counter, defaultdict

import pytest

from grovekit.llm import splits


def brute(records):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for kind, i, ks in records:
        ks = [k for k in ks or [] if k is not None]
        for k in ks:
            a, b = find((kind, ks[0])), find((kind, k))
            up[max(a, b)] = min(a, b)
    return {(kind, i): find((kind, min(k for k in ks if k is not None)))[1] for kind, i, ks in records if any(k is not None for k in ks or [])}


@pytest.mark.parametrize("limit", [splits.TASK_LINKS, 0])
def test_groups_against_union_find(spark, limit):
    rng = random.Random(6)
    rec = [(kind, f"r{i}", [f"k{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]) for kind in ("a", "b") for i in range(50)]
    rec += [("a", "hot%d" % i, ["hot", None]) for i in range(40)] + [("a", "null", None)]
    want = brute(rec)
    size = Counter((k, g) for (k, _), g in want.items())
    got = splits.groups(spark.createDataFrame(rec, "kind string, id string, keys array<string>"), limit).collect()
    assert {(r.kind, r.id): (r.group_key, r.group_size) for r in got} == {(k, i): (g, size[k, g]) for (k, i), g in want.items()}


def test_long_chain_of_links(spark):
    rec = [("a", f"{i:03d}", [f"{i:03d}", f"{i + 1:03d}"]) for i in range(150)]
    for limit in (splits.TASK_LINKS, 0):
        assert {r.group_key for r in splits.groups(spark.createDataFrame(rec, "kind string, id string, keys array<string>"), limit).collect()} == {"000"}


def test_quotas_largest_first_and_in_bulk():
    out = dict(splits.quotas([(50, 1), (10, 3), (1, 20)], (0.8, 0.1, 0.1)))
    assert out[50] == [1, 0, 0] and sum(map(sum, out.values())) == 24
    tot = [sum(s * q[i] for s, q in out.items()) for i in range(3)]
    assert tot == [80, 10, 10]
    big = dict(splits.quotas([(1, 1_000_000)], (0.8, 0.1, 0.1)))[1]
    assert big == [800_000, 100_000, 100_000]


def test_assign_keeps_groups_whole(spark):
    rng = random.Random(1)
    g = [(f"g{i}", rng.choice([1, 1, 1, 2, 9])) for i in range(300)]
    rows = splits.assign(spark.createDataFrame(g, "group string, group_size long"), (0.8, 0.1, 0.1), ("train", "validation", "test"), 8).collect()
    assert len(rows) == 300 and len({r.group for r in rows}) == 300
    by = defaultdict(int)
    for r in rows:
        by[r.split] += r.group_size
    total = sum(s for _, s in g)
    assert abs(by["train"] - 0.8 * total) <= 9 and abs(by["test"] - 0.1 * total) <= 9
    assert splits.assign(spark.createDataFrame([], "group string, group_size long"), (1,), ("train",)).count() == 0
