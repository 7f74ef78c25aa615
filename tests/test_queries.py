from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
CHEAP = "parse_quality alias_normalise prune_inverse pages_with_categories ppmi cosine_topk render_response p5_found p3_found".split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, D)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((plain(r) for r in df.select(*cols).collect()), key=key) == sorted((plain(r) for r in cur.fetchall()), key=key)


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
