import os

import pytest

import __spark_entry__
from ontoflow import catalog
from ontoflow.operators.lower import scores
from ontoflow.plans.ir import path_pattern
from ontoflow.sources.random_graph import random_graph, random_path

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(tuple(r)) for r in df.select(*columns).collect())
    want = duck.execute(catalog.oracle_sql()[name])
    have = [d[0] for d in want.description]
    assert sorted(have) == columns
    order = [have.index(c) for c in columns]
    assert got == sorted(plain(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_random_graph_is_seeded(spark):
    a, b = (random_graph(spark, 50, 3, 4, 2.0, seed=5) for _ in range(2))
    assert sorted(map(tuple, a.edges.collect())) == sorted(map(tuple, b.edges.collect())) and a.edges.count() == 300
    dag, root = path_pattern(random_path(5, 3, 4, seed=1))
    got = [r.x for r in scores(a, dag, {"x": root}).collect()]
    assert len(got) == 50 and 0 <= min(got) and max(got) <= 1
