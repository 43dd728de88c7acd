"""Every registered plan against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from kinegrid.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0 if v else 0.0
    return tuple(map(clean, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(clean(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(clean(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernels_give_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len({repr(r) for r in rows}) == len(rows)
