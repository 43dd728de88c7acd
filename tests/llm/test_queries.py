"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from kinegrid.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = Q.queries()[name](spark, sf_dir)
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_names():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 13)]
