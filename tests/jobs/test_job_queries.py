"""The registered jobs against their SQL on the smallest tables, and what a call leaves behind."""

import duckdb
import pytest

from jobs import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    df = Q.queries()[name](spark, sf_dir)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall()), key=repr)
    after = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if before.get(k) != v} == {} and not spark.streams.active
    assert df.sparkSession.catalog.listTables() == []
