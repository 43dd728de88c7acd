"""Plans whose shape must hold at sizes that tests don't reach: what is broadcast, what is shuffled."""

import random
import re

import duckdb
import pytest

from kinegrid.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_intervals_are_not_broadcast(spark, sf_dir):
    plan = plan_of(registry.queries()["reference_intervals"](spark, sf_dir))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_the_index_broadcasts_no_side(spark, sf_dir):
    plan = plan_of(registry.queries()["hyperstack_index"](spark, sf_dir))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["offset_curve", "gradient_offset_curve"])
def test_pixels_are_dealt_once_by_stack(spark, sf_dir, name):
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(registry.queries()[name](spark, sf_dir)))
    assert dealt and all(re.fullmatch(r"stack#\d+L?", x) for x in dealt)


def test_offsets_of_uneven_vectors(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [None if i % 7 == 3 and p == 2 else rng.random() for p in range(4 + i % 3)], 0) for i in range(70)]
    rows[40] = (40, None, 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("offset_curve", "gradient_offset_curve"):
        got = registry.queries()[name](spark, str(tmp_path)).select("moving", "z0", "score").collect()
        want = con.execute(f"select moving, z0, score from ({registry.oracle_sql()[name]})").fetchall()
        assert len(got) > 3 and sorted(map(tuple, got)) == sorted(want)
