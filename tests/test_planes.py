"""The plane layout: what a plane's scan decodes, against cells stored as they come."""

import pytest
from pyspark.sql import functions as F

from kinegrid.sources import planes as P

FRAMES, DEPTH, SIZE = 6, 20, 40


@pytest.fixture(scope="module")
def volume(spark):
    i = F.col("id")
    cells = spark.range(FRAMES * SIZE * SIZE * DEPTH, numPartitions=4)  # z fastest, as in a native (x, y, z) layout
    return cells.select(F.floor(i / (SIZE * SIZE * DEPTH)).alias("t"), (i % DEPTH).alias("z"), F.floor(i / (DEPTH * SIZE) % SIZE).alias("y"), F.floor(i / DEPTH % SIZE).alias("x"), (i % 97).cast("double").alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_plane_reads_its_own_row_groups(spark, volume, tmp_path):
    flat, layout = str(tmp_path / "flat"), str(tmp_path / "planes")
    volume.write.parquet(flat)
    P.write_planes(volume, layout, group=SIZE * SIZE // 4, files=5)
    plane = P.read_plane(spark, layout, 7)
    assert rows(plane) == rows(volume.where("z = 7")) and P.scanned_rows(plane) <= FRAMES * SIZE * SIZE * 1.5
    one = P.read_plane(spark, layout, 7, (2, 3))
    assert rows(one) == rows(volume.where("z = 7 and t = 2")) and P.scanned_rows(one) <= SIZE * SIZE * 1.5
    whole = spark.read.parquet(flat).where("z = 7 and t = 2")
    whole.collect()
    assert P.scanned_rows(whole) >= SIZE * SIZE * DEPTH  # every row group of the frame has every plane


def test_other_names_and_no_rows(spark, tmp_path):
    cells = spark.createDataFrame([(k, d, 1.0) for k in range(4) for d in range(3)], "frame int, depth int, v double")
    P.write_planes(cells, str(tmp_path / "a"), 2, 2, "frame", "depth", ())
    assert rows(P.read_plane(spark, str(tmp_path / "a"), 1, (1, 3), "frame", "depth")) == [(1, 1, 1.0), (2, 1, 1.0)]
    P.write_planes(cells.limit(0), str(tmp_path / "b"), frame="frame", plane="depth", across=())
    assert P.read_plane(spark, str(tmp_path / "b"), 1, None, "frame", "depth").collect() == []
