"""A layout for planes: cells of a volume stored so that a plane of a frame is a few row groups of a file or two.

Frames and planes are dealt over files by range and sorted in them, planes before rows and columns, in row groups of at
most ``group`` rows. A condition on plane and frame then skips files and row groups by their statistics, and pages
by their indexes, before anything is decoded; in the order in which cells come, every row group has every plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = 50_000


def write_planes(cells: DataFrame, path: str, group: int = GROUP, files: int | None = None, frame: str = "t", plane: str = "z", across: tuple[str, ...] = ("y", "x")) -> None:
    """Cells in the layout, planes outermost: a plane over all frames, and a frame of it, lie together."""
    n = files or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartitionByRange(n, plane, frame, *across).sortWithinPartitions(plane, frame, *across)
    dealt.write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", group).option("parquet.page.row.count.limit", max(1, group // 4)).parquet(path)


def read_plane(spark: SparkSession, path: str, z: int, frames: tuple[int, int] | None = None, frame: str = "t", plane: str = "z") -> DataFrame:
    """The cells of a plane, of all frames or of those from the first to before the last."""
    found = spark.read.parquet(path).where(F.col(plane) == z)
    return found if frames is None else found.where((F.col(frame) >= frames[0]) & (F.col(frame) < frames[1]))


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of a table that was collected just now have decoded."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(int(m.apply("numOutputRows").value()) for m in found if m.contains("numOutputRows"))
