"""Queries that write with the library's sinks and read back: page stacks and the plane layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import fresh_folder
from ..sources import container as K
from ..sources import planes as P
from . import inputs as I
from .registry import register


def stored_stack(spark, sf_dir):
    """The volume of all years as a committed stack of pages, a file a year and a page a slice, read by page ranges."""
    root = fresh_folder(spark, "stack")
    cells = I.volume(spark, sf_dir).select("t", "z", F.lit(0).cast("long").alias("c"), "y", "x", F.col("v").alias("value"))
    K.write_stack(cells, root, 25, 40, deflate=True)
    return K.pixels(K.read_stack(spark, root, slices=7)).select("t", "z", "y", "x", S.r6(F.col("value")).alias("v"))


register("stored_stack", stored_stack, f"WITH {I.VOLUME} SELECT t, z, y, x, round(v, 6) AS v FROM volume")


def plane_layout(spark, sf_dir):
    """One plane of all years from the plane layout of the volume."""
    root = fresh_folder(spark, "planes")
    P.write_planes(I.volume(spark, sf_dir), root, 1000)
    return P.read_plane(spark, root, 3).select("t", "x", "y", S.r6(F.col("v")).alias("v"))


register("plane_layout", plane_layout, f"WITH {I.VOLUME} SELECT t, x, y, round(v, 6) AS v FROM volume WHERE z = 3")
