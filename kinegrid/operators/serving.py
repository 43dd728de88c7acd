"""Typed parameters of image queries, and plane queries up to display levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm, stretch


class BadParameter(ValueError):
    """A parameter that is unknown, missing or out of range; it is named, and no default takes its place."""

    def __init__(self, name: str, why: str):
        super().__init__(f"{name}: {why}")
        self.name = name


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    default: object = None
    required: bool = False


def parse(given: dict[str, str], allowed: list[Parameter]) -> dict[str, object]:
    known = {p.name: p for p in allowed}
    for name in given:
        if name not in known:
            raise BadParameter(name, "unknown parameter")
    out = {}
    for p in allowed:
        if p.name not in given:
            if p.required:
                raise BadParameter(p.name, "missing")
            out[p.name] = p.default
            continue
        try:
            value = {"0": False, "1": True}[given[p.name]] if p.kind is bool else p.kind(given[p.name])
        except (ValueError, KeyError):
            raise BadParameter(p.name, f"not a {p.kind.__name__}") from None
        if p.choices and value not in p.choices:
            raise BadParameter(p.name, f"not one of {p.choices}")
        if value != value or p.low is not None and value < p.low or p.high is not None and value > p.high:
            raise BadParameter(p.name, "out of range")
        out[p.name] = value
    return out


def plane(field: DataFrame, frame: int, quantity: str = "mag", low: float = 1.0, high: float = 99.0, stride: int = 1) -> DataFrame:
    """(x, y, v, level): one frame's component or norm, with levels 0..255 between two percentiles; an empty frame raises."""
    of = {"dx": F.col("dx"), "dy": F.col("dy"), "mag": norm(F.col("dx"), F.col("dy"))}
    if quantity not in of:
        raise BadParameter("quantity", f"not one of {sorted(of)}")
    rows = field.where(F.col("t") == frame).where((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).select("x", "y", of[quantity].alias("v"))
    lim = rows.agg(F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    if lim.first()["p"] is None:  # one row
        raise BadParameter("frame", f"there is no frame {frame}")
    return rows.join(F.broadcast(lim)).select("x", "y", "v", F.rint(stretch(F.col("v"), F.col("p")[0], F.col("p")[1], 255.0)).cast("int").alias("level"))


def select(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of a selection set (one column of ids)."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def arrows(cells: DataFrame, stride: int, scale: float) -> DataFrame:
    """(x, y, x1, y1, hue): arrows of every stride-th cell of (x, y, dx, dy); hue is the direction in degrees."""
    rows = cells.where((F.col("x") % stride == 0) & (F.col("y") % stride == 0))
    hue = (F.degrees(F.atan2("dy", "dx")) + 360.0) % 360.0
    return rows.select("x", "y", (F.col("x") + scale * F.col("dx")).alias("x1"), (F.col("y") + scale * F.col("dy")).alias("y1"), hue.alias("hue"))


def montage(cells: DataFrame, t: str, columns: int, width: int, height: int) -> DataFrame:
    """Adds row, column and the place (mx, my) of each cell's tile, frames in order. The frames are numbered, not the cells."""
    # a row for each frame
    k = cells.select(t).distinct().withColumn("_kg_k", F.row_number().over(Window.orderBy(t)) - 1)
    k = k.select(t, F.floor(F.col("_kg_k") / columns).alias("row"), (F.col("_kg_k") % columns).cast("long").alias("column"))
    return cells.join(k, t).withColumn("mx", F.col("column") * width + F.col("x")).withColumn("my", F.col("row") * height + F.col("y"))


def blend(cells: DataFrame, a: str, b: str, part: float) -> DataFrame:
    """Adds the blended level and whether the two layers differ by more than half of 255."""
    return cells.withColumn("level", (1 - part) * F.col(a) + part * F.col(b)).withColumn("apart", F.abs(F.col(a) - F.col(b)) > 127.5)
