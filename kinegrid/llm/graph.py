"""Connected components of a link table, with each round's table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.components import contract
from .common import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node."""

    def store(df: DataFrame, turn: int) -> DataFrame:
        out = scratch.write(df, f"{label}-{turn}")
        if turn:
            scratch.drop(f"{label}-{turn - 1}")
        return out

    return contract(links, store)
