"""Directional scan with a rolling reference: the one stateful operator.

For each key, frames come in order; a frame is compared with the mean of the last ``size`` frames of its chunk
(the window is cleared when a chunk begins), and a warm start decays from frame to frame. State is the window, the
warm start and the last frame's number, bounded by ``size`` whatever the stream's length. The batch form is one plan of
window expressions with the same rows.

Late frames: a frame whose number is not above the last one of its key comes too late for the windows that it belongs
to; it is dropped and counted in ``late`` of the key's next row, in the batch form (where only repeated numbers can be
late) as in the stream. With ``ts``, a timestamp column, a watermark drops what is later than ``delay`` before any
state is touched, and a key's state is removed when the watermark has passed its last frame by ``idle``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "site long, t long, chunk long, reference double, residual double, warm double, late long"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = "window array<double>, chunk long, warm double, last long, late long"
EMPTY = ((), -1, 0.0, None, 0)


def advance(state: tuple, t: int, v: float, size: int, chunk: int, decay: float) -> tuple[tuple, tuple | None]:
    """(window, chunk, warm, last, late) and a frame -> the next state and the frame's row, none for a late frame."""
    window, now, warm, last, late = state
    if last is not None and t <= last:
        return (window, now, warm, last, late + 1), None
    if t // chunk != now:
        window, now = (), t // chunk
    total = 0.0  # plain additions, as the engine's average makes them: Python's sum() compensates
    for x in window:
        total += x
    reference = total / len(window) if window else v
    residual = v - reference - warm
    warm = decay * (v - reference)  # decay times (warm + residual)
    return ((*window, v)[-size:], now, warm, t, 0), (t, now, reference, residual, warm, late)


def _rows(site: int, state: tuple, pdf: pd.DataFrame, size: int, chunk: int, decay: float) -> tuple[tuple, pd.DataFrame]:
    out = []
    for t, v in zip(pdf["t"].tolist(), pdf["v"].tolist(), strict=True):
        state, row = advance(state, int(t), float(v), size, chunk, decay)
        if row:
            out.append((site, *row))
    return state, pd.DataFrame(out, columns=NAMES)


def scan_batch(frames: DataFrame, size: int = 5, chunk: int = 10, decay: float = 0.7) -> DataFrame:
    """frames: (site, t, v), as window expressions over one sort by site and frame.

    A step's warm start is decay times the frame's own distance from its reference, whatever the warm start before it,
    so nothing has to be carried from frame to frame but the window and one value of the frame before."""
    rows = frames.select(F.col("site").cast("long").alias("site"), F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))
    same = Window.partitionBy("site", "t")
    rows = rows.withColumn("k", F.row_number().over(same.orderBy("v"))).withColumn("n", F.count("*").over(same)).where("k = 1")
    order = Window.partitionBy("site").orderBy("t")
    rows = rows.withColumn("chunk", F.floor(F.col("t") / chunk)).withColumn("late", F.coalesce(F.lag("n").over(order) - 1, F.lit(0)))
    before = Window.partitionBy("site", "chunk").orderBy("t").rowsBetween(-size, -1)
    rows = rows.withColumn("reference", F.coalesce(F.avg("v").over(before), F.col("v")))
    start = F.coalesce(F.lag("warm").over(order), F.lit(0.0))
    rows = rows.withColumn("warm", decay * (F.col("v") - F.col("reference"))).withColumn("residual", F.col("v") - F.col("reference") - start)
    return rows.select(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in OUT.split(", "))))


def scan_stream(frames: DataFrame, size: int = 5, chunk: int = 10, decay: float = 0.7, ts: str | None = None, delay: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """The same over a stream; frames of one micro-batch are put in order, those of a later one come after."""
    seconds = pd.Timedelta(idle).total_seconds()

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = EMPTY
        if state.exists:
            window, *rest = state.get
            now = (tuple(window), *rest)
        pdf = pd.concat(list(batches)).sort_values(["t", "v"])
        now, out = _rows(int(key[0]), now, pdf, size, chunk, decay)
        state.update((list(now[0]), *now[1:]))
        if ts:
            state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(seconds * 1000))
        if len(out):
            yield out

    rows = frames.select("site", "t", "v")
    if ts:
        rows = frames.select("site", "t", "v", F.col(ts).alias("ts")).withWatermark("ts", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.groupBy("site").applyInPandasWithState(run, OUT, STATE, "append", timeout)
