"""A scan that starts from the middle of a recording and runs both ways, seeded by a batch table.

A block in the middle of a recording is processed as a batch; its last values are the first window of both directions.
Steps then count away from the block. A chunk's reference is the mean of the ``size`` last corrected values before it,
computed once; inside a chunk the motion follows a frame's distance from the reference, smoothed from step to step, and
the corrected value is the frame's less its motion. Each chunk's reference rests on the corrections of the one before,
so the scan is sequential in each direction of a recording and parallel over recordings.

As a stream it keeps, for each site and direction, the window, the reference and the step that comes next, and frames
that came before their turn, so that rows and their values don't depend on how frames are cut into micro-batches, nor on
their order in them. One that comes after its turn is dropped. A frame that is missing is waited for; with ``patience``
(milliseconds) no longer than that, by a timer, and then passed over. With ``idle`` (milliseconds) a site that hears
nothing for so long loses its states. Both go by the clock, so such a query is one that keeps running: one that is to end
with what is available takes neither. The seeds are the query's initial state; keys without a seed begin with their first
frame as reference.

A call into the state store costs far more than a site's few steps, so the states (list states, with time to live) are
those of up to ``BUNDLE`` neighbouring sites in a direction: each is read and written once a micro-batch for all of them.

The session's state store must be RocksDB's, which ``with_rocksdb`` sets for as long as a query takes to start.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "site long, direction long, step long, chunk long, reference double, motion double, corrected double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def mean(values: list[float]) -> float:
    total = 0.0  # plain additions, in order: the engine's average adds so as well
    for v in values:
        total += v
    return total / len(values)


def advance(window: list[float], carry: tuple, step: int, v: float, size: int, chunk: int, decay: float) -> tuple[list[float], tuple, tuple]:
    """The window, (next step, chunk, reference, motion) and a frame -> the same after it, and the frame's row."""
    _, now, reference, motion = carry
    if step // chunk != now:
        now, reference, window = step // chunk, mean(window) if window else v, []
    motion = decay * motion + (1 - decay) * (v - reference)
    corrected = v - motion
    return [*window, corrected][-size:], (step + 1, now, reference, motion), (step, now, reference, motion, corrected)


START = (0, -1, 0.0, 0.0)
BITS = 6
BUNDLE = 1 << BITS  # sites of a state


class Scan(StatefulProcessor):
    def __init__(self, size: int, chunk: int, decay: float, patience: int | None, idle: int | None):
        self.size, self.chunk, self.decay, self.patience, self.idle = size, chunk, decay, patience, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "site long, v double", self.idle)
        self.early = handle.getListState("early", "site long, step long, v double", self.idle)
        self.carries = handle.getListState("carries", "site long, next long, chunk long, reference double, motion double, heard long", self.idle)

    def now(self, timerValues) -> int:
        return 0 if self.patience is None and self.idle is None else timerValues.getCurrentProcessingTimeInMs()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A row for each site of the bundle: the seed's last values, the latest first."""
        sites, now = initialState["site"].tolist(), self.now(timerValues)
        window = [(site, float(v)) for site, last in zip(sites, initialState["last"], strict=True) for v in reversed(list(last))]
        self.windows.appendList(window)
        self.carries.appendList([(site, *START, now) for site in sites])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carries, windows, early = self.load(self.now(timerValues))
        heard = set()
        for pdf in rows:
            for site, step, v in sorted(zip(pdf["site"].tolist(), pdf["step"].tolist(), pdf["v"].tolist(), strict=True), reverse=True):
                early.setdefault(site, {})[int(step)] = float(v)  # of repeated steps the least value
                heard.add(site)
        yield from self.go(key, carries, windows, early, heard, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.now(timerValues)
        carries, windows, early = self.load(now)
        over = {site for site in early if carries[site][1] + self.patience <= now}
        yield from self.go(key, carries, windows, early, over, timerValues, True)

    def load(self, now: int) -> tuple[dict[int, tuple], dict[int, list[float]], dict[int, dict[int, float]]]:
        """By site: (carry, when it was heard), window, waiting frames; of those that were heard in time."""
        carries = {r[0]: (tuple(r[1:5]), r[5]) for r in self.carries.get() if self.idle is None or now < r[5] + self.idle}
        windows, early = {}, {}
        for site, v in self.windows.get() if carries else ():
            if site in carries:
                windows.setdefault(site, []).append(v)
        for site, step, v in self.early.get() if carries else ():
            if site in carries:
                early.setdefault(site, {})[step] = v
        return carries, windows, early

    def go(self, key, carries: dict, windows: dict, early: dict, sites: set[int], timerValues, skip: bool) -> Iterator[pd.DataFrame]:
        """Frames of the sites whose turn has come, a site's first of them whatever its step if the wait is over."""
        now, out = self.now(timerValues), []
        for site in sorted(sites):
            (carry, _), window, frames = carries.get(site, (START, 0)), windows.get(site, []), early.pop(site)
            first = skip
            for step in sorted(frames):
                if step > carry[0] and not first:
                    break
                v = frames.pop(step)
                if step >= carry[0]:
                    window, carry, row = advance(window, carry, step, v, self.size, self.chunk, self.decay)
                    out.append((site, int(key[1]), *row))
                    first = False
            carries[site], windows[site] = (carry, now), window
            if frames:
                early[site] = frames
        self.save(carries, windows, early, now)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def save(self, carries: dict, windows: dict, early: dict, now: int) -> None:
        for state, rows in (
            (self.carries, [(site, *carry, heard) for site, (carry, heard) in carries.items()]),
            (self.windows, [(site, v) for site, window in windows.items() for v in window]),
            (self.early, [(site, *frame) for site, frames in early.items() for frame in sorted(frames.items())]),
        ):
            state.put(rows) if rows else state.clear()
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if early:
                self.handle.registerTimer(min(carries[site][1] for site in early) + self.patience)


def steps(frames: DataFrame, middle: tuple[int, int]) -> DataFrame:
    """(site, direction, step, v) of (site, t, v): frames by their distance from the block [first, after), 1 ahead and -1 back."""
    ahead = F.col("t") >= middle[1]
    rows = frames.where((F.col("t") < middle[0]) | ahead)
    step = F.when(ahead, F.col("t") - middle[1]).otherwise(middle[0] - 1 - F.col("t"))
    return rows.select(F.col("site").cast("long").alias("site"), F.when(ahead, 1).otherwise(-1).cast("long").alias("direction"), step.cast("long").alias("step"), F.col("v").cast("double").alias("v"))


def seeds(frames: DataFrame, middle: tuple[int, int]) -> DataFrame:
    """(site, direction, i, v): the block's frames in the order in which each direction leaves it."""
    block = frames.where((F.col("t") >= middle[0]) & (F.col("t") < middle[1]))
    way = F.explode(F.array(F.lit(1).cast("long"), F.lit(-1).cast("long"))).alias("direction")
    return block.select(F.col("site").cast("long").alias("site"), way, "t", F.col("v").cast("double").alias("v")).select("site", "direction", (F.col("t") * F.col("direction")).cast("long").alias("i"), "v")


def scan_stream(frames: DataFrame, seed: DataFrame, size: int = 3, chunk: int = 5, decay: float = 0.7, patience: int | None = None, idle: int | None = None) -> DataFrame:
    """A stream of (site, direction, step, v), with the batch table ``seed`` (site, direction, i, v) as initial state."""
    bundle, by = F.shiftright("site", BITS).alias("bundle"), ["bundle", "direction"]
    rows = frames.select(bundle, "direction", "site", "step", "v").groupBy(*by)
    latest = F.slice(F.sort_array(F.collect_list(F.struct("i", "v")), asc=False), 1, size)["v"].alias("last")
    initial = seed.groupBy("site", "direction").agg(latest).select(bundle, "direction", "site", "last").groupBy(*by)
    mode = "none" if patience is None and idle is None else "processingTime"
    return rows.transformWithStateInPandas(Scan(size, chunk, decay, patience, idle), OUT, "append", mode, initial)


def scan_batch(frames: DataFrame, seed: DataFrame, size: int = 3, chunk: int = 5, decay: float = 0.7) -> DataFrame:
    """The same rows from a table, in which a step that is missing is passed over; a direction of a recording is one task,
    as its definition asks."""

    def run(key, frames: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        window, carry, out = seed.sort_values("i")["v"].tolist()[-size:], START, []
        for step, v in frames.sort_values(["step", "v"])[["step", "v"]].itertuples(index=False):
            if step >= carry[0]:
                window, carry, row = advance(window, carry, int(step), float(v), size, chunk, decay)
                out.append((*key, *row))
        return pd.DataFrame(out, columns=NAMES)

    by = ["site", "direction"]
    return frames.groupBy(*by).cogroup(seed.groupBy(*by)).applyInPandas(run, OUT)


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
