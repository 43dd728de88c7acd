"""Mixture-controlled packing of token streams into windows of a fixed length.

Each source is a queue of its documents' ids in a fixed order. Queues are cut into packets of
``packet`` ids and served by deficit round-robin: a queue earns its share of every window, sends a
packet whenever its deficit covers one, and carries the rest into the next window. Windows are
scheduled in blocks; the deficits with which a block starts follow from the shares alone (packets in
the order of their due times), so any task can compute any block and the carry crosses partitions
without a sequential pass. What is left of each queue after its last whole packet goes, end to end,
into the windows after the others; only the very last window is not full.

The ``max_queues`` sources with the most documents and all that have targets are queues of their own; what sources
there are beyond share one more queue, whose part is the sum of theirs. So the driver and each task know a bounded
number of queues, and targets hold whatever the number of sources.

Two passes over the data, no shuffle of texts or ids: tokens are written once with their place in the
task's part of the queue, queue bases come from sums by task and queue, and the pieces follow.

Cases: null and empty texts have the end id alone; a null source is a queue of its own; an empty table
gives no rows; further columns are ignored; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, slices
from .tokens import ByteLevel, encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, queue string, ids binary"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Schedule:
    """Which packet of which queue goes where; a function of the queues' sizes and shares alone.

    totals: ids by queue; shares: a queue's part of every window while it lasts (its part of all ids
    by default). A queue that ends leaves its part to the others in proportion.
    """

    def __init__(self, totals: list[int], shares: list[float], window: int, packet: int, block: int = 256):
        self.window, self.packet, self.block = window, packet, block
        self.slots = window // packet
        self.full = np.array([t // packet for t in totals], np.int64)
        weight = np.array(shares, np.float64)
        weight[self.full == 0] = 0
        self.share = weight / weight.sum() if weight.sum() else weight
        self.packets = int(self.full.sum())
        rest = np.array([t % packet for t in totals], np.int64)
        self.rest_at = self.packets * packet + np.cumsum(rest) - rest
        self.plan = lru_cache(64)(self._plan)
        self.at = lru_cache(4096)(lambda b: self.served(b * self.block * self.slots))

    def _due(self, served: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(served < self.full, (served + 0.5) / self.share, np.inf)

    def served(self, k: int) -> np.ndarray:
        """Packets of each queue among the first k: those with the earliest due times, lower queues first."""
        k = min(k, self.packets)
        count = lambda t: np.minimum(self.full, np.floor(self.share * t + 0.5).astype(np.int64))
        lo, hi = 0.0, float(2 + 2 * (self.full.max(initial=0) / self.share[self.share > 0].min(initial=1)))
        for _ in range(200):
            mid = (lo + hi) / 2
            if not lo < mid < hi:
                break
            lo, hi = (mid, hi) if count(mid).sum() <= k else (lo, mid)
        out = count(lo)
        while out.sum() > k:  # a step of the float grid may hold several packets
            out[np.argmax(np.where(out > 0, (out - 0.5) / np.where(self.share > 0, self.share, 1), -1))] -= 1
        while out.sum() < k:
            out[np.argmin(self._due(out))] += 1
        return out

    def _plan(self, b: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """First packets, slots by packet, and deficits at the start of each window of block b."""
        k0 = b * self.block * self.slots
        first, end = self.served(k0), self.served(k0 + self.block * self.slots)
        left = (end - first).tolist()
        todo = sum(left)
        earn = (self.share * self.slots).tolist()
        deficit = (self.share * k0 - first).tolist()
        where: list[list[int]] = [[] for _ in left]
        carried, slot = [], k0
        while todo:
            room = min(self.slots, todo)
            carried.append(list(deficit))
            deficit = [d + e for d, e in zip(deficit, earn, strict=True)]
            for s in range(len(left)):  # one round: whatever a queue's deficit covers
                n = min(int(deficit[s]), left[s], room) if deficit[s] >= 1 else 0
                if n:
                    where[s].extend(range(slot, slot + n))
                    slot, room, todo, left[s], deficit[s] = slot + n, room - n, todo - n, left[s] - n, deficit[s] - n
            while room:  # the window is full before it is left: the queues that would earn a packet next
                s = min((i for i in range(len(left)) if left[i]), key=lambda i: ((1 - deficit[i]) / earn[i], i))
                where[s].append(slot)
                slot, room, todo, left[s], deficit[s] = slot + 1, room - 1, todo - 1, left[s] - 1, deficit[s] - 1
        return first, [np.array(w, np.int64) for w in where], np.array(carried)

    def block_of(self, s: int, p: int) -> int:
        """The block that serves packet p of queue s."""
        lo, hi = 0, -(-self.packets // (self.block * self.slots)) - 1
        if self.share[s] > 0 and hi > 0:  # near p's due time; widened until it holds
            guess = int(p / max(self.full[s], 1) * hi)
            step = 2
            lo, hi0 = max(0, guess - step), hi
            while lo and self.at(lo)[s] > p:
                step *= 2
                lo = max(0, guess - step)
            step, hi = 2, min(hi0, guess + 2)
            while hi < hi0 and self.at(hi + 1)[s] <= p:
                step *= 2
                hi = min(hi0, guess + step)
        return bisect_right(range(lo, hi + 1), p, key=lambda b: self.at(b)[s]) - 1 + lo

    def pieces(self, s: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(queue position, length, place) of the ids [lo, hi) of queue s, merged where they adjoin in a window."""
        g, w = self.packet, self.window
        end = int(self.full[s]) * g
        pos, at, n = lo, -1, 0
        while pos < min(hi, end):
            p = pos // g
            b = self.block_of(s, p)
            first, where, _ = self.plan(b)
            slots = where[s]
            i = p - int(first[s])
            last = min(len(slots), i + -(-(min(hi, end) - p * g) // g))
            for slot in slots[i:last].tolist():
                skip = pos % g
                take = min(g - skip, hi - pos)
                here = slot * g + skip
                if n and here == at + n and here % w:
                    n += take
                else:
                    if n:
                        yield pos - n, n, at
                    at, n = here, take
                pos += take
        if n:
            yield pos - n, n, at
        pos = max(lo, end)
        while pos < hi:
            here = int(self.rest_at[s]) + pos - end
            take = min(hi - pos, w - here % w)
            yield pos, take, here
            pos += take


REST, NULL = "\0rest", "\0null"  # queues of the remaining sources and of rows without a source


def tokenize(docs: DataFrame, scratch: Scratch, path: str, end_id: int, max_queues: int, named: Iterable[str] = ()) -> DataFrame:
    """(doc_id, queue, part, before, n, ids): ids of whole texts with the end id; before: ids of the queue
    ahead in the same task's output."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NULL))
    # max_queues + 1 rows at most
    first = [r["s"] for r in docs.groupBy(source.alias("s")).count().orderBy(F.desc("count"), "s").select("s").limit(max_queues + 1).collect()]
    queue = source if len(first) <= max_queues else F.when(source.isin(sorted({*first[:max_queues], *named})), source).otherwise(REST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteLevel, path)
        tail = np.array([end_id], enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, "text"):
                ids = [x + tail for x in enc.ids(some.column("text").to_pylist())]
                n = [len(x) // enc.dtype.itemsize for x in ids]
                before = []
                for q, k in zip(some.column("queue").to_pylist(), n, strict=True):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("queue").cast(pa.string()), pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "before", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text"))
    return scratch.write(rows.mapInArrow(run, "doc_id long, queue string, part long, before long, n long, ids binary"), "tokens")


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    packet: int = 128,
    targets: dict[str, float] | None = None,
    max_queues: int = 1024,
) -> DataFrame:
    """Pieces of documents (doc_id, source, text) by place: sequence ``sequence_id`` from ``offset``.

    targets: a source's part of every window (sources not named: 0.0 until all others are used up);
    by default its part of all ids. ``ids`` holds a piece's ids as little-endian uint32.
    """
    if window % packet:
        raise ValueError("window must be a multiple of packet")
    scratch = Scratch(spark, "pack")
    tokens = tokenize(docs, scratch, tokenizer, end_id, max_queues, targets or ())
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    sums = scratch.write(sums, "sums")
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.write(sums.select("queue", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "bases")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # max_queues and the targets at most
    names = sorted(totals)
    sizes = [totals[q] for q in names]
    shares = [float(t) for t in sizes] if targets is None else [targets.get(q, 0.0) or 1e-9 for q in names]
    index = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(sizes, shares, window, packet)
        for batch in batches:
            out: list[tuple] = []
            for doc, q, lo, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "lo", "n", "ids")), strict=True):
                data = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for pos, length, place in plan.pieces(index[q], lo, lo + n):
                    at = pos - lo
                    out.append((doc, at, length, n, place // window, place % window, q, data[4 * at : 4 * (at + length)]))
            if out:
                kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=NAMES)

    # bases: a row for each task and queue; its written size decides between broadcast and shuffle
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("lo"), "n", "ids")
    return placed.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, spans): padded ids of each window and the documents' places in it.

    A group holds one window, so its size is bounded; a window whose length is a power of two is not padded.
    """
    one = F.struct("offset", "length", "doc_id", "start", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = []
            for p in pdf["p"]:
                x = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in p]).astype(np.int64)
                ids.append(x if len(x) & (len(x) - 1) == 0 else np.pad(x, (0, window - len(x)), constant_values=pad_id))
            spans = [[{k: r[k] for k in ("doc_id", "offset", "length", "start")} for r in p] for p in pdf["p"]]
            yield pd.DataFrame({"sequence_id": pdf["sequence_id"], "input_ids": ids, "spans": spans})

    return rows.mapInPandas(run, "sequence_id long, input_ids array<long>, spans array<struct<doc_id:long,offset:long,length:long,start:long>>")
