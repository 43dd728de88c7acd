"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. All blocks are sorted and each distinct
one gets its rank as its name; adjacent names are then paired and the pairs named in the same way, level
by level, until one name is left for each document. Names come from comparing the blocks themselves, so
two documents of one level share a name if and only if their texts are equal. (Blocks are sorted by a 128-bit
hash and then by content: ranges are cut at hashes, which are short. Two blocks that differ under one hash
would stop the run; they can't share a name.)

Sorting is by range over (hash, row), so copies of one hot block spread over many tasks; what joins two
ranges is one summary row a task. Groups that hold more than a thousandth of all rows, a thousand at most, meet their
rows by a broadcast, so no key of the last join has more rows than that. Each level is written to the shared folder and holds half the rows of
the one before.

Texts are cut up in slices of 8 MiB or one text, so the longest text bounds a task's memory.

Cases: null text counts as empty, and all empty texts are equal; only A-Z is lower-cased; a row is a
document of its own even if its id occurs again (then rows of one id are kept or dropped together);
an empty table gives no rows; further columns are ignored; a null id is smaller than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, Scratch, slices, utf8

BLOCK = 4096
MANY = 1000


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(row, doc_id, i, value, blocks, sha256): the blocks of each normalised text, one at least; sha256 with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text", 8 << 20):
                data, offsets = utf8(some.column("text"))
                data = ASCII_LOWER[data]
                size = np.diff(offsets)
                count = np.maximum(1, -(-size // block))
                of = np.repeat(np.arange(len(size)), count)
                i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                cut = np.append(offsets[of] + i * block, offsets[-1])
                raw = memoryview(data)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                value = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
                first = pa.array(np.where(i == 0, of, -1))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row").take(pa.array(of)), some.column("doc_id").take(pa.array(of)), pa.array(i), value.cast(pa.binary()),
                        pa.array(count[of]), pa.array(sha, pa.string()).take(pc.if_else(pc.less(first, 0), None, first)),
                    ],
                    names=["row", "doc_id", "i", "value", "blocks", "sha256"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, i long, value binary, blocks long, sha256 string")


def _named(rows: DataFrame, values: list[str], scratch: Scratch, label: str, hashed: bool = False) -> DataFrame:
    """The rows with ``name``, the dense rank of their values among all rows, in place of the values.

    A task ranks its sorted range; the last of its output says where the range begins and ends, and a
    running sum over these summaries (a row for each task) turns local ranks into global ones.
    """
    keep = [c for c in rows.columns if c not in values]
    kinds = dict(rows.dtypes)
    edges = [f"{side}_{v}" for v in values for side in ("first", "last")]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "part long, local long, distinct long", *(f"{e} {kinds[e.split('_', 1)[1]]}" for e in edges)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, first, last, out = TaskContext.get().partitionId(), -1, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(v) for v in values]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            head = [c[0].as_py() for c in columns]
            new[0] = head != last
            first = head if first is None else first
            if hashed:
                same = np.ones(batch.num_rows, bool)
                for c in (batch.column("h1"), batch.column("h2")):
                    same[1:] &= pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                if (same & new)[1:].any():
                    raise ValueError("two blocks differ under one hash")
            last = [c[-1].as_py() for c in columns]
            local = rank + np.cumsum(new)
            rank = int(local[-1])
            out = batch.schema
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([part] * n, pa.int64()), pa.array(local), pa.nulls(n, pa.int64()), *(pa.nulls(n, out.field(e.split("_", 1)[1]).type) for e in edges)],
                names=[*keep, "part", "local", "distinct", *edges],
            )
        if first is not None:
            ends = [x for pair in zip(first, last, strict=True) for x in pair]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, out.field(c).type) for c in keep), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([rank + 1], pa.int64()), *(pa.array([x], out.field(e.split("_", 1)[1]).type) for x, e in zip(ends, edges, strict=True))],
                names=[*keep, "part", "local", "distinct", *edges],
            )

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = ["h1", "h2"] if hashed else []
    if hashed:
        rows = rows.select("*", F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2"))
    ranges = [*(hashes or values), "row", "i"]
    done = scratch.write(rows.repartitionByRange(n, *ranges).sortWithinPartitions(*hashes, *values, "row", "i").mapInArrow(run, schema), label)
    ends = done.where("distinct is not null")
    order = Window.orderBy("part")  # a row for each task
    same = F.lit(True)
    sides = [[F.col(f"{side}_{v}") for v in values] for side in ("first", "last")]
    for v in values:
        same = same & F.col(f"first_{v}").eqNullSafe(F.lag(f"last_{v}").over(order))
    shared = F.when(same & F.lag("part").over(order).isNotNull(), 1).otherwise(0)
    if hashed:
        clash = ~same
        for seed in ([], [F.lit(1)]):
            clash = clash & (F.xxhash64(*seed, *sides[0]) == F.lag(F.xxhash64(*seed, *sides[1])).over(order))
        shared = F.when(clash, F.raise_error(F.lit("two blocks differ under one hash")).cast("int")).otherwise(shared)
    ends = ends.select("part", "distinct", shared.alias("shared"))
    base = F.sum("distinct").over(order) - F.col("distinct") - F.sum("shared").over(order)
    ends = scratch.write(ends.select("part", base.alias("base")), f"{label}-bases")
    rows = done.where("distinct is null").join(F.broadcast(ends), "part")  # as many rows as there were tasks
    return rows.select(*keep, (F.col("base") + F.col("local")).alias("name"))


def identities(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, level, name, sha256): rows with the same level and name have equal normalised texts."""
    scratch = Scratch(spark, "exact")
    blocks = scratch.write(_blocks(docs, block), "blocks")  # read twice: by the sampling of ranges and by the sort
    named = _named(blocks, ["value"], scratch, "level0", hashed=True)
    scratch.drop("blocks")
    heads = named.where("i = 0").select("row", "doc_id", "sha256", "blocks", "name")
    most = heads.agg(F.max("blocks")).first()[0] or 1
    done = heads.where("blocks = 1").select("row", F.lit(0).alias("level"), "name")
    rows = named.where("blocks > 1").select("row", "i", "blocks", "name")
    level = 0
    while most > 1:
        level += 1
        most = -(-most // 2)
        side = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = rows.groupBy("row", F.expr("i div 2").alias("j")).agg(
            F.ceil(F.max("blocks") / 2).alias("blocks"), side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")
        )
        pairs = pairs.select("row", F.col("j").alias("i"), "blocks", "left", "right")
        named = _named(pairs, ["left", "right"], scratch, f"level{level}")
        done = done.unionByName(named.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        rows = named.where("blocks > 1")
    return heads.select("row", "doc_id", "sha256").join(done, "row")


def groups(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest doc_id stays."""
    scratch = Scratch(spark, "exact-groups")
    rows = scratch.write(identities(spark, docs, block), "identities")
    key = ["level", "name"]
    same = rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same = scratch.write(same, "same")
    # a group of more than a part of MANY of all rows is hot; there are MANY at most, so they are broadcast
    large = F.col("group_size") * MANY > rows.count()
    hot = F.broadcast(same.where(large))
    rest = rows.join(hot.select(*key), key, "left_anti").join(same.where(~large), key, "left")  # documents alone meet nothing
    rows = rows.join(hot, key).unionByName(rest)
    keep = F.coalesce("keep_id", "doc_id")
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256"))
