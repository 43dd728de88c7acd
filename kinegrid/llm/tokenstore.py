"""Content-addressed store of token ids.

Rolling hashes over the last ``REACH`` ids cut each document's id stream into chunks (a cut where the hash has
its low bits zero, chunks of ``least`` to ``most`` ids), so equal passages give equal chunks wherever they stand.
A chunk's address is the SHA-256 of its bytes. The store is three sets of files under one root:

* ``chunks``: each unique chunk once (address, payload), bucketed by address;
* ``recipes``: in ascending doc_id order each document's addresses, its Merkle root and its place in the id stream;
* ``manifest``: for each range of recipes its documents, ids and Merkle root.

The reader recomputes chunk addresses, document roots and range roots and compares all three, then hands out ids
put together from the chunks. Chunks are counted and joined by address; a hot chunk is one row of the store and
its uses are split by Spark's skew join. Ids are little-endian, 16 bits wide where the vocabulary allows.

Cases: null and empty texts hold the end id alone; rows that repeat an id are kept apart by a row number and stand
in the order of their texts' roots; an empty table makes an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix, slices
from .tokens import WordLevel, encoder

#: On 0.1 GB of documents, chunks of 64 to 2048 ids at 1 mark in 256 leave 0.892 of the ids' bytes unique and take 0.060
#: of them for addresses; 128 to 4096 at 1 in 512 leave 0.904 and take 0.035, so the store as a whole is smaller.
REACH, BITS, LEAST, MOST = 8, 9, 128, 4096


def marks(ids: np.ndarray, reach: int = REACH, bits: int = BITS) -> np.ndarray:
    """Places after the ids at which the rolling hash of the last ``reach`` ids has its low bits zero."""
    h = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rolled = np.zeros(len(ids), np.uint64)
    for i in range(min(reach, len(ids))):  # each id's part is its hash times a power for its age
        rolled[i:] += h[: len(ids) - i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return np.flatnonzero(mix(rolled) & np.uint64((1 << bits) - 1) == 0) + 1


def cuts(found: list[int], lo: int, hi: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the document at [lo, hi), given marks; as least >= REACH no window leaves the document."""
    out, last, i = [], lo, 0
    while hi - last > least:
        while i < len(found) and found[i] < last + least:
            i += 1
        last = min(found[i] if i < len(found) else hi, last + most, hi)
        out.append(last)
    if last < hi:
        out.append(hi)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over 32-byte leaves; an odd one moves up alone; leaves and nodes are hashed under different prefixes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Roots:
    """The Merkle root of a stream of leaves, with one pending node for each level."""

    def __init__(self) -> None:
        self.pending: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = hashlib.sha256(b"\0" + leaf).digest()
        for i, left in enumerate(self.pending):
            if left is None:
                self.pending[i] = node
                return
            node, self.pending[i] = hashlib.sha256(b"\1" + left + node).digest(), None
        self.pending.append(node)

    def root(self) -> bytes:
        node = None
        for left in self.pending:
            if left is not None:
                node = left if node is None else hashlib.sha256(b"\1" + left + node).digest()
        return node or hashlib.sha256(b"").digest()


@dataclass
class Store:
    scratch: Scratch
    chunks: DataFrame  # bucketed by address
    width: int


def write_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> Store:
    """Encode every text, cut, and write chunks, recipes and manifest."""
    scratch = Scratch(spark, "tokenstore")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = encoder(WordLevel, tokenizer).dtype.itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordLevel, tokenizer)
        for batch in batches:
            for some in slices(batch, "text", 6 << 20):  # distinct units are looked up once a slice
                found, at = enc.column(some.column("text"))
                rows = len(at) - 1
                ids = np.full(len(found) + rows, end_id, enc.dtype)
                ids[np.arange(len(found)) + np.repeat(np.arange(rows), np.diff(at))] = found
                at = at + np.arange(rows + 1)
                data, places = ids.tobytes(), marks(ids)
                between = np.searchsorted(places, at).tolist()
                places, at = places.tolist(), at.tolist()
                out = []
                for i in range(rows):
                    lo, hi = at[i], at[i + 1]
                    ends = cuts(places[between[i] : between[i + 1]], lo, hi)
                    parts = [(a * width, b * width) for a, b in zip([lo, *ends], ends, strict=False)]
                    names = [hashlib.sha256(data[a:b]).digest() for a, b in parts]
                    out.append((hi - lo, data[lo * width : hi * width], [{"address": x, "at": a - lo * width, "size": b - a} for x, (a, b) in zip(names, parts, strict=True)], merkle(names)))
                n, data, parts, root = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("address", pa.binary()), ("at", pa.int32()), ("size", pa.int32())]))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n), pa.array(data), pa.array(parts, kind), pa.array(root)], names=["doc_id", "n_tokens", "ids", "parts", "root"])

    staged = scratch.write(rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, parts array<struct<address:binary,at:int,size:int>>, root binary"), "staged")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids before each document in its range, a number for each row, and a last row with the range's summary."""
        part, seen, number, roots = TaskContext.get().partitionId(), 0, 0, Roots()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            for x in batch.column("root").to_pylist():
                roots.add(x)
            k = len(n)
            before = seen + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_tokens", "addresses", "root")), pa.array([part] * k, pa.int64()), pa.array(np.arange(number, number + k)), pa.array(before), pa.nulls(k, pa.int64())],
                names=NAMES,
            )
            seen, number = seen + int(n.sum()), number + k
        if number:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([seen]), pa.nulls(1, pa.list_(pa.binary())), pa.array([roots.root()]), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([number])],
                names=NAMES,
            )

    NAMES = ["doc_id", "n_tokens", "addresses", "root", "part", "number", "before", "documents"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = staged.select("doc_id", "n_tokens", F.col("parts.address").alias("addresses"), "root").repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    scratch.write(listed.mapInArrow(place, "doc_id long, n_tokens long, addresses array<binary>, root binary, part long, number long, before long, documents long"), "recipes")
    ends = scratch.read("recipes").where("documents is not null")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    scratch.write(ends.select("part", "documents", "n_tokens", "root", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start")), "manifest")

    chunk = staged.select("ids", F.explode("parts").alias("c")).select(F.col("c.address").alias("address"), F.expr("substring(ids, c.at + 1, c.size)").alias("payload"))
    unique = chunk.groupBy("address").agg(F.first("payload").alias("payload"))
    table = f"chunks_{uuid.uuid4().hex}"
    (unique.write.bucketBy(n, "address").option("compression", "zstd").option("path", scratch.path("chunks")).format("parquet").saveAsTable(table))
    chunks = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of the catalog's entry only: the files and the plan with their buckets stay
    scratch.drop("staged")
    return Store(scratch, chunks, width)


def read_store(spark: SparkSession, store: Store, derive: Callable[[np.ndarray], object] | None = None, kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids, verified against addresses, roots and manifest.

    derive: what to hand out in place of the ids' bytes, computed from the ids where they are put together; kind: its type.
    """
    manifest = {r["part"]: (r["documents"], bytes(r["root"]), r["start"]) for r in store.scratch.read("manifest").collect()}  # a row for each range
    recipes = store.scratch.read("recipes").where("documents is null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole ranges in order: their roots must be the manifest's."""
        part, number, roots = None, 0, Roots()

        def done() -> None:
            if part is not None and (number, roots.root()) != manifest[part][:2]:
                raise ValueError(f"range {part} does not match the manifest")

        for batch in batches:
            for p, x in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist(), strict=True):
                if p != part:
                    done()
                    part, number, roots = p, 0, Roots()
                number += 1
                roots.add(x)
        done()
        yield pa.RecordBatch.from_arrays([pa.array([number])], names=["n"])

    recipes.select("part", "number", "root").repartition(n, "part").sortWithinPartitions("part", "number").mapInArrow(ranges, "n long").agg(F.sum("n")).collect()
    start = F.element_at(F.create_map(*[F.lit(x) for p, v in manifest.items() for x in (p, v[2])]), F.col("part")) if len(manifest) <= 64 else None
    listed = recipes
    if start is None:
        listed = recipes.join(F.broadcast(store.scratch.read("manifest").select("part", "start")), "part")
    elif manifest:
        listed = recipes.withColumn("start", start)
    else:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, ids {kind}")
    uses = listed.select("part", "number", F.posexplode("addresses").alias("i", "address"))
    held = uses.join(store.chunks, "address").select("part", "number", "i", "address", "payload")
    heads = listed.select("part", "number", F.lit(-1).alias("i"), F.col("root").alias("address"), F.lit(None).cast("binary").alias("payload"), "doc_id", "n_tokens", (F.col("start") + F.col("before")).alias("start"))
    rows = heads.unionByName(held, allowMissingColumns=True).repartition(n, "part", "number").sortWithinPartitions("part", "number", "i")
    width, to_arrow = store.width, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[kind]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, names, parts = None, [], []

        def close() -> tuple:
            root, doc_id, tokens, start = head
            ids = b"".join(parts)
            if merkle(names) != root or len(ids) != tokens * width:
                raise ValueError(f"document {doc_id} does not match its recipe")
            return doc_id, start, tokens, len(ids), derive(np.frombuffer(ids, f"<u{width}")) if derive else ids

        columns = ("i", "address", "payload", "doc_id", "n_tokens", "start")
        out, size = [], 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*r[:3], r[4]) for r in out], strict=True), (pa.int64(), pa.int64(), pa.int64(), to_arrow), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for i, address, payload, doc_id, tokens, start in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if i < 0:
                    if head:
                        out.append(close())
                        size += out[-1][3]
                    head, names, parts = (address, doc_id, tokens, start), [], []
                    continue
                if hashlib.sha256(payload).digest() != address:
                    raise ValueError("a chunk does not match its address")
                names.append(address)
                parts.append(payload)
            if size > 4 << 20:
                yield batch_of(out)
                out, size = [], 0
        if head:
            out.append(close())
        if out:
            yield batch_of(out)

    return rows.mapInArrow(rebuild, f"doc_id long, start long, n_tokens long, ids {kind}")


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian uint32."""
    return zlib.crc32(ids.astype("<u4").tobytes())
