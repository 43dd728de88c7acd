"""Shared plumbing: the shared scratch folder, words told apart by their bytes, digests and hash mixing.

Every intermediate table goes to the folder that the cluster names in ``spark.checkpoint.dir``;
a lost executor then costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 21  # bytes of text hashed at once: bounds a worker's memory, not the text


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only in local mode without the setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinegrid-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


_ROOTS: list[str] = []  # of all runs of this driver that are not closed


def close(spark: SparkSession) -> None:
    """Remove the tables of all runs so far; results that were not written elsewhere can't be read any more."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one run under the shared folder, dropped one by one as soon as they are not needed.

    Results are lazy, so two settings hold for the session from here on, until it is stopped or they are set anew:
    shuffle files go when a write is done, and Arrow batches have fewer rows than by default.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        # shuffle files of a finished write are dead weight: the written table replaces them
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        # Python workers hold a batch at a time: texts are long, so fewer rows than the default 10000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Remove all tables of the run."""
        _delete(self.spark, self.root)
        if self.root in _ROOTS:
            _ROOTS.remove(self.root)


def carried(docs: DataFrame, carry: str | None):
    """A column (long) that an operator hands through as ``carry`` to tell rows of one id apart; null without one."""
    return (F.col(carry).cast("long") if carry else F.lit(None).cast("long")).alias("carry")


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows: those with the smallest hash of their key. A threshold goes first, so that the tasks
    together pass on about twice what is asked for and not n rows each."""
    h = F.xxhash64(F.col(key).cast("string"))
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.pmod(h, F.lit(1 << 32)) < int((1 << 32) * 2 * n / total))
    return rows.orderBy(h, key).limit(n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (len + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), pa.scalar("").cast(kind))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+`` by segment, with the segment's bounds.

    A segment ends at a separator or a row's end, so no word is cut and any length of text fits.
    """
    lo, n = 0, len(data)
    bounds = np.unique(offsets)
    while lo < n:
        hi = min(lo + SEGMENT, n)
        if hi < n:
            cut = np.flatnonzero(SEPARATOR[data[lo:hi]])
            row = bounds[np.searchsorted(bounds, hi, "right") - 1]
            best = max(lo + (cut[-1] + 1 if len(cut) else 0), row)
            if best <= lo:  # one word longer than a segment: take all of it
                later = np.flatnonzero(SEPARATOR[data[hi:]])
                best = min(hi + later[0] if len(later) else n, bounds[np.searchsorted(bounds, hi, "left")])
            hi = best
        sep = SEPARATOR[data[lo:hi]]
        first = np.zeros(hi - lo + 1, bool)
        inner = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo
        first[inner] = True
        first[0] = first[-1] = True
        start = ~sep
        start[1:] &= sep[:-1] | first[1:-1]
        end = ~sep
        end[:-1] &= sep[1:] | first[1:-1]
        yield np.flatnonzero(start) + lo, np.flatnonzero(end) + lo + 1, lo, hi
        lo = hi


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each span (ascending, none overlapping) among the different ones, and these, told apart byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    held = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(ends - starts))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary.to_pylist()


SHORT = 32  # bytes of a word that the tables know
#: two random numbers for each byte at each place, and for each length: fixed, so that all workers agree
_TABLES = np.random.default_rng(20_240_601).integers(0, 1 << 64, (2, (SHORT + 1) * 256), np.uint64)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each span (ascending, none overlapping, none empty), as two columns of uint64.

    Up to SHORT bytes the sum of the tables' numbers for its bytes at their places and for its length: two different
    words agree with probability 2^-128 over the tables, whatever their letters. Longer ones have 128 bits of BLAKE2b.
    """
    n = ends - starts
    out, short = np.empty((len(n), 2), np.uint64), n <= SHORT
    s, size = starts[short], n[short]
    if len(s):
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1])
        place -= np.repeat(first, size)
        held = data[np.repeat(s, size) + place]
        place *= 256
        place += held
        for half in (0, 1):
            out[short, half] = np.add.reduceat(_TABLES[half].take(place), first) + _TABLES[half].take(SHORT * 256 + size)
    for i in np.flatnonzero(~short).tolist():
        out[i] = np.frombuffer(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, spans: bool = False, wide: bool = False) -> tuple[np.ndarray, ...]:
    """64 bits of the digest of each word of all rows, and the words' offsets by row (len + 1); on request their starts
    and ends, and last the digest's other 64 bits."""
    hashes, starts, ends = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e, lo, hi in word_spans(data, offsets):
        hashes.append(word_digests(data[lo:hi], s - lo, e - lo))
        starts.append(s)
        ends.append(e)
    at, both = np.concatenate(starts), np.concatenate(hashes)
    out = np.ascontiguousarray(both[:, 0]), np.searchsorted(at, offsets)
    out = (*out, at, np.concatenate(ends)) if spans else out
    return (*out, np.ascontiguousarray(both[:, 1])) if wide else out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (rows are not told apart here)."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out ^= words[i : len(words) - n + 1 + i]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes of text each (one row at least)."""
    offsets = utf8(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
