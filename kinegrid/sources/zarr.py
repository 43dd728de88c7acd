"""Chunked array stores in the Zarr layout, version 2: ``.zarray`` and ``.zattrs`` beside one file a chunk, compressed
with Zstandard or zlib, or plain. Chunks are written and read by tasks, each on its own."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiff import _put


def _codec(spec: dict | None):
    """(compress, decompress) of a compressor's entry."""
    kind = spec["id"] if spec else None
    if kind is None:
        return bytes, bytes
    if kind == "zlib":
        return (lambda b: zlib.compress(b, spec.get("level", 1))), zlib.decompress
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=spec.get("level", 1)).compress, lambda b: zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31)
    raise ValueError(f"compressor {kind} is not read")


def write_zarr(cells: DataFrame, root: str, axes: list[str], shape: tuple[int, ...], chunks: tuple[int, ...], value: str = "value", dtype: str = "<f4", attributes: dict | None = None, compressor: dict | None = None) -> int:
    """Cells (axes, value) as a store below root, a folder that all tasks share; returns the number of chunks written.
    Cells that are missing are 0, and a chunk without cells has no file. A chunk is one group."""
    compressor = {"id": "zstd", "level": 1} if compressor is None else compressor or None
    notes = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": compressor, "fill_value": 0, "order": "C", "filters": None}
    _put(f"{root}/.zarray", json.dumps(notes).encode())
    _put(f"{root}/.zattrs", json.dumps(attributes or {}).encode())

    def run(table: pa.Table) -> pa.Table:
        pack = _codec(compressor)[0]
        at = [table.column(a).to_numpy() for a in axes]
        number = [int(i[0] // n) for i, n in zip(at, chunks, strict=True)]
        a = np.zeros(chunks, dtype)
        a[tuple(i % n for i, n in zip(at, chunks, strict=True))] = table.column("_value").to_numpy()
        _put(f"{root}/{'.'.join(map(str, number))}", pack(a.tobytes()))
        return pa.table({"n": [1]})

    inside = [F.col(a).cast("long").between(0, n - 1) for a, n in zip(axes, shape, strict=True)]
    rows = cells.where(F.array_min(F.array(*(c.cast("int") for c in inside))) == 1)
    rows = rows.select(*(F.col(a).cast("long").alias(a) for a in axes), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"), *(F.floor(F.col(a) / n).alias(f"_c{i}") for i, (a, n) in enumerate(zip(axes, chunks, strict=True))))
    return rows.groupBy(*(f"_c{i}" for i in range(len(axes)))).applyInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_zarr(spark: SparkSession, root: str, axes: list[str], where: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, dict]:
    """(axes, value) of the chunks that have files, and the store's attributes.

    where: first element and the one after the last by axis; only files of chunks that meet it are listed and read."""
    notes = json.loads(_text(spark, f"{root}/.zarray"))
    if notes.get("zarr_format") != 2 or notes.get("order") != "C" or notes.get("filters"):
        raise ValueError("not a plain version 2 store in row-major order")
    shape, chunks, dtype = notes["shape"], notes["chunks"], np.dtype(notes["dtype"])
    bounds = [(where or {}).get(a, (0, n)) for a, n in zip(axes, shape, strict=True)]
    names = ["{" + ",".join(str(k) for k in range(lo // n, max(lo, hi - 1) // n + 1)) + "}" for (lo, hi), n in zip(bounds, chunks, strict=True)]
    files = spark.read.format("binaryFile").load(f"{root}/{'.'.join(names)}").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(notes["compressor"])[1]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                number = [int(k) for k in path.rpartition("/")[2].split(".")]
                raw = unpack(data)
                if len(raw) != int(np.prod(chunks)) * dtype.itemsize:
                    raise ValueError(f"{path} is no whole chunk")
                a = np.frombuffer(raw, dtype).reshape(chunks)
                first = [k * n for k, n in zip(number, chunks, strict=True)]
                cut = [slice(max(lo - f, 0), max(0, min(hi - f, n, m - f))) for (lo, hi), f, n, m in zip(bounds, first, chunks, shape, strict=True)]
                part = a[tuple(cut)]
                at = np.indices(part.shape).reshape(len(axes), -1)
                yield pa.RecordBatch.from_arrays([*(pa.array(i + f + c.start) for i, f, c in zip(at, first, cut, strict=True)), pa.array(part.ravel().astype(np.float64))], names=[*axes, "value"])

    found = files.mapInArrow(run, ", ".join([*(f"{a} long" for a in axes), "value double"]))
    return found, json.loads(_text(spark, f"{root}/.zattrs") or "{}")


def _text(spark: SparkSession, path: str) -> str:
    """A small file whose name Spark's readers would take for hidden."""
    jvm, where = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def chunk_names(shape: tuple[int, ...], chunks: tuple[int, ...]) -> list[str]:
    """Names of all chunks of a store, for listings."""
    return [".".join(map(str, k)) for k in product(*(range(-(-n // c)) for n, c in zip(shape, chunks, strict=True)))]
