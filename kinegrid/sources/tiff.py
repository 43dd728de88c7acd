"""Baseline TIFF: pages of grey images, uncompressed or deflated, in strips or tiles of rows, both byte orders, classic
and big files; written as one strip a page. Decoding runs in Arrow batches over Spark's binaryFile source.

A file is held whole by the task that reads it (binaryFile gives it so); of a page only its own bytes are decoded.
Anything beyond this (several samples a pixel, other compressions, tiles in two directions) raises ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF 6.0 field numbers (fixed values)
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 317, 339
#: TIFF 6.0 and BigTIFF field types: struct codes (fixed values)
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "c", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Page:
    shape: tuple[int, int]  # rows, columns
    dtype: np.dtype
    offsets: list[int]
    counts: list[int]
    rows: int
    deflated: bool
    description: str


def _unpack(code: str, data: bytes, at: int) -> tuple:
    if at < 0 or at + struct.calcsize(code) > len(data):
        raise ValueError("the TIFF file is cut short")
    return struct.unpack_from(code, data, at)


def pages(data: bytes) -> Iterator[Page]:
    """The pages' directories, in order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    version = _unpack(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = _unpack(order + word, data, 8 if big else 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        n = _unpack(order + count, data, at)[0]
        at += struct.calcsize(count)
        fields: dict[int, tuple] = {}
        for i in range(n):
            place = at + i * entry
            tag, kind = _unpack(order + "HH", data, place)
            size = _unpack(order + word, data, place + 4)[0]
            if kind not in KINDS:
                continue
            code = f"{order}{size}{KINDS[kind]}" if KINDS[kind] != "c" else f"{size}s"
            here = place + 4 + struct.calcsize(word)
            if struct.calcsize(code) > struct.calcsize(word):
                here = _unpack(order + word, data, here)[0]
            fields[tag] = _unpack(code, data, here)
        yield page_of(fields, order)
        at = _unpack(order + word, data, at + n * entry)[0]


def page_of(fields: dict[int, tuple], order: str) -> Page:
    """What a directory's fields say."""
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) != 1 or OFFSETS not in fields or COUNTS not in fields:
        raise ValueError("a page is no grey image in plain or deflated strips")
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((one(FORMAT, 1), one(BITS, 1)))
    if kind is None or WIDTH not in fields or HEIGHT not in fields:
        raise ValueError("a page's elements are not read")
    text = one(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace")
    return Page((one(HEIGHT), one(WIDTH)), np.dtype(order + kind), list(fields[OFFSETS]), list(fields[COUNTS]), one(ROWS, one(HEIGHT)), one(COMPRESSION, 1) != 1, text)


def entries(shape: tuple[int, int], dtype: np.dtype, deflate: bool, size: int) -> list[tuple[int, int, int | None]]:
    """Directory entries (field, kind, value) of a page of one strip; None stands for the strip's place."""
    kinds = {"u1": (1, 8), "u2": (1, 16), "u4": (1, 32), "i1": (2, 8), "i2": (2, 16), "i4": (2, 32), "f4": (3, 32), "f8": (3, 64)}
    if np.dtype(dtype).str[1:] not in kinds:
        raise ValueError("images are arrays of whole numbers or floats of 8 to 64 bits")
    form, bits = kinds[np.dtype(dtype).str[1:]]
    return [(WIDTH, 4, shape[1]), (HEIGHT, 4, shape[0]), (BITS, 3, bits), (COMPRESSION, 3, 8 if deflate else 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 16, None), (SAMPLES, 3, 1), (ROWS, 4, shape[0]), (COUNTS, 16, size), (FORMAT, 3, form)]


def read_page(data: bytes, page: Page) -> np.ndarray:
    out, (height, width) = [], page.shape
    for i, (at, n) in enumerate(zip(page.offsets, page.counts, strict=True)):
        if at + n > len(data):
            raise ValueError("a strip is cut short")
        strip = data[at : at + n]
        if page.deflated:
            strip = zlib.decompress(strip)
        rows = min(page.rows, height - i * page.rows)
        if len(strip) < rows * width * page.dtype.itemsize:
            raise ValueError("a strip is too short for its rows")
        out.append(np.frombuffer(strip, page.dtype, rows * width))
    whole = np.concatenate(out) if out else np.zeros(0, page.dtype)
    if len(whole) != height * width:
        raise ValueError("the strips do not make the page")
    return whole.reshape(height, width)


def encode(images: list[np.ndarray], description: str = "", deflate: bool = False) -> bytes:
    """A little-endian file with a page for each 2-D image."""
    kinds = {"u1": (1, 8), "u2": (1, 16), "u4": (1, 32), "i1": (2, 8), "i2": (2, 16), "i4": (2, 32), "f4": (3, 32), "f8": (3, 64)}
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4
    for i, image in enumerate(images):
        image = np.asarray(image)
        if image.ndim != 2 or image.dtype.str[1:] not in kinds:
            raise ValueError("images are 2-D arrays of whole numbers or floats of 8 to 64 bits")
        shape, bits = kinds[image.dtype.str[1:]]
        strip = image.astype(image.dtype.newbyteorder("<")).tobytes()
        strip = zlib.compress(strip) if deflate else strip
        at = len(out)
        out += strip + b"\0" * (len(strip) % 2)
        text = description.encode() + b"\0" if description and not i else b""
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        fields = [(WIDTH, 4, 1, image.shape[1]), (HEIGHT, 4, 1, image.shape[0]), (BITS, 3, 1, bits), (COMPRESSION, 3, 1, 8 if deflate else 1), (PHOTOMETRIC, 3, 1, 1)]
        fields += [(DESCRIPTION, 2, len(text), text_at)] if text else []
        fields += [(OFFSETS, 4, 1, at), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, image.shape[0]), (COUNTS, 4, 1, len(strip)), (FORMAT, 3, 1, shape)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag, kind, n, value in fields:
            if kind == 2 and n <= 4:
                out += struct.pack("<HHI4s", tag, kind, n, text[:n])
            else:
                out += struct.pack("<HHII", tag, kind, n, value)
        link = len(out)
        out += struct.pack("<I", 0)
    if len(out) >= 1 << 32:
        raise ValueError("a classic TIFF file holds less than 4 GiB")
    return bytes(out)


def meta(spark: SparkSession, path: str) -> DataFrame:
    """(file, pages, height, width, dtype, spacing, z_spacing, period): what the directories and the description say.

    Spacings and the frame period are read from ``key=value`` lines or OME attributes, null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(pages(data))
                text = found[0].description if found else ""

                def number(*keys: str, text: str = text) -> float | None:
                    m = re.search(rf"\b(?:{'|'.join(keys)})\s*=\s*\"?([-+0-9.eE]+)", text)
                    return float(m[1]) if m else None

                first = found[0] if found else None
                out.append((name, len(found), first.shape[0] if first else 0, first.shape[1] if first else 0, first.dtype.str[1:] if first else "", number("PhysicalSizeX", "spacing_x"), number("PhysicalSizeZ", "spacing", "spacing_z"), number("TimeIncrement", "finterval")))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "pages", "height", "width", "dtype", "spacing", "z_spacing", "period"])

    return _files(spark, path).mapInArrow(run, "file string, pages long, height long, width long, dtype string, spacing double, z_spacing double, period double")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_tiff(spark: SparkSession, path: str, channels: int = 1, slices: int = 1, frames: tuple[int, int] | None = None, select: list[int] | None = None, block: int = 1) -> DataFrame:
    """(file, t, z, c, y, x, value): pixels of all files below a path, pages in the order t, z, c.

    frames: first frame and the one after the last (negative: from the end); select: slices; block: means of so many
    pixels in both directions. Pages that are not asked for are not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(pages(data))
                if len(found) % (channels * slices):
                    raise ValueError(f"{name} has {len(found)} pages, not a multiple of {channels} channels and {slices} slices")
                total = len(found) // (channels * slices)
                lo, hi = frames or (0, total)
                lo, hi = (min(max(f + total if f < 0 else f, 0), total) for f in (lo, hi))
                for i, page in enumerate(found):
                    t, z, c = i // (channels * slices), i // channels % slices, i % channels
                    if not lo <= t < hi or select is not None and z not in select:
                        continue
                    a = read_page(data, page).astype(np.float64)
                    if block > 1:
                        h, w = (n // block * block for n in a.shape)
                        a = a[:h, :w].reshape(h // block, block, w // block, block).mean((1, 3))
                    for top in range(0, a.shape[0], max(1, (1 << 17) // max(a.shape[1], 1))):
                        part = a[top : top + max(1, (1 << 17) // max(a.shape[1], 1))]
                        y, x = np.divmod(np.arange(part.size), part.shape[1])
                        n = part.size
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(pa.array(np.full(n, v)) for v in (t, z, c)), pa.array(y + top), pa.array(x), pa.array(part.ravel(), from_pandas=True)], names=["file", "t", "z", "c", "y", "x", "value"])

    return _files(spark, path).mapInArrow(run, "file string, t long, z long, c long, y long, x long, value double")


def _put(uri: str, data: bytes) -> None:
    """Write a file under its own name once it is complete."""
    where = urlsplit(uri)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        part = f"{where.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, where.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(data)


def write_tiff(frames: DataFrame, root: str, dtype: str = "float32", description: str = "", deflate: bool = False, name: str = "frame_{t:06d}.tif") -> DataFrame:
    """A file for each t of (t, z, c, y, x, value), pages in the order z, c; (t, path, pages). Missing pixels are 0.

    root is a folder that all tasks share. A frame is one group, so it must fit a task; a repeated attempt writes the
    same file again."""

    def run(table: pa.Table) -> pa.Table:
        t, z, c, y, x = (table.column(k).to_numpy() for k in ("t", "z", "c", "y", "x"))
        a = np.zeros((z.max() + 1, c.max() + 1, y.max() + 1, x.max() + 1), dtype)
        a[z, c, y, x] = table.column("value").to_numpy()
        path = f"{root.rstrip('/')}/{name.format(t=int(t[0]))}"
        _put(path, encode(list(a.reshape(-1, *a.shape[2:])), description, deflate))
        return pa.table({"t": [int(t[0])], "path": [path], "pages": [a.shape[0] * a.shape[1]]})

    rows = frames.select(*(F.col(k).cast("long").alias(k) for k in ("t", "z", "c", "y", "x")), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return rows.groupBy("t").applyInArrow(run, "t long, path string, pages long")
