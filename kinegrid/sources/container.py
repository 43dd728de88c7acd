"""Stacks of grey pages as a Spark data source, ``page_stack``: ranged reads of TIFF containers of any size, and a writer
whose result appears as a whole or not at all.

Reading: a file is dealt into splits of ``SPLIT`` bytes. A task walks the directories, some 200 bytes a page, and
reads the strips of those pages that begin in its split, in blocks of rows; no task holds more than a block. Conditions on
t, z and c (pushed by Spark, or given as options) are applied to the page's number before any strip is read; where they leave few pages,
the file is one split, so that its directories are walked once.

Writing: rows (t, z, c, y, x, value), each frame in one task and sorted, become one BigTIFF file a frame, written page by page
in one direction, so a task holds two pages. Files go into a folder of the run; the commit writes a manifest that
names the files of the attempts that succeeded, in one step. Readers see what the manifest names. A run that fails or is
killed leaves the manifest that was there, and ``abort`` removes the run's files.

Paths are local to a folder that all tasks share, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import tiff
from .tiff import KINDS, Page

SPLIT = 128 << 20
BLOCK = 1 << 20  # bytes of decoded rows in one output row
FEW = 256  # pages that are read in one split
MANIFEST = "manifest.json"
PAGES = "file string, t long, z long, c long, top long, rows long, width long, kind string, data binary"
PIXELS = "t long, z long, c long, y long, x long, value double"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    where = urlsplit(path)
    return (fs.LocalFileSystem(), where.path) if where.scheme in ("", "file") else fs.FileSystem.from_uri(path)


class Ranged:
    """Bytes of a file by place; ``taken`` counts what was read."""

    def __init__(self, path: str):
        system, name = store(path)
        self.name, self.file, self.taken = path, system.open_input_file(name), 0
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"{self.name} is cut short")
        self.taken += n
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def directories(source: Ranged) -> Iterator[Page]:
    """The pages' directories, in order, each read by itself."""
    head = source.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{source.name} is no TIFF file")
    word, count, entry = ("Q", "Q", 20) if version == 43 else ("I", "H", 12)
    size_of = {"Q": 8, "I": 4, "H": 2}
    at = struct.unpack(order + "Q", source.read(8, 8))[0] if version == 43 else struct.unpack_from(order + "I", head, 4)[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError(f"{source.name}: the directories form a ring")
        seen.add(at)
        n = struct.unpack(order + count, source.read(at, size_of[count]))[0]
        raw = source.read(at + size_of[count], n * entry + size_of[word])
        fields: dict[int, tuple] = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, i * entry)
            if kind not in KINDS:
                continue
            size = struct.unpack_from(order + word, raw, i * entry + 4)[0]
            code = f"{size}s" if KINDS[kind] == "c" else f"{order}{size}{KINDS[kind]}"
            here, long = i * entry + 4 + size_of[word], struct.calcsize(code)
            if long > size_of[word]:
                fields[tag] = struct.unpack(code, source.read(struct.unpack_from(order + word, raw, here)[0], long))
            else:
                fields[tag] = struct.unpack_from(code, raw, here)
        yield tiff.page_of(fields, order)
        at = struct.unpack_from(order + word, raw, n * entry)[0]


def page_rows(source: Ranged, page: Page) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows of a page: first row, and the rows in the machine's byte order."""
    height, width = page.shape
    line, top = width * page.dtype.itemsize, 0
    if len(page.offsets) != -(-height // max(1, page.rows)):
        raise ValueError(f"{source.name}: the strips do not make the page")
    for at, n in zip(page.offsets, page.counts, strict=True):
        rows = min(page.rows, height - top)
        step = max(1, BLOCK // max(1, line))
        if page.deflated:
            strip = zlib.decompress(source.read(at, n))
            parts = [(lo, strip[lo * line : min(rows, lo + step) * line]) for lo in range(0, rows, step)]
            if len(strip) < rows * line:
                raise ValueError(f"{source.name}: a strip is too short for its rows")
        else:
            if n < rows * line:
                raise ValueError(f"{source.name}: a strip is too short for its rows")
            parts = ((lo, source.read(at + lo * line, (min(rows, lo + step) - lo) * line)) for lo in range(0, rows, step))
        for lo, raw in parts:
            yield top + lo, np.frombuffer(raw, page.dtype).reshape(-1, width).astype(page.dtype.newbyteorder("="))
        top += rows


@dataclass
class Bounds:
    """Numbers allowed on one axis: lowest, the one after the highest, and a set."""

    low: float = 0
    high: float = math.inf
    among: frozenset | None = None

    def narrowed(self, low: float = 0, high: float = math.inf, among: frozenset | None = None) -> Bounds:
        both = among if self.among is None else self.among if among is None else self.among & among
        return Bounds(max(self.low, low), min(self.high, high), both)

    def __contains__(self, i: int) -> bool:
        return self.low <= i < self.high and (self.among is None or i in self.among)

    def count(self) -> float:
        return len([i for i in self.among if i in self]) if self.among is not None else max(0, self.high - self.low)


@dataclass
class Split(InputPartition):
    path: str
    frame: int | None  # of a file that holds one frame; else frames are counted from 0 in each file
    low: int = 0
    high: int | None = None

    def __post_init__(self):
        super().__init__((self.path, self.low))


@dataclass
class StackReader(DataSourceReader):
    paths: list[tuple[str, int | None]]
    channels: int
    slices: int
    bounds: dict[str, Bounds]

    def partitions(self) -> list[Split]:
        few = self.bounds["t"].count() * min(self.slices, self.bounds["z"].count()) * min(self.channels, self.bounds["c"].count()) <= FEW
        out = []
        for path, frame in self.paths:
            if frame is not None and frame not in self.bounds["t"]:
                continue
            system, name = store(path)
            size = 0 if few else system.get_file_info(name).size
            out += [Split(path, frame)] if size <= SPLIT else [Split(path, frame, lo, lo + SPLIT) for lo in range(0, size, SPLIT)]
        return out

    def last(self, frame: int | None) -> float:
        """The number of the last page that the bounds allow."""
        t = self.bounds["t"] if frame is None else Bounds(0, 1)
        return min(t.high - 1, max(t.among, default=-1) if t.among is not None else math.inf) * self.channels * self.slices + self.channels * self.slices - 1

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # Spark's way to read no splits
            return
        source = Ranged(split.path)
        try:
            yield from self.blocks(source, split)
        finally:
            source.close()

    def blocks(self, source: Ranged, split: Split) -> Iterator[pa.RecordBatch]:
        for i, page in enumerate(directories(source)):
            if i > self.last(split.frame):
                return
            t = i // (self.channels * self.slices)
            at = {"t": t if split.frame is None else split.frame + t, "z": i // self.channels % self.slices, "c": i % self.channels}
            start = page.offsets[0] if page.offsets else 0
            if not (split.low <= start and (split.high is None or start < split.high)) or any(at[a] not in self.bounds[a] for a in at):
                continue
            for top, rows in page_rows(source, page):
                cells = [split.path, at["t"], at["z"], at["c"], top, rows.shape[0], rows.shape[1], rows.dtype.str[1:], rows.tobytes()]
                kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells, kinds, strict=True)], names=["file", "t", "z", "c", "top", "rows", "width", "kind", "data"])


class PushedReader(StackReader):
    """The same where the session lets Python sources take conditions (it is an error to offer that where it doesn't)."""

    def pushFilters(self, filters):
        """Comparisons of t, z or c with a number are taken; all others stay Spark's."""
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            v = getattr(f, "value", None)
            one = {EqualTo: lambda v: {"among": frozenset([v])}, In: lambda v: {"among": frozenset(v)}, GreaterThan: lambda v: {"low": v + 1}, GreaterThanOrEqual: lambda v: {"low": v}, LessThan: lambda v: {"high": v}, LessThanOrEqual: lambda v: {"high": v + 1}}.get(type(f))
            numbers = v if isinstance(v, tuple | list) else (v,)
            if axis not in self.bounds or one is None or not all(isinstance(x, int) and not isinstance(x, bool) for x in numbers):
                yield f
            else:
                self.bounds[axis] = self.bounds[axis].narrowed(**one(v))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # frame, name, pages


@dataclass
class StackWriter(DataSourceArrowWriter):
    root: str
    height: int
    width: int
    dtype: str
    deflate: bool
    append: bool
    run: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.root)
        folder, files, frame, out, held = f"{root}/{self.run}", [], None, None, None
        system.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex[:12]

        def close() -> None:
            if frame is not None:
                out.add(held[1], last=True)
                out.file.close()
                files.append((frame, out.name, out.pages))

        for (t, z, c), y, x, v in _pages(iterator):
            if t != frame:
                close()
                if any(t == f for f, *_ in files):
                    raise ValueError(f"frame {t} is not in one piece: rows must be dealt by t and sorted")
                name = f"{self.run}/frame_{t:08d}-{attempt}.tif"
                frame, out, held = t, _Stack(system, f"{root}/{name}", name, self.deflate), None
            elif held[0] >= (z, c):
                raise ValueError(f"frame {t}: pages are not in the order z, c")
            if held:
                out.add(held[1], last=False)
            if len(y) and not (0 <= y.min() and y.max() < self.height and 0 <= x.min() and x.max() < self.width):
                raise ValueError(f"frame {t}: a pixel lies outside {self.height} x {self.width}")
            kind = np.dtype(self.dtype)
            image = np.full((self.height, self.width), np.nan if kind.kind == "f" else 0, kind)
            image[y, x] = v
            held = ((z, c), image)
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.root)
        system.create_dir(root, recursive=True)
        frames = {t: [name, pages] for m in messages if m for t, name, pages in m.files}
        before = manifest(self.root)
        kept = {int(t): v for t, v in before.items() if int(t) not in frames} if self.append else {}
        whole = {str(t): v for t, v in sorted((kept | frames).items())}
        part = f"{root}/_{self.run}.json"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(whole).encode())
        system.move(part, f"{root}/{MANIFEST}")
        named = {v[0] for v in whole.values()}  # what no manifest names any more goes, that of attempts that lost included
        for folder in system.get_file_info(fs.FileSelector(root)):
            if folder.type == fs.FileType.Directory and folder.base_name.startswith("run-") and (folder.base_name == self.run or any(v[0].startswith(folder.base_name) for v in before.values())):
                for f in system.get_file_info(fs.FileSelector(folder.path)):
                    if f"{folder.base_name}/{f.base_name}" not in named:
                        system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.root)
        if system.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.run}")


class _Stack:
    """A BigTIFF file that is written forwards only: each directory stands before its strip and knows where the next one begins."""

    def __init__(self, system: fs.FileSystem, path: str, name: str, deflate: bool):
        self.file, self.name, self.deflate, self.pages, self.at = system.open_output_stream(path), name, deflate, 0, 16
        self.file.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))

    def add(self, image: np.ndarray, last: bool) -> None:
        strip = np.ascontiguousarray(image.astype(image.dtype.newbyteorder("<"))).tobytes()
        strip = zlib.compress(strip) if self.deflate else strip
        entries = tiff.entries(image.shape, image.dtype, self.deflate, len(strip))
        size = 8 + 20 * len(entries) + 8
        after = self.at + size + len(strip)
        after += -after % 8
        out = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, self.at + size if value is None else value) for tag, kind, value in entries)
        self.file.write(out + struct.pack("<Q", 0 if last else after) + strip + b"\0" * (after - self.at - size - len(strip)))
        self.at, self.pages = after, self.pages + 1


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(t, z, c) and the pixels of each page, of rows sorted by t, z, c."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(a).to_numpy() for a in ("t", "z", "c")]
        cuts = np.flatnonzero(reduce(np.logical_or, [np.diff(a) != 0 for a in at])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(int(a[lo]) for a in at)
            if now != key and held:
                yield key, *(np.concatenate(p) for p in zip(*held, strict=True))
                held = []
            key = now
            held.append(tuple(batch.column(a).to_numpy(zero_copy_only=False)[lo:hi] for a in ("y", "x", "value")))
    if held:
        yield key, *(np.concatenate(p) for p in zip(*held, strict=True))


def manifest(root: str) -> dict:
    """Frames of a committed stack: name of the file and its number of pages."""
    system, path = store(root)
    if system.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.File:
        return {}
    with system.open_input_file(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


class PageStack(DataSource):
    """Options: path; channels, slices (of a page's number); t, z, c as "first:after"; for writing height, width, dtype, deflate."""

    @classmethod
    def name(cls) -> str:
        return "page_stack"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> StackReader:
        o = self.options
        system, path = store(o["path"])
        root, kind = o["path"].rstrip("/"), system.get_file_info(path).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if named := kind == fs.FileType.Directory and manifest(root):
            paths = [(f"{root}/{name}", int(t)) for t, (name, _) in named.items()]
        elif kind == fs.FileType.Directory:  # runs that were not committed are nobody's
            files = [f.path[len(path.rstrip("/")) + 1 :] for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.extension in ("tif", "tiff")]
            paths = [(f"{root}/{f}", None) for f in sorted(files) if not f.startswith("run-")]
        else:
            paths = [(root, None)]
        bounds = {}
        for axis in ("t", "z", "c"):
            low, _, high = o.get(axis, ":").partition(":")
            bounds[axis] = Bounds(int(low or 0), int(high) if high else math.inf)
        kind = PushedReader if o.get("pushdown", "false") == "true" else StackReader
        return kind(paths, int(o.get("channels", 1)), int(o.get("slices", 1)), bounds)

    def writer(self, schema, overwrite: bool) -> StackWriter:
        o = self.options
        want = [x.strip().split()[0] for x in PIXELS.split(",")]
        if schema.fieldNames() != want:
            raise ValueError(f"a stack is written from columns {', '.join(want)}")
        return StackWriter(o["path"], int(o["height"]), int(o["width"]), o.get("dtype", "float64"), o.get("deflate", "false") == "true", not overwrite)


def read_stack(spark: SparkSession, path: str, channels: int = 1, slices: int = 1, **where: tuple[int, int]) -> DataFrame:
    """PAGES of a file, of all TIFF files below a folder, or of the frames that a written stack's manifest names (t is then the
    frame's own number); where: first and the one after the last by axis (t, z, c)."""
    spark.dataSource.register(PageStack)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("page_stack").option("channels", channels).option("slices", slices).option("pushdown", pushdown)
    for axis, (low, high) in where.items():
        reader = reader.option(axis, f"{low}:{high}")
    return reader.load(path)


def pixels(pages: DataFrame) -> DataFrame:
    """PIXELS of PAGES; NaN, which stands for no pixel in stacks of floats, gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], r["kind"]).astype(np.float64)
                at = np.flatnonzero(~np.isnan(a))
                y, x = np.divmod(at, max(1, r["width"]))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), r[k], np.int64)) for k in ("t", "z", "c")), pa.array(y + r["top"]), pa.array(x), pa.array(a[at])], names=["t", "z", "c", "y", "x", "value"])

    return pages.select("t", "z", "c", "top", "width", "kind", "data").mapInArrow(run, PIXELS)


def write_stack(rows: DataFrame, path: str, height: int, width: int, dtype: str = "float64", deflate: bool = False, append: bool = False) -> None:
    """Rows with PIXELS as a stack, one file a frame, frames dealt over tasks. Without ``append`` it replaces what is there,
    with it the frames that rows have. Pixels that are missing, null or NaN are NaN in floats and 0 in whole numbers."""
    rows.sparkSession.dataSource.register(PageStack)
    value = F.col("value").cast("double")
    value = F.coalesce(value, F.lit(float("nan"))) if np.dtype(dtype).kind == "f" else F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))
    sorted_rows = rows.select(*(F.col(k).cast("long").alias(k) for k in ("t", "z", "c", "y", "x")), value.alias("value")).repartition("t").sortWithinPartitions("t", "z", "c")
    to = sorted_rows.write.format("page_stack").mode("append" if append else "overwrite").option("height", height).option("width", width).option("dtype", dtype).option("deflate", str(deflate).lower())
    to.save(path)
