"""Array and table sources: NumPy files, packed bit masks, strict CSV, file catalogs, stage tables.

Files are read with Spark's own sources (binaryFile, csv, parquet), so any store that Spark reads will do;
decoding runs in Arrow batches.
"""

from __future__ import annotations

import ast
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"
#: element types that the reader takes (fixed values)
TYPES = {"<f4", "<f8", "<i4", "<i8", "|u1", "|b1"}
FRAME = r"(?<!\d)(\d{1,9})$"


def parse_npy(data: bytes) -> np.ndarray:
    """The array of an .npy file; wrong magic, order, element type or length raises ValueError."""
    if data[:6] != MAGIC or len(data) < 10:
        raise ValueError("not an npy file")
    wide = data[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    start = (12 if wide else 10) + size
    try:
        head = ast.literal_eval(data[12 if wide else 10 : start].decode("latin1"))
        descr, order, shape = head["descr"], head["fortran_order"], head["shape"]
    except (ValueError, SyntaxError, KeyError, TypeError) as e:
        raise ValueError("a malformed npy header") from e
    if order:
        raise ValueError("column-major arrays are not read")
    if descr not in TYPES:
        raise ValueError(f"elements of type {descr} are not read")
    dtype, n = np.dtype(descr), int(np.prod(shape, dtype=np.int64))
    if len(data) - start < n * dtype.itemsize:
        raise ValueError("the npy file is cut short")
    return np.frombuffer(data, dtype, n, start).reshape(shape)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, value): elements of all .npy files below a path, in row-major order; NaN becomes null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = parse_npy(batch.column("content")[i].as_py()).ravel().astype(np.float64)
                name = batch.column("path")[i].as_py()
                for lo in range(0, len(flat), 1 << 17):
                    part = flat[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), pa.array(part, from_pandas=True)], names=["file", "position", "value"])

    return files.select("path", "content").mapInArrow(run, "file string, position long, value double")


def parse_npz(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of an .npz file (a zip of .npy members), by name; damaged archives and members raise ValueError."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n.removesuffix(".npy"): parse_npy(z.read(n)) for n in z.namelist() if n.endswith(".npy")}
    except (zipfile.BadZipFile, zlib.error, EOFError) as e:
        raise ValueError("not a whole npz file") from e


def npz_bytes(arrays: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    """An .npz file of arrays of the element types that are read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
        for name, a in arrays.items():
            a = np.ascontiguousarray(a)
            if a.dtype.str not in TYPES:
                raise ValueError(f"elements of type {a.dtype.str} are not written")
            head = f"{{'descr': '{a.dtype.str}', 'fortran_order': False, 'shape': {a.shape!r}, }}".encode("latin1")
            head += b" " * (-(len(head) + 11) % 64) + b"\n"
            z.writestr(f"{name}.npy", MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head + a.tobytes())
    return out.getvalue()


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(file, array, shape, position, value): elements of the arrays of all .npz files below a path; NaN becomes null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for name, a in parse_npz(data).items():
                    flat = a.ravel().astype(np.float64)
                    for lo in range(0, len(flat), 1 << 17):
                        part = flat[lo : lo + (1 << 17)]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([name] * n), pa.array([list(a.shape)] * n, pa.list_(pa.int64())), pa.array(np.arange(lo, lo + n)), pa.array(part, from_pandas=True)], names=["file", "array", "shape", "position", "value"])

    return files.select("path", "content").mapInArrow(run, "file string, array string, shape array<long>, position long, value double")


SPARSE = 0.2  # largest part of true elements that is stored as places


def encode_mask(mask: np.ndarray) -> bytes:
    """A mask as an .npz: places of the true elements where they are few, packed bits otherwise."""
    mask = np.asarray(mask, bool)
    shape = np.array(mask.shape, "<i8")
    if mask.mean() <= SPARSE if mask.size else True:
        return npz_bytes({"shape": shape, "places": np.flatnonzero(mask).astype("<i8")})
    return npz_bytes({"shape": shape, "bits": np.packbits(mask)})


def decode_mask(data: bytes) -> np.ndarray:
    a = parse_npz(data)
    if "shape" not in a or not {"places", "bits"} & a.keys():
        raise ValueError("not a mask")
    shape = tuple(a["shape"].tolist())
    n = int(np.prod(shape))
    if "bits" in a:
        return np.unpackbits(a["bits"])[:n].astype(bool).reshape(shape)
    out = np.zeros(n, bool)
    if len(a["places"]) and not 0 <= a["places"].min() <= a["places"].max() < n:
        raise ValueError("a place lies outside the mask")
    out[a["places"]] = True
    return out.reshape(shape)


def mask_plane(mask: DataFrame, frame: int, z: int) -> DataFrame:
    """(x, y) of one plane of a sparse mask table (frame, x, y, z): two filters, which reach the scan."""
    return mask.where((F.col("frame") == frame) & (F.col("z") == z)).select("x", "y")


def parse_cell(text: str | None) -> int | float | str | None:
    """A cell of a table of diagnostics: a whole number, a number, or the text."""
    if text is None or text == "":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def fingerprint(df: DataFrame) -> DataFrame:
    """(file, md5) of binaryFile rows."""
    return df.select(F.col("path").alias("file"), F.md5("content").alias("md5"))


def reset_dir(spark: SparkSession, path: str, force: bool = False) -> None:
    """An empty folder; one that holds anything is emptied only with ``force``, and never a root or its direct child."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if hadoop.depth() < 2:
        raise ValueError(f"{path} is too near the root to be emptied")
    if store.exists(hadoop) and store.listStatus(hadoop):
        if not force:
            raise FileExistsError(path)
        store.delete(hadoop, True)
    store.mkdirs(hadoop)


def unpack_bits(packed: bytes, shape: tuple[int, ...], axes: str) -> np.ndarray:
    """A bit-packed mask as a boolean array with axes in the order x, y, z."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))[: int(np.prod(shape))].astype(bool).reshape(shape)
    if sorted(axes) != ["x", "y", "z"]:
        raise ValueError("axes name x, y and z once each")
    return bits.transpose([axes.index(a) for a in "xyz"])


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Strict CSV with a header: a ragged row or a number that is none fails the read."""
    r = spark.read.option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false")
    return (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(kind, frame, path): files whose stem ends in a frame number, kind being their folder; two of one frame raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    frame = F.regexp_extract(stem, FRAME, 1)
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("kind"), frame.alias("f"), "path").where("f <> ''")
    one = rows.groupBy("kind", F.col("f").cast("int").alias("frame")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two files of frame "), F.col("frame").cast("string")))).otherwise(F.col("path"))
    return one.select("kind", "frame", twice.alias("path"))


def frame_of(stem: str) -> int | None:
    m = re.search(FRAME, stem)
    return int(m[1]) if m else None


def save_stage(df: DataFrame, root: str, name: str, params: dict | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """A stage's table with its parameters and row count beside it; any stage can be reloaded alone."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(f"{root}/{name}")
    spark = df.sparkSession
    note = json.dumps({"params": params or {}, "rows": spark.read.parquet(f"{root}/{name}").count()}, sort_keys=True, default=str)
    spark.createDataFrame([(name, note)], "stage string, note string").coalesce(1).write.mode("overwrite").json(f"{root}/{name}.meta")


def load_stage(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, dict]:
    note = spark.read.json(f"{root}/{name}.meta").first()["note"]
    return spark.read.parquet(f"{root}/{name}"), json.loads(note)


def sampled_frames(df: DataFrame, t: str, stride: int) -> DataFrame:
    """First, last and every stride-th frame."""
    last = df.agg(F.max(t).alias("_last"))
    return df.join(F.broadcast(last)).where((F.col(t) == 0) | (F.col(t) == F.col("_last")) | (F.col(t) % stride == 0)).drop("_last")


def save_volumes(scattered: DataFrame, root: str, stride: int) -> DataFrame:
    """One scatter (t, x, y, z, v), three outputs: whole volumes of sampled frames, 2 x 2 blocks of every frame, and a row
    of occupancy for each frame, which is returned. The scatter is written once and the outputs read that."""
    spark = scattered.sparkSession
    scattered.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/all")
    stored = spark.read.schema(scattered.schema).parquet(f"{root}/all")
    sampled_frames(stored, "t", stride).repartition("t").write.mode("overwrite").option("compression", "zstd").partitionBy("t").parquet(f"{root}/volumes")
    blocks = stored.groupBy("t", "z", F.floor(F.col("x") / 2).alias("bx"), F.floor(F.col("y") / 2).alias("by")).agg(F.avg("v").alias("v")).repartition("t")  # a file a frame, not one for each task and frame
    blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("t").parquet(f"{root}/movie")
    return stored.groupBy("t").agg(F.count("*").alias("voxels"), F.min("z").alias("z0"), F.max("z").alias("z1"))


def export_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header, nulls as empty cells, timestamps in ISO form."""
    df.write.mode("overwrite").option("header", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
