"""Ranged reads of page stacks, and stacks that appear as a whole or not at all."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from kinegrid.sources import container as K
from kinegrid.sources import tiff as T


def of_bytes(r):
    return np.frombuffer(r["data"], r["kind"]).reshape(r["rows"], r["width"])


def assembled(rows):
    """Pages by (t, z, c), their blocks put together."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["z"], r["c"], r["top"])):
        out.setdefault((r["t"], r["z"], r["c"]), []).append(of_bytes(r))
    return {k: np.concatenate(v) for k, v in out.items()}


def images(n, shape=(13, 7), kind="u2"):
    rng = np.random.default_rng(n)
    return [(rng.random(shape) * 200).astype(kind) for _ in range(n)]


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("split", [200, 1 << 27])
def test_pages_of_a_file(spark, tmp_path, monkeypatch, deflate, split):
    """Splits by bytes take each page once, in blocks of rows, whatever their size."""
    monkeypatch.setattr(K, "SPLIT", split)
    monkeypatch.setattr(K, "FEW", 0)
    monkeypatch.setattr(K, "BLOCK", 40)
    a = images(12)
    (tmp_path / "a.tif").write_bytes(T.encode(a, deflate=deflate))
    reader = K.PageStack({"path": str(tmp_path / "a.tif"), "channels": "2", "slices": "3"}).reader(None)
    splits = reader.partitions()
    assert (len(splits) > 3) == (split == 200)
    rows = [r for s in splits for b in reader.read(s) for r in b.to_pylist()]
    got = assembled(rows)
    assert len(got) == 12 and all((got[i // 6, i // 2 % 3, i % 2] == a[i]).all() for i in range(12))
    assert max(r["rows"] for r in rows) < 13


def test_as_spark_reads_it(spark, tmp_path):
    for name, n in (("a.tif", 8), ("b.tiff", 4)):
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / name).write_bytes(T.encode(images(n)))
    found = K.read_stack(spark, str(tmp_path / "sub"), 1, 2)
    assert sorted((r["file"][-6:], r["t"], r["z"]) for r in found.collect()) == sorted([("/a.tif", i // 2, i % 2) for i in range(8)] + [("b.tiff", i // 2, i % 2) for i in range(4)])
    part = K.read_stack(spark, str(tmp_path / "sub"), 1, 2, t=(1, 3), z=(1, 2)).where("file like '%a.tif'")
    assert {(r["t"], r["z"]) for r in part.collect()} == {(1, 1), (2, 1)}
    p = {(r["t"], r["z"], r["y"], r["x"]): r["value"] for r in K.pixels(part).collect()}
    assert p[1, 1, 4, 5] == images(8)[3][4, 5] and len(p) == 2 * 13 * 7
    for allowed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", allowed)
        pushed = K.read_stack(spark, str(tmp_path / "sub" / "a.tif"), 1, 2).where("t = 2 and z in (0, 1) and c < 1 and top >= 0")
        assert {(r["t"], r["z"]) for r in pushed.collect()} == {(2, 0), (2, 1)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_pushed_filters():
    reader = K.PushedReader([("x", None)], 2, 5, {a: K.Bounds() for a in "tzc"})
    left = list(reader.pushFilters([EqualTo(("t",), 7), In(("z",), (1, 3, 9)), GreaterThan(("c",), 0), LessThanOrEqual(("top",), 3), EqualTo(("t",), "x"), In(("z",), (3, 9))]))
    assert [type(f) for f in left] == [LessThanOrEqual, EqualTo]
    assert 7 in reader.bounds["t"] and 6 not in reader.bounds["t"] and {z for z in range(12) if z in reader.bounds["z"]} == {3, 9} and 0 not in reader.bounds["c"]
    assert reader.last(None) == 79 and reader.bounds["z"].count() == 2


def sparse(path, pages, shape, kind="u2"):
    """A container whose strips are holes but for one page; its bytes aren't on disk."""
    height, width = shape
    strip = height * width * np.dtype(kind).itemsize
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
        at = 16
        for i in range(pages):
            entries = T.entries(shape, np.dtype(kind), False, strip)
            size = 16 + 20 * len(entries)
            after = at + size + strip
            f.seek(at)
            f.write(struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", t, k, 1, at + size if v is None else v) for t, k, v in entries))
            f.write(struct.pack("<Q", 0 if i == pages - 1 else after))
            if i == pages // 2:
                f.write((np.arange(height * width) % 251).astype(kind).tobytes())
            at = after
        f.truncate(at)


def test_one_page_of_three_gigabytes(spark, tmp_path, monkeypatch):
    """1,600 pages: one is read with less than 1% of the file's bytes, by one task that holds a block at a time."""
    path, n = str(tmp_path / "big.tif"), 1600
    sparse(path, n, (1500, 630))
    opened, plain = [], K.Ranged.__init__
    monkeypatch.setattr(K.Ranged, "__init__", lambda self, p: (plain(self, p), opened.append(self))[0])
    reader = K.PageStack({"path": path, "channels": "2", "slices": "20", "t": "20:21", "z": "0:1", "c": "0:1"}).reader(None)
    (split,) = reader.partitions()
    blocks = [r for b in reader.read(split) for r in b.to_pylist()]
    (source,) = opened
    assert source.size > 3_000_000_000 and source.taken < source.size / 100
    assert max(len(r["data"]) for r in blocks) <= K.BLOCK
    assert (np.concatenate([of_bytes(r) for r in blocks]).ravel() == np.arange(1500 * 630) % 251).all()
    found = K.read_stack(spark, path, 2, 20, t=(20, 21), z=(0, 2), c=(0, 1))
    assert found.agg(F.sum(F.length("data"))).first()[0] == 2 * 1500 * 630 * 2
    whole = K.PageStack({"path": path, "channels": "2", "slices": "20"}).reader(None)
    assert len(whole.partitions()) == math.ceil(source.size / K.SPLIT)


@pytest.mark.parametrize("damage", ["cut", "ring", "head", "strip"])
def test_damaged_files(tmp_path, damage):
    raw = bytearray(T.encode(images(3)))
    if damage == "cut":
        raw = raw[: len(raw) // 2]
    elif damage == "ring":
        at = struct.unpack_from("<I", raw, 4)[0]
        n = struct.unpack_from("<H", raw, at)[0]
        struct.pack_into("<I", raw, at + 2 + 12 * n, at)
    elif damage == "head":
        raw[:2] = b"XX"
    else:
        raw = raw.replace(struct.pack("<HHII", T.COUNTS, 4, 1, 13 * 7 * 2), struct.pack("<HHII", T.COUNTS, 4, 1, 5))
    (tmp_path / "a.tif").write_bytes(raw)
    reader = K.PageStack({"path": str(tmp_path / "a.tif")}).reader(None)
    with pytest.raises(ValueError):
        [b for s in reader.partitions() for b in reader.read(s)]


def frames(spark, ts, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(t, z, c, y, x, float(rng.integers(0, 100))) for t in ts for z in range(2) for c in range(2) for y in range(3) for x in range(4) if (t + y + x) % 5]
    return spark.createDataFrame(rows, K.PIXELS), {r[:5]: r[5] for r in rows}


def stored(spark, root):
    return {tuple(r[k] for k in ("t", "z", "c", "y", "x")): r["value"] for r in K.pixels(K.read_stack(spark, root, 2, 2)).collect()}


@pytest.mark.parametrize("deflate", [False, True])
def test_round_trip_append_and_overwrite(spark, tmp_path, deflate):
    root = str(tmp_path / "stack")
    df, want = frames(spark, [0, 3, 7, 11])
    K.write_stack(df, root, 3, 4, deflate=deflate)
    assert stored(spark, root) == want
    more, new = frames(spark, [3, 5], 1)
    K.write_stack(more, root, 3, 4, append=True)
    want = {k: v for k, v in want.items() if k[0] != 3} | new
    assert stored(spark, root) == want and len(list((tmp_path / "stack").rglob("*.tif"))) == 5
    one = K.read_stack(spark, root, 2, 2, t=(5, 6), c=(1, 2))
    assert one.rdd.getNumPartitions() == 1 and {(r["t"], r["c"]) for r in one.collect()} == {(5, 1)}
    pages = list(T.pages(next((tmp_path / "stack").rglob("frame_00000005*")).read_bytes()))  # as other readers see it
    assert [p.shape for p in pages] == [(3, 4)] * 4
    K.write_stack(more, root, 3, 4, "uint8")
    got = stored(spark, root)
    assert len(got) == 2 * 4 * 12 and all(got[k] == new.get(k, 0) for k in got) and len(list((tmp_path / "stack").rglob("*.tif"))) == 2


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    """Most frames are written when one fails: nothing of the run is visible, and nothing of it stays."""
    root = str(tmp_path / "stack")
    df, want = frames(spark, range(4))
    K.write_stack(df, root, 3, 4)
    files = sorted(p.name for p in (tmp_path / "stack").rglob("*"))
    bad = frames(spark, range(10, 30))[0].unionByName(spark.createDataFrame([(29, 0, 0, 99, 0, 1.0)], K.PIXELS))
    for append in (True, False):
        with pytest.raises(PySparkException, match="lies outside"):
            K.write_stack(bad, root, 3, 4, append=append)
        assert stored(spark, root) == want and sorted(p.name for p in (tmp_path / "stack").rglob("*")) == files


def test_a_killed_job_is_invisible(spark, tmp_path):
    """Tasks have written and nobody commits: readers see the stack as it was, or none; attempts that lost are removed."""
    root = str(tmp_path / "stack")
    writer = K.StackWriter(root, 3, 4, "float64", False, False)
    batch = lambda t: pa.RecordBatch.from_pylist([{"t": t, "z": 0, "c": 0, "y": 1, "x": 2, "value": 5.0}])
    lost, won = writer.write(iter([batch(1)])), writer.write(iter([batch(1), batch(2)]))
    assert K.read_stack(spark, root).collect() == [] and len(list((tmp_path / "stack").rglob("*.tif"))) == 3
    writer.commit([won, None])
    assert {r["t"] for r in K.read_stack(spark, root).collect()} == {1, 2} and len(list((tmp_path / "stack").rglob("*.tif"))) == 2
    with pytest.raises(ValueError, match="one piece"):
        writer.write(iter([batch(1), batch(2), batch(1)]))
    assert lost.files != won.files


def test_empty_tables_and_odd_columns(spark, tmp_path):
    root = str(tmp_path / "stack")
    K.write_stack(spark.createDataFrame([], K.PIXELS), root, 3, 4)
    assert K.read_stack(spark, root).collect() == []
    K.write_stack(spark.createDataFrame([(1, 0, 0, 1, 1, None, "x"), (1, 0, 0, 2, 1, float("nan"), "y")], K.PIXELS + ", data string"), root, 3, 4)
    assert stored(spark, root) == {} and len(K.read_stack(spark, root).collect()) == 1
    with pytest.raises(FileNotFoundError):
        K.PageStack({"path": str(tmp_path / "nothing")}).reader(None)
