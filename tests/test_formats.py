"""TIFF, NPZ, masks, chunked stores and settings: round trips, damage, and files made by other means."""

import io
import struct
import zlib

import numpy as np
import pytest

from kinegrid import settings
from kinegrid.sources import arrays as A
from kinegrid.sources import tiff as T
from kinegrid.sources import zarr as Z

rng = np.random.default_rng(0)
IMAGES = [(rng.normal(size=(7, 5)) * 50).astype(d) for d in ("u1", "u2", "i2", "i4", "f4", "f8")]


@pytest.mark.parametrize("deflate", [False, True])
def test_tiff_round_trip(deflate):
    data = T.encode(IMAGES, "spacing_x=0.5\nfinterval=2", deflate)
    found = list(T.pages(data))
    assert [p.dtype.str[1:] for p in found] == ["u1", "u2", "i2", "i4", "f4", "f8"] and found[0].description.startswith("spacing_x")
    for a, p in zip(IMAGES, found, strict=True):
        assert (T.read_page(data, p) == a).all()
    assert next(T.pages(T.encode(IMAGES[:1], "ab"))).description == "ab"


def hand_made(order, strips=2, big=False):
    """A page of 4 x 3 uint16 in strips, made field by field."""
    a = np.arange(12, dtype=f"{order}u2").reshape(4, 3)
    rows = 4 // strips
    body = [a[i * rows : (i + 1) * rows].tobytes() for i in range(strips)]
    word = "Q" if big else "I"
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8))
    n = 8
    size = (8 + n * 20 + 8) if big else (2 + n * 12 + 4)
    lists = len(head) + size
    at = lists + 2 * strips * struct.calcsize(word)
    offsets = [at + sum(map(len, body[:i])) for i in range(strips)]
    fields = [(256, 3, 1, 3), (257, 3, 1, 4), (258, 3, 1, 16), (259, 3, 1, 1), (273, 16 if big else 4, strips, lists), (277, 3, 1, 1), (278, 3, 1, rows), (279, 16 if big else 4, strips, lists + strips * struct.calcsize(word))]
    out = head + struct.pack(order + ("Q" if big else "H"), n)
    for tag, kind, count, value in fields:
        out += struct.pack(order + "HH" + word, tag, kind, count)
        inline = struct.pack(order + "H", value) if kind == 3 else struct.pack(order + word, value if count > 1 else (offsets if tag == 273 else [len(body[0])])[0])
        out += inline.ljust(struct.calcsize(word), b"\0")
    out += struct.pack(order + word, 0)
    out += struct.pack(f"{order}{strips}{word}", *offsets) + struct.pack(f"{order}{strips}{word}", *map(len, body))
    return out + b"".join(body), a


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_of_other_writers(order, big):
    data, a = hand_made(order, 2, big)
    (page,) = T.pages(data)
    assert (T.read_page(data, page) == a).all() and page.rows == 2


def test_damaged_tiff():
    data = T.encode(IMAGES[:1])
    for bad in (b"", b"XX" + data[2:], data[:20], data[:-30], data[:2] + b"\x2b\x01" + data[4:]):
        with pytest.raises(ValueError):
            [T.read_page(bad, p) for p in T.pages(bad)]
    ring = bytearray(T.encode(IMAGES[:2]))
    first = struct.unpack_from("<I", ring, 4)[0]
    struct.pack_into("<I", ring, len(ring) - 4, first)
    with pytest.raises(ValueError, match="ring"):
        list(T.pages(bytes(ring)))
    with pytest.raises(ValueError):
        T.encode([np.zeros((2, 2), complex)])


def test_tiff_tables(spark, tmp_path):
    a = rng.integers(0, 1000, (3, 2, 2, 4, 6)).astype("u2")  # t z c y x
    rows = [(int(t), int(z), int(c), int(y), int(x), float(v)) for (t, z, c, y, x), v in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, "t long, z long, c long, y long, x long, value double")
    written = T.write_tiff(df, str(tmp_path / "out"), "uint16", "PhysicalSizeX=\"0.25\" PhysicalSizeZ=\"2\"", True).collect()
    assert sorted((r["t"], r["pages"]) for r in written) == [(0, 4), (1, 4), (2, 4)]
    got = {(r["file"][-10:], r["z"], r["c"], r["y"], r["x"]): r["value"] for r in T.read_tiff(spark, str(tmp_path / "out"), 2, 2).collect()}
    assert got == {(f"{t:06d}.tif", z, c, y, x): float(v) for (t, z, c, y, x), v in np.ndenumerate(a)}
    m = T.meta(spark, str(tmp_path / "out")).collect()
    assert {(r["pages"], r["height"], r["width"], r["dtype"], r["spacing"], r["z_spacing"], r["period"]) for r in m} == {(4, 4, 6, "u2", 0.25, 2.0, None)}
    whole = tmp_path / "one"
    whole.mkdir()
    (whole / "stack.tif").write_bytes(T.encode(list(a.reshape(-1, 4, 6))))
    part = T.read_tiff(spark, str(whole), 2, 2, frames=(-1, 3), select=[1], block=2).collect()
    want = a[2, 1].reshape(2, 2, 2, 3, 2).mean((2, 4))
    assert {(r["t"], r["z"], r["c"], r["y"], r["x"]): r["value"] for r in part} == {(2, 1, c, y, x): v for (c, y, x), v in np.ndenumerate(want)}


def test_npz(spark, tmp_path):
    given = {"a": rng.normal(size=(3, 4)), "b": np.arange(5, dtype="<i4"), "flag": np.array([True, False])}
    for data in (A.npz_bytes(given), A.npz_bytes(given, False)):
        got = A.parse_npz(data)
        assert got.keys() == given.keys() and all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in given.items())
        assert (np.load(io.BytesIO(data))["a"] == given["a"]).all()
    made = io.BytesIO()
    np.savez_compressed(made, **given)
    assert (A.parse_npz(made.getvalue())["b"] == given["b"]).all()
    for bad in (b"", made.getvalue()[:-20], made.getvalue()[: len(made.getvalue()) // 2]):
        with pytest.raises(ValueError):
            A.parse_npz(bad)
    (tmp_path / "x.npz").write_bytes(A.npz_bytes(given))
    got = {(r["array"], r["position"]): r["value"] for r in A.read_npz(spark, str(tmp_path)).collect()}
    assert got == {(k, i): float(x) for k, v in given.items() for i, x in enumerate(v.ravel())}


@pytest.mark.parametrize("part", [0.0, 0.05, 0.5, 1.0])
def test_masks(spark, part):
    mask = rng.random((6, 5, 4)) < part
    data = A.encode_mask(mask)
    assert (A.decode_mask(data) == mask).all() and ("bits" in A.parse_npz(data)) == (mask.mean() > 0.2)
    rows = [(7, int(x), int(y), int(z)) for x, y, z in np.argwhere(mask)]
    df = spark.createDataFrame(rows, "frame long, x long, y long, z long")
    assert {(r["x"], r["y"]) for r in A.mask_plane(df, 7, 2).collect()} == {(int(x), int(y)) for x, y in np.argwhere(mask[:, :, 2])}
    assert A.mask_plane(df, 8, 2).count() == 0


def test_bad_masks():
    with pytest.raises(ValueError):
        A.decode_mask(A.npz_bytes({"shape": np.array([2, 2], "<i8")}))
    with pytest.raises(ValueError):
        A.decode_mask(A.npz_bytes({"shape": np.array([2, 2], "<i8"), "places": np.array([9], "<i8")}))


def test_cells_fingerprints_and_folders(spark, tmp_path):
    assert [A.parse_cell(x) for x in ("7", "7.5", "1e3", "x7", "", None)] == [7, 7.5, 1000.0, "x7", None, None]
    (tmp_path / "f.bin").write_bytes(b"abc")
    got = A.fingerprint(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert got["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    with pytest.raises(FileExistsError):
        A.reset_dir(spark, str(tmp_path))
    A.reset_dir(spark, str(tmp_path), force=True)
    assert list(tmp_path.iterdir()) == []
    A.reset_dir(spark, str(tmp_path / "new" / "one"))
    with pytest.raises(ValueError):
        A.reset_dir(spark, "/", True)


@pytest.mark.parametrize("compressor", [None, {"id": "zlib", "level": 1}, {}])
def test_chunked_stores(spark, tmp_path, compressor):
    a = rng.normal(size=(3, 7, 10)).astype("f4")
    a[0, :4, :4] = 0
    rows = [(int(t), int(y), int(x), float(v)) for (t, y, x), v in np.ndenumerate(a) if v]
    df = spark.createDataFrame(rows, "t long, y long, x long, value double")
    root = str(tmp_path / "store")
    n = Z.write_zarr(df, root, ["t", "y", "x"], a.shape, (1, 4, 4), attributes={"k": [1, 2]}, compressor=compressor)
    assert n == len(Z.chunk_names(a.shape, (1, 4, 4))) - 1
    found, notes = Z.read_zarr(spark, root, ["t", "y", "x"])
    got = np.zeros_like(a)
    for r in found.collect():
        got[r["t"], r["y"], r["x"]] = r["value"]
    assert (got == a).all() and notes == {"k": [1, 2]}
    part, _ = Z.read_zarr(spark, root, ["t", "y", "x"], {"t": (1, 2), "x": (5, 9)})
    assert {(r["t"], r["y"], r["x"]): r["value"] for r in part.collect()} == {(1, y, x): float(a[1, y, x]) for y in range(7) for x in range(5, 9)}


def test_damaged_chunks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0)], "y long, x long, value double")
    root = tmp_path / "store"
    Z.write_zarr(df, str(root), ["y", "x"], (4, 4), (4, 4), compressor={"id": "zlib"})
    (root / "0.0").write_bytes(zlib.compress(b"short"))
    with pytest.raises(Exception, match="no whole chunk"):
        Z.read_zarr(spark, str(root), ["y", "x"])[0].collect()


TOML = """
[recording]
frames = 1200
width = 630
height = 1500
slices = 20
rate = 2.0
spacing = 0.5
z_spacing = 2

[scan]
first_minute = 1.5
last_minute = 4
"""


def test_settings():
    s = settings.parse(TOML)
    assert s.frames() == (180, 481) and s.recording.z_ratio == 4 and s.recording.minutes(240) == 2
    assert s.recording.frame_bytes() == 630 * 1500 * 20 * 4 and s.task_bytes() > 7 * s.recording.frame_bytes()
    assert settings.parse(TOML + "[solver]\nradius = 3\n").solver.options()["radius"] == 3
    for bad in (TOML.replace("frames = 1200", ""), TOML + "[solver]\nradius = 2.5\n", TOML + "[solver]\nsize = 3\n", TOML + "[other]\nx = 1\n", TOML.replace("rate = 2.0", "rate = \"fast\""), TOML.replace("slices = 20", "slices = -1")):
        with pytest.raises(ValueError):
            settings.parse(bad)
    with pytest.raises(ValueError):
        settings.parse(TOML.replace("last_minute = 4", "last_minute = 1")).frames()


def test_shared_outputs_and_export(spark, tmp_path):
    rows = [(t, x, y, z, float(t + x * y + z)) for t in range(7) for x in range(4) for y in range(2) for z in range(3)]
    got = A.save_volumes(spark.createDataFrame(rows, "t long, x long, y long, z long, v double"), str(tmp_path / "v"), 4).collect()
    assert sorted(tuple(r) for r in got) == [(t, 24, 0, 2) for t in range(7)]
    assert sorted({r["t"] for r in spark.read.parquet(str(tmp_path / "v" / "volumes")).collect()}) == [0, 4, 6]
    movie = spark.read.parquet(str(tmp_path / "v" / "movie")).where("t = 3 and z = 1 and bx = 1 and by = 0").collect()
    assert [r["v"] for r in movie] == [np.mean([3 + x * y + 1 for x in (2, 3) for y in (0, 1)])]
    A.export_csv(spark.createDataFrame([(1, "a,b", None)], "i int, s string, d double"), str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()
    assert [tuple(r) for r in back] == [("1", "a,b", None)]


def test_blocks_that_must_be_whole(spark):
    from kinegrid.operators import grids as G

    df = spark.createDataFrame([(0, 0, 1.0)], "x long, y long, v double")
    assert G.block_mean(df, [], "x", "y", 2, ["v"], 4, 6, True).count() == 1
    with pytest.raises(ValueError):
        G.block_mean(df, [], "x", "y", 2, ["v"], 4, 5, True)
