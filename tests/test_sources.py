import io

import numpy as np
import pytest

from kinegrid.operators import serving as V
from kinegrid.sources import arrays as A


def npy(a):
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i4", "<i8", "|u1"])
def test_npy_round_trip(kind):
    a = np.arange(12).reshape(3, 4).astype(kind)
    assert (A.parse_npy(npy(a)) == a).all()


@pytest.mark.parametrize("bad", [b"", b"junk" * 5, npy(np.zeros(4))[:-1], npy(np.asfortranarray(np.ones((2, 3)))), npy(np.zeros(2, complex))])
def test_npy_refuses(bad):
    with pytest.raises(ValueError):
        A.parse_npy(bad)


def test_read_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([1.0, np.nan, 3.0]))
    got = {r["position"]: r["value"] for r in A.read_npy(spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: None, 2: 3.0}


def test_unpack_bits():
    a = np.random.default_rng(0).random((2, 3, 5)) > 0.5
    assert (A.unpack_bits(np.packbits(a).tobytes(), (2, 3, 5), "zyx") == a.transpose(2, 1, 0)).all()


def test_strict_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("frame,mae\n1,0.5\n2,0.25\n")
    assert A.read_csv(spark, str(tmp_path / "ok.csv")).agg({"mae": "sum"}).first()[0] == 0.75
    (tmp_path / "bad.csv").write_text("frame,mae\n1,0.5\n2,oops\n")
    with pytest.raises(Exception):
        A.read_csv(spark, str(tmp_path / "bad.csv"), "frame int, mae double").collect()


def test_catalog(spark, tmp_path):
    for d, n in (("mask", "m_0001.bin"), ("mask", "m_0002.bin"), ("field", "f10.bin"), ("field", "readme.txt")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_bytes(b"x")
    got = {(r["kind"], r["frame"]) for r in A.catalog(spark, str(tmp_path)).collect()}
    assert got == {("mask", 1), ("mask", 2), ("field", 10)}
    (tmp_path / "mask" / "other_1.bin").write_bytes(b"x")
    with pytest.raises(Exception):
        A.catalog(spark, str(tmp_path)).collect()
    assert A.frame_of("a1234567890") is None and A.frame_of("x_012") == 12


def test_stages(spark, tmp_path):
    df = spark.range(10).selectExpr("id as t", "id * 2 as v")
    A.save_stage(df, str(tmp_path), "units", {"close": 1})
    back, note = A.load_stage(spark, str(tmp_path), "units")
    assert back.count() == 10 and note == {"params": {"close": 1}, "rows": 10}
    assert sorted(r["t"] for r in A.sampled_frames(df, "t", 4).collect()) == [0, 4, 8, 9]


def test_parameters(spark):
    allowed = [V.Parameter("frame", int, 0, 9, required=True), V.Parameter("q", str, choices=("dx", "mag"), default="mag"), V.Parameter("arrows", bool, default=False)]
    assert V.parse({"frame": "3", "arrows": "1"}, allowed) == {"frame": 3, "q": "mag", "arrows": True}
    for bad, name in (({"frame": "x"}, "frame"), ({"frame": "12"}, "frame"), ({}, "frame"), ({"frame": "1", "z": "2"}, "z"), ({"frame": "1", "q": "dz"}, "q")):
        with pytest.raises(V.BadParameter) as e:
            V.parse(bad, allowed)
        assert e.value.name == name
    f = spark.createDataFrame([(0, x, 0, float(x), 0.0) for x in range(11)], "t int, x int, y int, dx double, dy double")
    rows = {r["x"]: r["level"] for r in V.plane(f, 0, low=0, high=100).collect()}
    assert rows[0] == 0 and rows[10] == 255
    with pytest.raises(V.BadParameter):
        V.plane(f, 5)
    assert V.select(f, "x", spark.createDataFrame([(1,), (2,)], "i int")).count() == 2
