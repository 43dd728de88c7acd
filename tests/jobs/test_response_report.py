"""The report: reruns, the span, rows that don't count; its numbers are held against SQL in test_job_queries.py."""

import dataclasses
import datetime
import os
import subprocess
import sys
from pathlib import Path

from jobs import response_report
from jobs.response_report import Settings

ROOT = Path(__file__).resolve().parent.parent.parent


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def day(n):
    return datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(days=n)


def events():
    """Site 1 moves on days 10 and 20 and is answered by the channel "calcium" one day later."""
    rows = [(day(t), 1, "view", 1.0 + t % 2) for t in range(30)] + [(day(29), 7, "calcium", None)]
    rows += [(day(t), 1, "view", 50.0) for t in (10, 20)] + [(day(t + 1), 1, "calcium", 3.0) for t in (10, 20)]
    return rows + [(None, 1, "calcium", 1.0), (day(3), None, "calcium", 1.0), (day(3), 1, None, 1.0), (day(-4), 1, "calcium", 9.0)]


SCHEMA = "ts timestamp, user_id long, event_type string, value double"
CONFIG = Settings(window=1, lags=(-1, 0, 1, 2), extend=0)


def test_answers(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(*r, 1, 2.0) for r in events()], SCHEMA + ", site int, v double").write.parquet(path)
    got = {(r["site"], r["lag"]): r for r in response_report.run(spark, path, out, CONFIG).collect()}
    assert [(got[1, k]["windows"], got[1, k]["hits"]) for k in (-1, 0, 1, 2)] == [(2, 0), (2, 0), (2, 2), (2, 0)]
    assert got[1, 1]["channel"] == "calcium" and got[1, 1]["baseline"] == round(2 / 30, 6) and got[1, 1]["p_value"] == round((2 / 30) ** 2, 6)
    assert got[7, 1]["hits"] == 0 and got[7, 1]["baseline"] == 0.0 and got[7, 1]["p_value"] == 1.0
    found = spark.read.parquet(f"{out}/episodes").collect()
    assert [(r["roi"], r["t0"], r["t1"], r["units"]) for r in sorted(found, key=lambda r: r["t0"])] == [(0, 10, 10, 1), (0, 20, 20, 1)]


def test_folders_do_not_follow_the_regions(spark, tmp_path):
    """Sixty regions in a bounded number of folders; a rerun that finds fewer episodes keeps none of those before."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(ts, site + k, kind, v) for ts, site, kind, v in events() if site is not None for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    config = dataclasses.replace(CONFIG, width=1)
    first = rows_of(response_report.run(spark, path, out, config))
    found = spark.read.parquet(f"{out}/episodes")
    assert len([p for p in (tmp_path / "out" / "episodes").iterdir() if p.is_dir()]) <= response_report.PARTS < 60
    assert rows_of(found.select("roi", "t0", "t1")) == sorted(((k, t, t) for k in range(1, 61) for t in (10, 20)), key=repr)
    assert rows_of(response_report.run(spark, path, out, config)) == first
    few = str(tmp_path / "few")
    spark.read.parquet(path).where("user_id < 4").write.parquet(few)
    response_report.run(spark, few, out, config)
    assert rows_of(spark.read.parquet(f"{out}/episodes").select("roi").distinct()) == [(1,), (2,), (3,)]


def test_reruns_and_spans(spark, sf_dir, tmp_path):
    path, out = f"{sf_dir}/events.parquet", str(tmp_path / "out")
    first = rows_of(response_report.run(spark, path, out))
    assert first and rows_of(response_report.run(spark, path, out)) == first
    folders = sorted(p.name for p in (tmp_path / "out" / "responses").iterdir() if p.is_dir())
    assert folders == ["channel=click", "channel=error", "channel=purchase", "channel=signup"]
    half = response_report.run(spark, path, str(tmp_path / "half"), Settings(until="2024-01-16"))
    cut = str(tmp_path / "cut")
    spark.read.parquet(path).where("ts < '2024-01-16'").write.parquet(cut)
    assert rows_of(half) == rows_of(response_report.run(spark, cut, str(tmp_path / "other"), Settings(until="2024-01-16"))) != first


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert response_report.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect() == []


def test_command_line(spark, sf_dir, tmp_path):
    """As a user runs it, with its own session; the tables are those of the function."""
    command = [sys.executable, "-m", "jobs.response_report", "--input", f"{sf_dir}/events.parquet", "--output", str(tmp_path / "cli"), "--config", "jobs/response_report.toml"]
    done = subprocess.run(command, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows" in done.stderr and "responses" in done.stderr
    want = rows_of(response_report.run(spark, f"{sf_dir}/events.parquet", str(tmp_path / "own")))
    assert rows_of(spark.read.schema(response_report.RESPONSES).parquet(str(tmp_path / "cli" / "responses"))) == want
