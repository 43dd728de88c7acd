"""The incremental job: growing input, reruns, a batch that is cut short, edge cases."""

import statistics

import pytest

from jobs import common, frame_quality
from jobs.frame_quality import MEASURES, Settings

NAMES = ["doc_id", "source", *MEASURES, "n_out", "reasons"]


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def brute(docs, spread):
    """Measures and limits by plain Python."""
    import regex

    frames = []
    for i, t, s in docs:
        t = t or ""
        words, lines = regex.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        chars = sum(map(len, words))
        m = [
            len(words), 1000 * len(regex.findall(r"\p{L}", t)) // chars if chars else 0, 1000 * len(set(words)) // len(words) if words else 0,
            100 * chars // len(words) if words else 0, 1000 - 1000 * len(set(lines)) // len(lines),
        ]
        frames.append((i, s or "none", m))
    out = []
    for i, s, m in frames:
        reasons = []
        for k, name in enumerate(MEASURES):
            v = [x[2][k] for x in frames if x[1] == s]
            med = statistics.median(v)
            mad = 1.4826 * statistics.median(abs(x - med) for x in v)
            if abs(m[k] - med) > spread * (mad or statistics.pstdev(v)) + 1e-9:
                reasons.append(name)
        out.append((i, s, *m, len(reasons), ",".join(reasons)))
    return sorted(out, key=repr)


DOCS = [(i, f"word{i} and more words of frame {i}\nline\nline", f"s{i % 3}") for i in range(60)]
DOCS += [(100, None, "s0"), (101, "", "s0"), (102, "x " * 50_000, "s1"), (103, "été où ça\n" * 9, None), (104, "12 34 !!", ""), (5, DOCS[5][1], "s2"), (None, "a frame without a number", "s1")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def table(tmp_path, spark):
    """A table that grows: each call adds a file of rows with further columns, named like the job's own."""

    def add(rows):
        df = spark.createDataFrame([(*r, 9, "b") for r in rows], SCHEMA + ", part int, batch string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return str(tmp_path / "in")

    return add


def test_two_runs_over_growing_input(spark, table, tmp_path):
    config, out = Settings(parts=3, files=1), str(tmp_path / "out")
    path = table(DOCS[:30])
    assert rows_of(frame_quality.run(spark, path, out, config)) == brute(DOCS[:30], 3.5)
    table(DOCS[30:])
    whole = rows_of(frame_quality.run(spark, path, out, config))
    assert whole == brute(DOCS, 3.5) and any(r[-2] for r in whole)
    taken = spark.read.parquet(f"{out}/measures").groupBy("batch").count().collect()
    assert sorted((r["batch"], r["count"]) for r in taken) == [(0, 30), (1, len(DOCS) - 30)]  # each frame measured once
    assert rows_of(frame_quality.run(spark, path, out, config)) == whole
    assert rows_of(frame_quality.run(spark, path, str(tmp_path / "once"), Settings(parts=5))) == whole
    norms = spark.read.parquet(f"{out}/norms").where("source = 's0' and measure = 'n_words'").collect()
    assert len(norms) == 1 and norms[0]["n"] == sum(s == "s0" for _, _, s in DOCS)


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_batch_cut_short_is_taken_again(spark, table, tmp_path, monkeypatch, fails_at):
    config, out, path, calls, put = Settings(parts=2), str(tmp_path / "out"), table(DOCS[:40]), [], common.put
    frame_quality.run(spark, path, out, config)
    table(DOCS[40:])

    def failing(*a):
        calls.append(a)
        if len(calls) == fails_at:
            raise OSError("a lost driver")
        put(*a)

    monkeypatch.setattr(common, "put", failing)
    with pytest.raises(Exception, match="a lost driver"):
        frame_quality.run(spark, path, out, config)
    monkeypatch.setattr(common, "put", put)
    assert rows_of(frame_quality.run(spark, path, out, config)) == brute(DOCS, 3.5)


def test_a_table_without_rows(spark, table, tmp_path):
    found = frame_quality.run(spark, table([]), str(tmp_path / "out"))
    assert found.collect() == [] and {*NAMES, "part"} == set(found.columns)


def test_settings(spark, tmp_path):
    assert common.settings(spark, Settings, None) == Settings()
    assert common.settings(spark, Settings, "jobs/frame_quality.toml") == Settings(3.5, 16, 1000)
    for text in ("sprad = 1.0", "parts = 1.5", "parts = true", "spread = 'x'"):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(ValueError):
            common.settings(spark, Settings, str(tmp_path / "c.toml"))


def test_paths_as_uris(spark, table, tmp_path):
    """Inputs and outputs by URI, with and without a slash at the end, and by a pattern."""
    path = table(DOCS)
    for i, source in enumerate((f"file://{path}", f"file://{path}/", f"file://{path}/*.parquet")):
        assert rows_of(frame_quality.run(spark, source, f"file://{tmp_path}/uri{i}", Settings(parts=2))) == brute(DOCS, 3.5)


def test_norms_are_not_planned_with_broadcasts(spark, tmp_path, monkeypatch):
    """The planner's estimate of exploded measures is too small to broadcast by, so sizes are left to the run."""
    plans, norms = [], frame_quality.norms

    def seen(frames, spread):
        df = norms(frames, spread)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(frame_quality, "norms", seen)
    spark.createDataFrame([(i, "a b", f"s{i % 3}") for i in range(30)], frame_quality.INPUT).write.parquet(f"{tmp_path}/in")
    before = [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
    assert frame_quality.run(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 30
    assert before == [spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")]
    assert plans and all("Join" in p and "BroadcastHashJoin" not in p for p in plans)
