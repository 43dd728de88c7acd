import hashlib
import struct

import pytest
import zstandard

from kinegrid.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and first[h or ""] < i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big = "<p>é payload</p>" * 20
    rows = [(5, "http://a.b/c?d=1", big), (2, None, big), (9, "http://x y\n/é%20", big), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\n" * 40), (1, "u", "x" * 300000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives = warc.write_archives(spark, df)
    got = warc.read_archives(spark, archives).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows)
    html, urls = {i: h for i, _, h in rows}, {i: u for i, u, _ in rows}
    for r in got:
        assert r["record_type"] == "revisit" or bytes(r["payload"]).decode() == (html[r["page_id"]] or "")
        assert r["url"] == (urls[r["page_id"]] or f"urn:page:{r['page_id']}")


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "u", "x" * 200)], "page_id long, url string, html string")
    assert [r["page_id"] for r in warc.read_archives(spark, warc.write_archives(spark, df)).collect()] == [None]
    assert warc.read_archives(spark, warc.write_archives(spark, df.limit(0))).collect() == []


def test_archives_roll_over(spark):
    import random

    rng = random.Random(0)
    rows = [(i, "u", "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(60000))) for i in range(60)]
    archives = warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), archive_mb=1)
    assert archives.manifest.count() > 1 and warc.read_archives(spark, archives).count() == 60


def frame(data, **k):
    return zstandard.ZstdCompressor(**k).compress(data)


def test_dictionary_plain_or_compressed():
    record = warc.record_bytes(1, "u", b"payload " * 30)
    words = zstandard.ZstdCompressionDict(b"WARC/1.1 payload Content-Length: " * 40)
    body = frame(record, dict_data=words)
    plain = struct.pack("<II", warc.SKIPPABLE, len(words.as_bytes())) + words.as_bytes()
    for head in (plain, warc.leading_frame(words.as_bytes())):
        assert list(warc.frames(head + body + body)) == [record, record]
    assert list(warc.frames(frame(record))) == [record]


GOOD = warc.record_bytes(3, "http://a", b"hello " * 30)


@pytest.mark.parametrize("change", [lambda b: b[:-1], lambda b: b + b"x", lambda b: b.replace(b"WARC/1.1", b"WARC/9"), lambda b: b.replace(b"hello", b"jello", 1), lambda b: b.replace(b"WARC-Date:", b"WARC Date:"), lambda b: b.replace(b"WARC-Date: ", b"WARC-Type: "), lambda b: b.replace(b"<urn:page:3>", b"urn:page:3")])
def test_damaged_records(change):
    assert warc.parse_record(GOOD)["page_id"] == 3
    with pytest.raises(ValueError):
        warc.parse_record(change(GOOD))


def test_damaged_frames():
    data = warc.leading_frame(b"d" * 300)
    for bad in (data[:-1], data + b"junk", data + frame(GOOD)[:-4]):
        with pytest.raises(ValueError):
            list(warc.frames(bad))


def test_records_of_other_writers():
    """A warcinfo record is passed over, an id that names no page is kept as it is."""
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert warc.parse_record(info) is None
    got = warc.parse_record(GOOD.replace(b"urn:page:3", b"urn:uuid:3"))
    assert got["page_id"] is None and got["record_id"] == "<urn:uuid:3>"


def test_frames_of_many_sizes():
    import random

    records = [random.Random(n).randbytes(n) for n in (1, 4000, 5000, 70000, 3 << 20, 10)]
    assert list(warc.frames(b"".join(frame(r) for r in records))) == records
