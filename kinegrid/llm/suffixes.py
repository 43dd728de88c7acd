"""Removal of byte strings that occur twice, by common-prefix interval trees over sparse suffix arrays.

A string of ``least`` bytes that starts at two places (of one text or of two) is a repeat, and all bytes that repeats
cover go, at every occurrence. Texts are UTF-8 bytes; repeats end at a text's end.

1. Anchors: of each window of ``least`` bytes the leftmost gram of GRAM bytes with the smallest hash. Equal windows have
   equal anchors at equal offsets, so only suffixes that start at equal anchors need comparing. The windows of one
   anchor lie side by side; they and what they cover are its region, kept as (place, length, digest of the bytes).
2. Classes: regions are counted by anchor, and where an anchor recurs by digest, each class with one of its places. Regions
   of a class with two places are repeats as they stand; their one place stands for them from here on.
3. Interval trees: the classes of an anchor are an array of suffixes, sorted, with the common prefix of each
   neighbour. A scan with a stack gives all common-prefix intervals, which are the right-maximal strings with all
   their occurrences. The members of an interval are sorted by what precedes the anchor, and a second scan over
   these common left extensions splits them where they turn diverse: each part that is long enough and still stops
   agreeing on the right where the interval does is a maximal repeat. All members of a part are occurrences.
4. Busy anchors: those with more than BUCKET classes (a passage with other surroundings each time, or copies each with a
   change of its own) are dealt anew, windows that start at 64 neighbouring offsets together, by a digest of the
   bytes that these have in common; where that leaves too many 8 together, then each window by itself, so that only equal
   ones meet. So a task holds at most BUCKET regions of under 2 * least bytes at once, whatever the number of
   copies, and nothing is dropped.

Gram hashes only propose. Two regions (windows, at the last step) are taken as equal where 128 bits of BLAKE2b are; others
are compared byte by byte. Counts are aggregates that Spark combines before it shuffles; a text and its own places
must fit a worker. Repeats longer than a region are found region by region: their union is the same.

Cases: null text is empty; shorter texts than ``least`` stay whole; a cut may leave parts of a character, so what is kept is
binary; rows are texts of their own whatever their ids, null and repeated ones included; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, slices, utf8

LEAST, GRAM = 400, 64
BUCKET = 256  # different regions of an anchor that are compared in one array
STEPS = (64, 8, 1)  # offsets that stay together when a busy anchor is dealt anew
PLACES = "anchor long, d1 long, d2 long, row long, at long, n long, left long"


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on (k a power of two)."""
    h, size = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while size < k:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 ^ (size << 1)) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    return mix(h)


def _minima(h: np.ndarray, span: int) -> np.ndarray:
    least, reach = h, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(least) - (span - reach)], least[span - reach :]) if reach < span else least


def regions(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, anchor hash, place of the anchor, first and last window start), ascending, of all texts end to end."""
    if len(data) < least:
        return
    span = least - gram + 1
    h = _grams(data, gram)
    minima = _minima(h, span)
    for text in np.flatnonzero(np.diff(offsets) >= least).tolist():
        lo, hi = int(offsets[text]), int(offsets[text + 1]) - least  # first and last window
        m = minima[lo : hi + 1]
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1 + lo
        for s0, s1 in zip([lo, *cuts.tolist()], [*(cuts - 1).tolist(), hi], strict=True):
            value = minima[s0]
            before = s0
            for c in (np.flatnonzero(h[s0 : s1 + span] == value) + s0).tolist():
                if before > s1:
                    break
                yield text, int(value), c, before, min(s1, c)  # ties: the leftmost at or after a window's start
                before = c + 1


def _digest(raw: bytes) -> tuple[int, int]:
    d = blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "d1", "d2", "row", "at", "n", "left"])


def _anchored(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """PLACES of all texts: n windows from byte ``at`` on, whose anchor lies ``left`` bytes further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                data, offsets = utf8(some.column("text"))
                raw, ids, out = data.tobytes(), some.column("row").to_pylist(), []
                for text, value, c, lo, hi in regions(data, offsets, least, gram):
                    value -= (value >> 63) << 64
                    out.append((value, *_digest(raw[lo : hi + least]), ids[text], lo - int(offsets[text]), hi - lo + 1, c - lo))
                yield _places(out)

    return texts.select("row", "text").mapInArrow(run, PLACES)


def _asked(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with the places asked for, as many as a text's own regions at most."""
    asked = places.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("anchor", "d1", "d2", "at", "n", "left", "busy")).alias("asked"))
    return texts.join(asked, texts["row"] == asked["of"]).select("row", "text", "asked")


def _read(asked: DataFrame, least: int, step: int) -> DataFrame:
    """PLACES and bytes: of places that aren't busy, what their region holds; of busy ones, without bytes, the windows that
    start at ``step`` neighbouring offsets before the anchor, by the bytes that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                out, quotes = [], []
                for row, text, places in zip(*(some.column(c).to_pylist() for c in ("row", "text", "asked")), strict=True):
                    raw = text.encode()
                    for p in places:
                        first, last, c = p["at"], p["at"] + p["n"] - 1, p["at"] + p["left"]
                        if not p["busy"]:
                            out.append((p["anchor"], p["d1"], p["d2"], row, first, p["n"], p["left"]))
                            quotes.append(raw[first : last + least])
                            continue
                        for j in range((c - last) // step, (c - first) // step + 1):
                            lo, hi = max(first, c - (j + 1) * step + 1), min(last, c - j * step)
                            shared = raw[c - j * step : max(0, c - (j + 1) * step + 1 + least)]
                            key = _digest(b"%d %d " % (p["anchor"], j) + shared)[0]
                            out.append((key, *_digest(raw[lo : hi + least]), row, lo, hi - lo + 1, c - lo))
                            quotes.append(None)
                places = _places(out)
                yield pa.RecordBatch.from_arrays([*places.columns, pa.array(quotes, pa.binary())], names=[*places.schema.names, "bytes"])

    return asked.mapInArrow(run, PLACES + ", bytes binary")


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    lo = 0  # a[:lo] == b[:lo], and they differ within most
    while most - lo > 1:
        mid = (lo + most) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            most = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Of neighbours' common prefixes (lcp[i] of members i and i + 1) all intervals: length, first and last member."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            yield length, first, i
        if not stack or stack[-1][0] < v:
            stack.append((v, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, members): the strings of l + r >= least bytes, l of them left of the anchor, that can't be extended to either
    side without losing one of their members. lefts are read from the anchor leftwards."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    rank, place = [0] * len(order), [0] * len(order)
    for i, p in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__)):
        rank[p] = i
    for i, p in enumerate(order):
        place[p] = i
    longest = max(map(len, lefts), default=0)
    for r, first, last in intervals(lcp):
        if r + longest < least:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        extensions = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for l, a, b in intervals(extensions):
            if l + r >= least:
                some = members[a : b + 1]
                at = [place[p] for p in some]
                if min(lcp[min(at) : max(at)]) == r:  # else it belongs to a deeper interval
                    yield l, r, some


def _compared(quoted: DataFrame, least: int, all_groups: bool) -> DataFrame:
    """(anchor, d1, d2, row, lo, hi, g): spans of the regions that are repeats, lo and hi counted in their text. By group
    within an anchor where all_groups, and of every region; else united, and of regions that are the only one of their kind."""

    def bucket(rows: list[dict]) -> Iterator[tuple]:
        lefts = [r["bytes"][: r["left"]][::-1] for r in rows]
        rights = [r["bytes"][r["left"] :] for r in rows]
        spans: list[list[tuple[int, int, int]]] = [[(0, len(r["bytes"]), i)] if r["count"] > 1 else [] for i, r in enumerate(rows)]
        for g, (l, r, members) in enumerate(maximal_repeats(lefts, rights, least), len(rows)):
            for p in members:
                spans[p].append((rows[p]["left"] - l, rows[p]["left"] + r, g))
        for r, found in zip(rows, spans, strict=True):
            if not all_groups:
                found = [(a, b, 0) for a, b in united([(a, b) for a, b, _ in found])] if r["count"] == 1 else []
            yield from ((r["anchor"], r["d1"], r["d2"], r["row"], r["at"] + a, r["at"] + b, g) for a, b, g in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["anchor"] != held[0]["anchor"]:
                    out += bucket(held)
                    held = []
                held.append(r)
            yield spans_of(out)
            out = []
        yield spans_of(list(bucket(held)) if held else [])

    def spans_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "d1", "d2", "row", "lo", "hi", "g"])

    n = int(quoted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return quoted.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, d1 long, d2 long, row long, lo long, hi long, g long")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, ascending; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _occurrences(spark: SparkSession, scratch: Scratch, texts: DataFrame, least: int, all_groups: bool) -> DataFrame:
    """(row, start, stop, repeat): occurrences of repeats; without all_groups united by region and without a name."""
    gram = min(GRAM, 1 << (least.bit_length() - 1))
    digest = ["anchor", "d1", "d2"]
    parts, places = [], scratch.write(_anchored(texts, least, gram), "places")
    for level, step in enumerate([*STEPS, None]):
        # written, so that the join below has nothing but its two sides in a stage and Spark can split a busy anchor
        twice = scratch.write(places.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"), f"twice{level}")
        again = scratch.write(places.join(twice, "anchor"), f"again{level}")
        if not level:
            scratch.drop("places")
        classes = again.groupBy(*digest).agg(F.count("*").alias("count"), F.min(F.struct("row", "at", "n", "left")).alias("one"))
        classes = scratch.write(classes.select(*digest, "count", "one.*"), f"classes{level}")
        several = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        busy = F.col("kinds") > BUCKET if step else F.lit(False)
        wanted = classes.join(several, "anchor").withColumn("busy", busy)
        if all_groups:  # groups name all their places, so busy anchors are dealt with all of them
            every = again.join(several.where(busy), "anchor").withColumns({"count": F.lit(1).cast("long"), "busy": F.lit(True)})
            wanted = wanted.where("not busy").unionByName(every)
        wanted = scratch.write(wanted, f"wanted{level}")
        read = scratch.write(_read(_asked(texts, wanted), least, step or 1), f"read{level}")
        spans = _compared(read.where("bytes is not null").join(wanted.select(*digest, "count"), digest), least, all_groups)
        spans = scratch.write(spans, f"spans{level}")

        if all_groups:  # by group, at every place: spans lie in a class's one place, and are moved to the others
            ones = classes.join(several, "anchor", "left_anti").select(*digest, "row", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (least - 1)).alias("hi"), F.lit(0).cast("long").alias("g"))
            moved = spans.unionByName(ones).drop("row").join(classes.select(*digest, F.col("at").alias("first")), digest)
            by = F.col("at") - F.col("first")
            name: Column = F.concat_ws("-", F.lit(level), F.hex("anchor"), "g")
            parts.append(again.join(moved, digest).select("row", (F.col("lo") + by).alias("start"), (F.col("hi") + by).alias("stop"), name.alias("repeat")))
        else:
            known = again.join(classes.where("count > 1").select(*digest), digest)
            parts.append(known.select("row", F.col("at").alias("start"), (F.col("at") + F.col("n") + (least - 1)).alias("stop")))
            parts.append(spans.select("row", F.col("lo").alias("start"), F.col("hi").alias("stop")))
        if not step or wanted.where("busy").isEmpty():
            break
        places = read.where("bytes is null").drop("bytes")
    return reduce(DataFrame.unionByName, parts)


def _texts(spark: SparkSession, scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Rows numbered once and for all: later reads must agree on the numbers. In buckets by number: texts are shuffled once."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
    texts.repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd").option("path", scratch.path("texts")).format("parquet").saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: the files and the plan with their buckets stay
    return texts


def repeat_groups(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(repeat, length, doc_id, start): every group of equal strings, maximal within its region, with all occurrences."""
    scratch = Scratch(spark, "suffixes")
    texts = _texts(spark, scratch, docs)
    rows = _occurrences(spark, scratch, texts, least, True)
    return rows.join(texts.select("row", "doc_id"), "row").select("repeat", (F.col("stop") - F.col("start")).alias("length"), "doc_id", "start")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,stop:long>>"


def remove_repeats(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): the bytes that stay, end to end, and the runs removed."""
    scratch = Scratch(spark, "suffixes")
    texts = _texts(spark, scratch, docs)
    rows = _occurrences(spark, scratch, texts, least, False)
    gone = rows.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_kind = pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans_kind]
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                for doc_id, text, places in zip(*(some.column(c).to_pylist() for c in ("doc_id", "text", "gone")), strict=True):
                    raw, at, kept = text.encode(), 0, []
                    spans = united([(p["start"], p["stop"]) for p in places or ()])
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    kept = b"".join([*kept, raw[at:]])
                    out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), kept, [{"start": a, "stop": b} for a, b in spans]))
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return texts.join(gone, texts["row"] == gone["of"], "left").select("doc_id", "text", "gone").mapInArrow(cut, RESULT)
