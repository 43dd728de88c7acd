"""Removal of passages that documents share, by repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it also starts
in a document with a smaller id; the smallest such document owns the window.

1. Anchors: of each window the word run with the smallest hash. Equal windows have equal anchors, so a window
   none of whose anchor's other documents exist can't recur; anchors found in one document only fall away.
2. Confirmation: windows with a recurring anchor are counted by 128 bits made of their words' digests; one that lies in two
   documents is confirmed, with its owner and its place there. Consecutive windows of an owner form its passages, in parts of
   ``PART`` windows at most.
3. Automata: passages, as the owner's own words, are compiled into Aho-Corasick automata, one for each shard, from
   every (window + 1) // 2 words of them (each window holds one such phrase whole), words being single symbols. Every
   document streams through its shard's automaton, which locates the occurrences; every phrase found is extended,
   word by word as written, as far as the passage and the document agree, and what reaches a window's length is
   removed. Digests name the owners; what goes, and where, the words themselves decide.

Which automaton a document meets: all of them would cost documents times passages, so shards go with the documents.
A shard is a batch of documents with the passages, cut to the windows in question, that some document of it may
hold by the confirmation; all documents of the batch stream through it, also those for which nothing was proposed.
With ``everywhere`` there are no proposals: passages are dealt into shards of ``SHARD_WORDS`` words and all documents
stream through every shard in turn (a pass each), which is the plain method for a phrase table of modest size; both
give the same result.

Counts and confirmations are aggregates and joins whose hot keys Spark splits. A batch is at most SEGMENT bytes of
text or one document; the words of the passages routed to it are at most about PART / window times its own, so the
largest document bounds a task's memory.

Cases: null text has no words; a document shorter than a window is kept whole; repeats inside one document
alone stay; rows that repeat an id are one document (its windows do not repeat each other); an empty table gives
no rows; further columns are ignored; a document without an id is kept whole and is nobody's owner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, carried, shingle_hashes, slices, utf8, word_hashes

WINDOW, RUN = 13, 5
PART = 256  # windows of a passage at most
SHARD_WORDS = 500_000  # of a shard's passages
SYMBOLS = 1_000_000  # words that an automaton tells apart


def _windows(column: pa.Array, window: int, run: int) -> tuple[np.ndarray, ...]:
    """Of all windows of all rows: row, place, anchor hash; and both halves of the words' digests and the words' offsets by row."""
    words, at, second = word_hashes(*utf8(column), wide=True)
    n = np.diff(at)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), words, second, at
    runs = shingle_hashes(words, run)
    span = window - run + 1
    least, reach = runs, 1
    while reach * 2 <= span:  # minimum over `reach` runs from each place on
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    count = np.maximum(0, n - window + 1)
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, place, least[at[row] + place] if len(row) else np.zeros(0, np.uint64), words, second, at


def _confirmed(spark: SparkSession, texts: DataFrame, scratch: Scratch, window: int, run: int) -> tuple[DataFrame, DataFrame]:
    """Passages (owner, place, n): n consecutive windows of the owner from the word at place on, each of them in a later
    document too; and routes (doc_id, owner, place, lo, hi) of the documents that may hold a window of a passage: those
    at the owner's words lo to hi."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                row, _, anchor, *_ = _windows(some.column("text"), window, run)
                fresh = np.ones(len(row), bool)  # neighbours mostly share theirs
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                row, anchor = row[fresh], anchor[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), some.column("doc_id").take(pa.array(row))], names=["anchor", "doc_id"])

    found = scratch.write(texts.mapInArrow(anchors, "anchor long, doc_id long"), "anchors")
    recurring = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    recurring = scratch.write(recurring, "recurring")
    held = found.join(recurring, "anchor").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("anchor").alias("anchors"))
    held = scratch.write(held, "held")
    scratch.drop("anchors", "recurring")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                row, place, anchor, words, second, at_row = _windows(some.column("text"), window, run)
                known = np.unique(some.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                of_windows = shingle_hashes(words, window), shingle_hashes(second, window)
                found = np.searchsorted(known, anchor)
                keep = known[np.minimum(found, len(known) - 1)] == anchor
                row, place = row[keep], place[keep]
                low, high = (h[at_row[row] + place] for h in of_windows)
                order = np.lexsort((place, high, low, row))  # of a window that a document repeats, the first
                row, place, low, high = row[order], place[order], low[order], high[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[fresh].view(np.int64)), pa.array(high[fresh].view(np.int64)), some.column("doc_id").take(pa.array(row[fresh])), pa.array(place[fresh])], names=["w", "w2", "doc_id", "place"]
                )

    rows = texts.join(held, texts["doc_id"] == held["id"]).select("doc_id", "text", "anchors")
    rows = scratch.write(rows.mapInArrow(candidates, "w long, w2 long, doc_id long, place long"), "candidates")
    scratch.drop("held")
    owned = rows.groupBy("w", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi"), F.min_by("place", "doc_id").alias("at")).where("owner < hi")
    owned = scratch.write(owned.select("w", "w2", "owner", "at"), "owned")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The passage of each confirmed window: the run of its owner's windows that it is in, by its first word."""
        for batch in batches:  # a run that two batches share becomes two; each window is in one of them
            owner, at = batch.column("owner").to_numpy(), batch.column("at").to_numpy()
            fresh = np.ones(len(at), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (np.diff(at) != 1)
            first = at[fresh][np.cumsum(fresh) - 1]
            first += (at - first) // PART * PART
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("w2"), batch.column("owner"), pa.array(first), batch.column("at")], names=["w", "w2", "owner", "first", "at"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = owned.repartition(n, "owner").sortWithinPartitions("owner", "at").mapInArrow(runs, "w long, w2 long, owner long, first long, at long")
    owned = scratch.write(owned, "runs")
    scratch.drop("owned")
    passages = scratch.write(owned.groupBy("owner", F.col("first").alias("place")).agg(F.count("*").alias("n")), "passages")
    routes = rows.select("w", "w2", "doc_id").join(owned, ["w", "w2"]).where("doc_id > owner").groupBy("doc_id", "owner", F.col("first").alias("place"))
    routes = routes.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    routes = scratch.write(routes, "routes")
    scratch.drop("candidates", "runs")
    return passages, routes


def split(text: str | None) -> list[bytes]:
    """Words of a text: bytes.split cuts at just the blanks \\x20 and \\x09-\\x0D."""
    return (text or "").encode().split()


def _common(a: str, i: int, b: str, j: int, step: int) -> int:
    """How many symbols agree from a[i] and b[j] on, forwards (step 1) or backwards (-1)."""
    n, most = 0, min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
    while n < most:
        k = min(32, most - n)
        if (a[i + n : i + n + k] == b[j + n : j + n + k]) if step > 0 else (a[i - n - k + 1 : i - n + 1] == b[j - n - k + 1 : j - n + 1]):
            n += k
            continue
        while n < most and a[i + n * step] == b[j + n * step]:
            n += 1
        break
    return n


class Shard:
    """An automaton over passages; words are single symbols of its own alphabet."""

    def __init__(self, window: int, passages: dict[bytes, int]):
        """passages: text to smallest owner."""
        self.window, self.phrase = window, (window + 1) // 2
        self.symbols: dict[bytes, str] = {}
        self.passages, self.owners = [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for text, owner in passages.items():
            coded = self.code(text.split(), learn=True)
            self.passages.append(coded)
            self.owners.append(owner)
            for at in range(0, len(coded) - self.phrase + 1, self.phrase):
                places.setdefault(coded[at : at + self.phrase], []).append((len(self.passages) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, where in places.items():
            self.automaton.add_word(phrase, where)
        if places:
            self.automaton.make_automaton()
        self.empty = not places
        self.known = re.compile(f"[^\0]{{{window},}}")

    def code(self, words: list[bytes], learn: bool = False) -> str:
        if learn:
            for w in words:
                if w not in self.symbols:
                    n = len(self.symbols) + 1
                    self.symbols[w] = chr(n if n < 0xD800 else n + 0x800)
        get = self.symbols.get
        return "".join([get(w, "\0") for w in words])

    def covered(self, doc_id: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans of words that belong to a window of a passage whose owner is smaller than doc_id."""
        if self.empty or len(words) < self.window:
            return []
        text, seen, spans = self.code(words), {}, []
        for known in self.known.finditer(text):  # between words that no passage has, an occurrence fits in
            for end, where in self.automaton.iter(text, known.start(), known.end()):
                start = end - self.phrase + 1
                for p, at in where:
                    if self.owners[p] >= doc_id or seen.get((p, start - at), -1) >= end:
                        continue
                    passage = self.passages[p]
                    right = end + _common(text, end + 1, passage, at + self.phrase, 1)
                    left = start - _common(text, start - 1, passage, at - 1, -1) if start and at else start
                    seen[p, start - at] = right
                    if right - left + 1 >= self.window:
                        spans.append((left, right + 1))
        return spans


def shards(window: int, passages: dict[bytes, int]) -> list[Shard]:
    """Automata over all passages: one, unless they have more words than an alphabet has symbols."""
    out, some, room = [], {}, SYMBOLS
    for text, owner in passages.items():
        n = text.count(b" ") + 1
        if n > room and some:
            out.append(Shard(window, some))
            some, room = {}, SYMBOLS
        some[text], room = owner, room - n
    return [*out, Shard(window, some)] if some else out


def _united(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _covered(automata: list[Shard], doc_id: int | None, words: list[bytes]) -> list[list[int]]:
    """Disjoint spans of a document's words that the automata's passages cover; without an id none."""
    return [] if doc_id is None else _united([x for s in automata for x in s.covered(doc_id, words)])


SPANS = "array<struct<start:long,stop:long>>"
SPAN_LIST = pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()}))


def _by_routes(texts: DataFrame, routes: DataFrame, quoted: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Each batch of documents through an automaton of what was proposed for any of them."""
    words = F.split("passage", " ", -1)
    part = F.array_join(F.slice(words, (F.col("lo") - F.col("place") + 1).cast("int"), (F.col("hi") - F.col("lo") + window).cast("int")), " ")
    to = routes.join(quoted, ["owner", "place"]).select(F.col("doc_id").alias("to"), F.struct("owner", part.alias("passage")).alias("p"))
    to = scratch.write(to.groupBy("to").agg(F.collect_set("p").alias("passages")), "to")
    scratch.drop("quoted", "routes")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                routed: dict[bytes, int] = {}
                for row in some.column("passages").to_pylist():
                    for x in row or ():
                        passage = x["passage"].encode()
                        routed[passage] = min(x["owner"], routed.get(passage, x["owner"]))
                automata = shards(window, routed)
                out = []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    words = split(text)
                    out.append(_kept(doc_id, words, _covered(automata, doc_id, words)))
                yield _batch(out, some.column("carry"))

    rows = texts.join(to, texts["doc_id"] == to["to"], "left").select("doc_id", "text", "passages", "carry")
    return rows.mapInArrow(stream, RESULT)


RESULT = f"doc_id long, n_words long, n_removed long, kept string, spans {SPANS}, carry long"


def _kept(doc_id: int | None, words: list[bytes], spans: list[list[int]]) -> tuple:
    at, kept = 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return doc_id, len(words), len(words) - len(kept), b" ".join(kept), [{"start": a, "stop": b} for a, b in spans]


def _batch(out: list[tuple], carry: pa.Array) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), SPAN_LIST]
    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    columns[3] = columns[3].cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, carry], names=["doc_id", "n_words", "n_removed", "kept", "spans", "carry"])


def _everywhere(spark: SparkSession, texts: DataFrame, quoted: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Every document through every shard of all passages, a pass for each shard."""
    size = quoted.agg(F.sum(F.size(F.split("passage", " ", -1)))).first()[0] or 0
    parts = -(-size // SHARD_WORDS)
    numbered = scratch.write(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    quoted = quoted.withColumn("shard", F.pmod(F.xxhash64("owner", "place"), F.lit(max(1, parts))))
    found = None
    for i in range(parts):  # a shard's passages have about SHARD_WORDS words
        passages: dict[bytes, int] = {}
        for r in quoted.where(F.col("shard") == i).select("owner", "passage").toLocalIterator():
            passage = r["passage"].encode()
            passages[passage] = min(r["owner"], passages.get(passage, r["owner"]))
        shared = spark.sparkContext.broadcast(passages)

        def stream(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automata = shards(window, shared.value)
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True)
                out = [(row, [{"start": a, "stop": b} for a, b in _covered(automata, doc_id, split(text))]) for row, doc_id, text in rows]
                out = [x for x in out if x[1]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], SPAN_LIST)], names=["row", "spans"])

        one = scratch.write(numbered.mapInArrow(stream, f"row long, spans {SPANS}"), f"spans-{i}")
        found = one if found is None else found.unionByName(one)
        shared.unpersist()
    spans = found.groupBy(F.col("row").alias("of")).agg(F.flatten(F.collect_list("spans")).alias("spans")) if found is not None else spark.createDataFrame([], f"of long, spans {SPANS}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True)
                yield _batch([_kept(doc_id, split(text), _united([(x["start"], x["stop"]) for x in s or ()])) for doc_id, text, s in rows], batch.column("carry"))

    return numbered.join(spans, numbered["row"] == spans["of"], "left").select("doc_id", "text", "spans", "carry").mapInArrow(cut, RESULT)


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, everywhere: bool = False, carry: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): kept words joined by one space; spans of the words removed.
    carry: a column to hand through."""
    scratch = Scratch(spark, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(docs, carry))
    passages, routes = _confirmed(spark, texts, scratch, window, min(RUN, window))
    wanted = passages.groupBy(F.col("owner").alias("id")).agg(F.collect_list(F.struct("place", "n")).alias("parts"))  # as long as the owner's text

    def quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                out: list[tuple[int, int, bytes]] = []
                for owner, text, parts in zip(*(some.column(c).to_pylist() for c in ("id", "text", "parts")), strict=True):
                    words = split(text)
                    out += [(owner, x["place"], b" ".join(words[x["place"] : x["place"] + x["n"] + window - 1])) for x in parts]
                if out:
                    owners, places, quotes = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(places, pa.int64()), pa.array(quotes, pa.binary()).cast(pa.string())], names=["owner", "place", "passage"])

    quoted = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("id", "text", "parts").mapInArrow(quote, "owner long, place long, passage string")
    quoted = scratch.write(quoted, "quoted")
    found = _everywhere(spark, texts, quoted, scratch, window) if everywhere else _by_routes(texts, routes, quoted, scratch, window)
    return found if carry else found.drop("carry")
