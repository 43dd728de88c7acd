"""Language ID by prediction by partial matching (PPM).

For each language a byte context tree of order ``ORDER`` is counted on labelled texts and frozen. The
code length of a byte after a context is that of PPM with method C: a byte seen after the context costs
-log2(n / (total + kinds)); otherwise an escape, -log2(kinds / (total + kinds)), and the cost after the
next shorter context; below order 0 all 256 bytes are alike. A context that was never seen escapes for free.
A text gets the language with the shortest exact code over all its bytes.

Frozen statistics make the cost of a byte a function of the last ``ORDER`` + 1 bytes, so scoring is a
table look-up per byte and order, for all languages at once.

Fitting reads a bounded sample: ``sample`` labelled documents of each language (those with the smallest
hash of their ids), whole; counts are merged by task. Of more than ``MAX_LANGUAGES`` labels those with the most
documents are learnt. Scoring reads whole texts.

Cases: null text, empty text and text without a letter give ``und`` with score 0; ties go to the first
language in alphabetical order; repeated rows are predicted alike; an empty table gives no rows; without
labelled texts all predictions are ``und``; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, mix, slices, utf8

UNKNOWN = "und"
ORDER = 3
SAMPLE = 1500
MAX_LANGUAGES = 256
FAR, SLACK, LEAST = 1.5, 256, 20  # of misfits
LETTER = re.compile(r"[^\W\d_]")


def held_out(parts: int, which: int):
    """Whether crc32 of the id as text has this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams of bytes by position of their last byte; a row starts after n - 1 virtual zeros."""
    key = data.astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for i in range(1, n):
        before = np.zeros(len(data), np.uint64)
        before[i:] = data[:-i] if i < len(data) else 0
        before[at < i] = 0
        key |= before << np.uint64(8 * i)
    return key


class Table:
    """Open-addressing hash table from packed grams to rows of a value array, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask, self.values = (1 << bits) - 1, np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot one gets it
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        at = self._slot(keys)
        row = self.slots[at]
        todo = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            row[todo] = self.slots[at[todo]]
            todo = todo[(row[todo] >= 0) & (self.keys[row[todo]] != keys[todo])]
        return row


@dataclass
class Model:
    languages: list[str]
    cost: list[Table]  # by order: code lengths of grams seen in some language, for all languages
    escape: list[Table]  # by order: escape costs of contexts, for all languages

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        each = np.zeros((len(data), len(self.languages)), np.float32)
        todo = np.arange(len(data))
        key = grams(data, offsets, ORDER + 1)
        for n in range(ORDER, -1, -1):
            own = key[todo] & np.uint64((1 << 8 * (n + 1)) - 1)
            row = self.cost[n].find(own)
            seen = row >= 0
            each[todo[seen]] += self.cost[n].values[row[seen]]
            todo, own = todo[~seen], own[~seen]
            each[todo] += self.escape[n].values[self.escape[n].find(own >> np.uint64(8))]  # row -1: nothing
        each[todo] += 8.0
        full = np.diff(offsets) > 0
        out[full] = np.add.reduceat(each, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def _model(counts: dict[str, np.ndarray], languages: list[str]) -> Model:
    """counts: (order, gram, language number, n) columns. Costs are resolved from order 0 up."""
    cost, escape = [], []
    size = len(languages)
    for n in range(ORDER + 1):
        of = counts["n"] == n
        gram, lang, c = counts["gram"][of], counts["lang"][of], counts["c"][of].astype(np.float64)
        keys, inverse = np.unique(gram, return_inverse=True)
        seen = np.zeros((len(keys), size))
        seen[inverse, lang] = c
        contexts, of_context = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of_context, seen)
        np.add.at(kinds, of_context, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            hit = -np.log2(seen / (total + kinds)[of_context])
        if n:
            shorter = keys & np.uint64((1 << 8 * n) - 1)
            row = cost[n - 1].find(shorter)
            below = cost[n - 1].values[row].astype(np.float64)  # a seen gram's suffix was seen as well
        else:
            below = np.full((len(keys), size), 8.0)
        cost.append(Table(keys, np.where(seen > 0, hit, out[of_context] + below).astype(np.float32)))
        escape.append(Table(contexts, out.astype(np.float32)))
    return Model(languages, cost, escape)


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, most: int = MAX_LANGUAGES) -> Model:
    """Context trees of the labelled documents outside the held-out quarter."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "doc_id", F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    names = sorted(sizes)
    # a threshold on the hash leaves about twice the sample of each language, whatever the table's size
    below = F.lit(False)
    for x, n in sizes.items():
        below = below | ((F.col("lang") == x) & (F.pmod("h", F.lit(1 << 32)) < int((1 << 32) * min(1.0, max(2 * sample, 100) / n))))
    # the ids of the sample first: only they are sorted, and only their texts are read again
    best = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = known.select("lang", "h", "doc_id").where(below).withColumn("k", F.row_number().over(best)).where(F.col("k") <= sample)
    chosen = known.join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")  # sample x languages rows
    number = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                lang = np.array([number[x] for x in some.column("lang").to_pylist()], np.uint64)
                data, offsets = utf8(some.column("text"))
                full = grams(data, offsets, ORDER + 1)
                of = np.repeat(lang, np.diff(offsets))
                for n in range(ORDER + 1):  # a gram has at most 32 bits, its language stands above them
                    key, c = np.unique(of << np.uint64(32) | full & np.uint64((1 << 8 * (n + 1)) - 1), return_counts=True)
                    own = key & np.uint64(0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(32)).astype(np.int64)), pa.array(np.full(len(key), n)), pa.array(own.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "gram", "c"])

    # as many rows as the bounded sample has distinct grams
    got = chosen.select("lang", "text").mapInArrow(count, "lang long, n long, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).toArrow()
    counts = {c: got.column(c).to_numpy() for c in ("lang", "n", "gram", "c")}
    return _model(counts | {"gram": counts["gram"].astype(np.uint64)}, names)


def predict(spark: SparkSession, docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte, n_bytes, letters, label): score is the posterior of the language at equal priors, a text's
    code lengths taken per 32 bytes, so that it says how clear the case is and not how long the text; letters: whether it has any; label: docs' lang.
    carry: a column to hand through."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for some in slices(batch, "text", 1 << 19):
                texts = some.column("text")
                letter = np.array([bool(x and LETTER.search(x)) for x in texts.to_pylist()], bool)
                data, offsets = utf8(texts)
                size = np.maximum(np.diff(offsets), 1)
                if m.languages:
                    bits = m.bits(data, offsets)
                    best = bits.argmin(1)
                    low = bits[np.arange(len(best)), best]
                    score = 1 / np.exp2(-np.minimum((bits - low[:, None]) / size[:, None] * 32, 1000)).sum(1)
                    lang = np.where(letter, np.array(m.languages, object)[best], UNKNOWN)
                else:
                    low, score, lang = np.zeros(len(size)), np.zeros(len(size)), np.array([UNKNOWN] * len(size), object)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(low / size), pa.array(np.diff(offsets)), pa.array(letter), some.column("label"), some.column("carry")],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte", "n_bytes", "letters", "label", "carry"],
                )

    label = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), label.cast("string").alias("label"), carried(docs, carry))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double, n_bytes long, letters boolean, label string, carry long")


def misfits(found: DataFrame):
    """Whether a row of ``predict`` has no letter or fits no learnt language: its code is longer, by more than SLACK
    bits, than FAR times what 99% of the labelled texts that were not fitted on take a byte in the language it got.
    Languages with fewer than LEAST such texts take all languages' ones; fewer still reject nothing, and so does a
    model without languages."""
    told = found.where(held_out(4, 2) & F.col("letters") & (F.col("label") == F.col("lang_pred")))
    sums = told.rollup("lang_pred").agg(F.count("*").alias("n"), F.percentile_approx("bits_per_byte", 0.99, 10000).alias("most")).where(F.col("n") >= LEAST)
    limits = {r["lang_pred"]: r["most"] for r in sums.collect()}  # MAX_LANGUAGES + 1 rows at most; None: all languages
    out = ~F.col("letters")
    if limits:
        limit = F.lit(limits[None])
        for lang, most in limits.items():
            limit = F.when(F.col("lang_pred") == lang, most).otherwise(limit) if lang is not None else limit
        out = out | (F.col("bits_per_byte") * F.col("n_bytes") - SLACK > FAR * limit * F.col("n_bytes"))
    return out
