"""Hidden Markov language model over words.

A token is a word of the text with A-Z lower-cased, or the end that closes each text. The model's observations
are classes: each of the ``own`` most frequent words and the end are a class of their own, all other words fall
into ``SUFFIXES`` classes by their last two bytes, and inside a class a word has its share of the smoothed
counts (a class keeps 0.1 for words never seen). The probability of a text is then

    sum over state paths of the classes' sequence  x  product of the words' shares in their classes,

and the first factor is computed exactly by the scaled forward recursion. Texts are cut into segments of
``SEGMENT_WORDS`` tokens that are run side by side; the segments of one text are chained by their transfer
matrices, which is the same recursion in another order of multiplication, so no text is too long for it.

Training is Baum-Welch: every round runs over every training document, whole. Each task sums the expected counts
of its partition and the sums are aggregated by Spark. It starts from seeded noise, takes ``ROUNDS`` rounds (the
first ones leave the noise's plateau) and goes on until the likelihood settles. Word counts cover all training documents. The ``local`` most frequent words are known to every task
(a bounded table); rarer words of a text meet their counts in a join.

Texts are read in slices of 2 MiB or one text; the longest text bounds a task's memory.

Cases: null text is empty and consists of the end alone; rows that repeat an id are scored each for itself;
words are told apart by digests of 128 bits; an empty table gives no rows; without training documents every word is
unseen; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, slices, utf8, word_hashes
from .langid import held_out

STATES, OWN, SUFFIXES, LOCAL = 6, 4096, 512, 1_000_000
ROUNDS, SETTLED = 9, 1e-3
CLASS_BYTES = 1 << 21  # of class numbers in one run
SEGMENT_WORDS = 1536
RESCALE = 8  # steps between two rescalings
END = np.uint64(0xE5D000000000E5D1)
ALPHA = 0.1


@dataclass
class Batch:
    """Tokens of some rows: distinct words (both halves of their digests) with suffix classes, and each token's number among them."""

    words: np.ndarray
    more: np.ndarray
    suffix: np.ndarray
    token: np.ndarray
    at: np.ndarray


def tokens(column: pa.Array) -> Batch:
    data, offsets = utf8(column)
    data = ASCII_LOWER[data]
    h, at, starts, ends, more = word_hashes(data, offsets, spans=True, wide=True)
    first, number = distinct(h, more)
    last = data[ends[first] - 1].astype(np.int64)
    before = np.where(ends[first] - starts[first] > 1, data[np.maximum(ends[first] - 2, 0)], 0).astype(np.int64)
    rows = len(at) - 1
    token = np.full(len(h) + rows, len(first))
    token[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(at))] = number
    suffix = np.append((last * 131 + before) % SUFFIXES, 0)
    return Batch(np.append(h[first], END), np.append(more[first], np.uint64(0)), suffix, token, at + np.arange(rows + 1))


def distinct(words: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different word is met, and the number of each word among these."""
    _, first, of = np.unique(words, return_index=True, return_inverse=True)
    if (more[first][of] == more).all():
        return first, of
    order = np.lexsort((more, words))  # two words of one first half
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


@dataclass
class Vocabulary:
    """Counts of the local words (sorted by digest), numbers of those with a class of their own, masses of classes."""

    words: np.ndarray
    more: np.ndarray
    count: np.ndarray
    own: np.ndarray  # class of each local word, -1: by suffix
    mass: np.ndarray  # own classes first, then suffix classes
    total: int
    kinds: int

    def find(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word: class, count, and whether the count is known here."""
        if not len(self.words):
            return len(self.mass) - SUFFIXES + b.suffix, np.zeros(len(b.words), np.int64), np.ones(len(b.words), bool)
        i = np.minimum(np.searchsorted(self.words, b.words), len(self.words) - 1)
        here = (self.words[i] == b.words) & (self.more[i] == b.more)
        own = np.where(here, self.own[i], -1)
        suffix = len(self.mass) - SUFFIXES + b.suffix
        return np.where(own >= 0, own, suffix), np.where(here, self.count[i], 0), here


@dataclass
class Segments:
    """Segments of all rows, longest first; the tokens of one step of all segments lie together, steps one after another."""

    row: np.ndarray
    number: np.ndarray
    size: np.ndarray
    classes: np.ndarray
    steps: np.ndarray  # where each step begins (steps + 1); a step has the segments 0, 1, ... that are long enough
    follows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the row's next segment, -1: none

    @staticmethod
    def of(classes: np.ndarray, at: np.ndarray, most: int = SEGMENT_WORDS) -> Segments:
        n = np.diff(at)
        parts = -(-n // most)
        row = np.repeat(np.arange(len(n)), parts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = at[row] + number * most
        size = np.minimum(most, at[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.where(number + 1 < parts[row], np.append(place[1:], -1)[: len(row)], -1)[order]
        row, number, start, size = row[order], number[order], start[order], size[order]
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        steps = np.append(0, np.cumsum(alive))
        step = np.repeat(np.arange(len(alive)), alive)
        segment = np.arange(len(step)) - steps[step]
        return Segments(row, number, size, classes[start[segment] + step], steps, follows)

    @property
    def last(self) -> np.ndarray:
        """Where each segment's last token lies."""
        return self.steps[self.size - 1] + np.arange(len(self.size))


@dataclass
class Model:
    first: np.ndarray  # states at the start
    step: np.ndarray  # state to state
    emit: np.ndarray  # class by state: probability of the class in the state

    def transfers(self, s: Segments, which: np.ndarray) -> np.ndarray:
        """Transfer matrices of some segments (numbers in ascending order), each up to a factor."""
        k = len(self.first)
        m = np.broadcast_to(np.eye(k, dtype=self.step.dtype), (len(which), k, k)).copy()
        alive = np.diff(s.steps)
        for t in range(int(s.size[which].max(initial=0))):
            n = np.searchsorted(which, alive[t])
            x = m[:n]
            x *= self.emit.take(s.classes[s.steps[t] + which[:n]], 0)[:, None, :]
            if t % RESCALE == RESCALE - 1:
                x /= x.reshape(n, k * k).sum(1)[:, None, None]
            x[:] = (x.reshape(-1, k) @ self.step).reshape(n, k, k)
        return m

    def chain(self, s: Segments) -> tuple[np.ndarray, np.ndarray]:
        """State distributions before each segment's first token, and weights of the states that follow its last, up to a factor."""
        k = len(self.first)
        before, after = np.tile(self.first, (len(s.row), 1)), np.ones((len(s.row), k), self.step.dtype)
        parts = s.follows >= 0
        parts[s.follows[parts]] = True
        which = np.flatnonzero(parts)
        if len(which):
            m = self.transfers(s, which)
            order = which[np.argsort(s.number[which], kind="stable")]
            rounds = np.split(order, np.searchsorted(s.number[order], np.arange(1, int(s.number[order[-1]]) + 1)))
            for some in rounds[:-1]:
                some = some[s.follows[some] >= 0]
                x = np.einsum("ni,nij->nj", before[some], m[np.searchsorted(which, some)])
                before[s.follows[some]] = x / x.sum(1)[:, None]
            for some in reversed(rounds[:-1]):
                some = some[s.follows[some] >= 0]
                then = s.follows[some]
                x = np.einsum("nij,nj->ni", m[np.searchsorted(which, then)], after[then])
                after[some] = x / x.max(1)[:, None]
        return before, after

    def forward(self, s: Segments, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Of each token the forward weights of the states and its class's emissions; natural log likelihoods of the
        segments; and, of the steps that are rescaled, the scales. Weights shrink by no more than RESCALE emissions
        before they are brought back to a sum of 1, which a double holds easily."""
        k = len(self.first)
        p, emitted, log, scales = before.copy(), self.emit.take(s.classes, 0), np.zeros(len(s.row)), {}
        states, one = np.empty_like(emitted), np.ones(k, emitted.dtype)
        at, step = s.steps.tolist(), self.step
        for t in range(len(at) - 1):
            lo, hi = at[t], at[t + 1]
            x = states[lo:hi]
            np.multiply(p[: hi - lo], emitted[lo:hi], out=x)
            if t % RESCALE == RESCALE - 1:
                c = scales[t] = x @ one
                x /= c[:, None]
                log[: hi - lo] += np.log(c)
            np.matmul(x, step, out=p[: hi - lo])
        if len(log):
            log += np.log(states[s.last] @ one)
        return states, emitted, log, scales

    def likelihoods(self, s: Segments, rows: int) -> np.ndarray:
        """Natural log likelihood of each row."""
        return np.bincount(s.row, self.forward(s, self.chain(s)[0])[2], rows)

    def expect(self, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, steps and classes by state, and the log likelihood."""
        k, n = len(self.first), len(s.row)
        first, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape)
        if not n:
            return first, step, emit, 0.0
        before, after = self.chain(s)
        states, onward, log, scales = self.forward(s, before)
        at, back, ends = s.steps.tolist(), np.ascontiguousarray(self.step.T), states[s.last]
        q = after @ back
        q /= (ends * q).sum(1)[:, None]  # scaled as the forward pass is: weights times q are posteriors
        for t in range(len(at) - 2, -1, -1):
            lo, hi = at[t], at[t + 1]
            b = q[: hi - lo]
            states[lo:hi] *= b  # posteriors from here on
            w = onward[lo:hi]
            w *= b  # the weight that a token hands to the one before it
            if t in scales:
                w /= scales[t][:, None]
            np.matmul(w, back, out=b)
            if t:
                step += states[at[t - 1] : at[t - 1] + hi - lo].T @ w
        linked = np.flatnonzero(s.follows >= 0)  # the first token of a segment lies at the segment's own number
        step += (ends[linked] / ends[linked].sum(1)[:, None]).T @ onward[s.follows[linked]]
        step *= self.step
        for i, own in enumerate(np.ascontiguousarray(states.T)):
            emit[:, i] = np.bincount(s.classes, own, len(emit))
        first = states[:n][s.number == 0].sum(0)
        return first, step, emit, float(log.sum())

    @staticmethod
    def of(first: np.ndarray, step: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """From expected counts; a class keeps a little of its overall share in every state."""
        first, step, emit = first + ALPHA, step + ALPHA, emit + share[:, None]
        return Model(first / first.sum(), step / step.sum(1)[:, None], emit / emit.sum(0))

    @staticmethod
    def start(share: np.ndarray, states: int) -> Model:
        noise = np.random.default_rng(7).gamma(2.0, 0.5, (len(share), states)) + 0.05
        emit = share[:, None] * noise
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def count_words(train: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, more, suffix, c) over all training documents, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            w, m, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            first, of = distinct(w, m)
            return w[first], m[first], s[first], np.bincount(of, c).astype(np.int64)

        def out(w: np.ndarray, m: np.ndarray, s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(m.view(np.int64)), pa.array(s), pa.array(c)], names=["word", "more", "suffix", "c"])

        for batch in batches:
            for some in slices(batch, "text"):
                b = tokens(some.column("text"))
                held.append((b.words, b.more, b.suffix, np.bincount(b.token, minlength=len(b.words))))
                size += len(b.words)
                if size > 1_500_000:  # a task's own memory, not a limit on words
                    held, size = [merged()], 0
                    if len(held[0][0]) > 1_000_000:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    rows = train.select("text").mapInArrow(run, "word long, more long, suffix long, c long")
    return scratch.write(rows.groupBy("word", "more").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c")), "counts")


def vocabulary(counts: DataFrame, own: int, local: int) -> Vocabulary:
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    # words above the least count of which there are at most ``local``, found from a histogram of some 16,000 rows at most
    step = F.floor(F.log2("c") * 256)
    steps, room, least = counts.groupBy(step.alias("s")).count().collect(), local, 1 << 30
    for r in sorted(steps, key=lambda r: -r["s"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["s"]
    end_word = int(np.array([END]).view(np.int64)[0])
    best = counts.where((step >= least) | ((F.col("word") == end_word) & (F.col("more") == 0))).toArrow()
    word, more = (best.column(x).to_numpy().view(np.uint64) for x in ("word", "more"))
    c = best.column("c").to_numpy().astype(np.int64)
    order = np.lexsort((more, word, -c))
    word, more, c, suffix = word[order], more[order], c[order], best.column("suffix").to_numpy()[order]
    end = np.flatnonzero((word == END) & (more == 0))
    top = np.zeros(len(word), bool)
    top[:own] = True
    top[end] = True  # frequent enough wherever there are documents
    number = np.full(len(word), -1)
    number[top] = np.arange(top.sum())
    mass = np.zeros(int(top.sum()) + SUFFIXES)
    mass[number[top]] = c[top] + ALPHA
    by = counts.groupBy("suffix").agg((F.sum("c") + ALPHA * F.count("*")).alias("m")).collect()  # SUFFIXES rows
    rest = np.full(SUFFIXES, ALPHA)
    for r in by:
        rest[r["suffix"]] += r["m"]
    np.subtract.at(rest, suffix[top], c[top] + ALPHA)
    mass[len(mass) - SUFFIXES :] = np.maximum(rest, ALPHA)
    back = np.argsort(word)
    return Vocabulary(word[back], more[back], c[back], number[back], mass, int(sums[0] or 0), int(sums[1] or 0))


def train(spark: SparkSession, rows: DataFrame, vocab: Vocabulary, scratch: Scratch, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows: ``rounds`` rounds, then more until one raises the log likelihood by less than SETTLED of it."""
    share = vocab.mass / vocab.mass.sum()
    model = Model.start(share, states)
    if not vocab.total:
        return model
    known = spark.sparkContext.broadcast(vocab)
    kind = np.dtype(np.uint16 if len(share) <= 1 << 16 else np.uint32)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for batch in batches:
            for part in slices(batch, "text"):
                x = tokens(part.column("text"))
                data = v.find(x)[0][x.token].astype(kind)
                buffers = [None, pa.py_buffer((x.at * kind.itemsize).astype(np.int64)), pa.py_buffer(data)]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(x.at) - 1, buffers).cast(pa.binary())], names=["classes"])

    coded = scratch.write(rows.select("text").mapInArrow(classes, "classes binary"), "classes")  # texts are split into words once
    shape, log, turn = model.emit.shape, -np.inf, 0
    while True:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros(states + states * states + own.emit.size + 1)
            for batch in batches:
                for part in slices(batch, "classes", CLASS_BYTES):
                    data, at = utf8(part.column("classes"))
                    got = own.expect(Segments.of(data.view(kind).astype(np.int64), at // kind.itemsize))
                    total += np.concatenate([np.ravel(y) for y in got])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

        got = coded.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row for each parameter
        total = np.zeros(states + states * states + shape[0] * shape[1] + 1)
        total[got.column("i").to_numpy()] = got.column("n").to_numpy()
        model = Model.of(total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 : -1].reshape(shape), share)
        shared.unpersist()
        turn, before, log = turn + 1, log, float(total[-1])
        if turn >= rounds and log - before < SETTLED * abs(log):
            break
    scratch.drop("classes")
    return model


def score(spark: SparkSession, docs: DataFrame, states: int = STATES, own: int = OWN, local: int = LOCAL, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10; trained on what is not held out."""
    scratch = Scratch(spark, "hmm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where(~held_out(10, 0))
    counts = count_words(known, scratch)
    vocab = vocabulary(counts, own, local)
    model = train(spark, known, vocab, scratch, states, rounds)
    shared = spark.sparkContext.broadcast((model, vocab))
    log_classes = np.log10(vocab.mass)
    owned = len(vocab.mass) - SUFFIXES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what is known here, and one for each rarer word of it."""
        m, v = shared.value
        for batch in batches:
            for some in slices(batch, "text"):
                b = tokens(some.column("text"))
                n = np.diff(b.at)
                k = len(n)
                cls, c, here = v.find(b)
                part = np.where(here, np.log10(c + ALPHA), 0.0)[b.token]
                shares = np.where(cls < owned, -np.log10(c + ALPHA), -log_classes[cls])[b.token]
                row = np.repeat(np.arange(k), n)
                base = np.bincount(row, part, k)
                hmm = m.likelihoods(Segments.of(cls[b.token], b.at), k) / np.log(10) + base + np.bincount(row, shares, k)
                seen = np.bincount(row, (here & (c > 0))[b.token], k).astype(np.int64)
                ids, keys = some.column("doc_id"), some.column("row")
                yield pa.RecordBatch.from_arrays([keys, ids, pa.array(n), pa.array(seen), pa.array(base), pa.array(hmm), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=NAMES)
                rare = ~here[b.token]
                pair, times = np.unique(row[rare] * len(b.words) + b.token[rare], return_counts=True)
                of, word = np.divmod(pair, max(1, len(b.words)))
                j = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(of)), pa.nulls(j, pa.int64()), pa.nulls(j, pa.int64()), pa.nulls(j, pa.int64()), pa.nulls(j, pa.float64()), pa.nulls(j, pa.float64()), pa.array(b.words[word].view(np.int64)), pa.array(b.more[word].view(np.int64)), pa.array(times.astype(np.int64))], names=NAMES
                )

    NAMES = ["row", "doc_id", "n_tokens", "n_known", "base", "hmm", "word", "more", "times"]
    kinds = "row long, doc_id long, n_tokens long, n_known long, base double, hmm double, word long, more long, times long"
    found = scratch.write(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, kinds), "found")
    rare = found.where("word is not null").select("row", "word", "more", "times").join(counts.select("word", "more", "c"), ["word", "more"], "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + ALPHA)).alias("rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    out = found.where("word is null").drop("word", "more", "times").join(rare, "row", "left")
    more = F.coalesce("rare", F.lit(0.0))
    base = F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + ALPHA * (vocab.kinds + 1))))
    return out.select(
        "doc_id", held_out(10, 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + more).alias("score"),
    )
