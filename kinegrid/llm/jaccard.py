"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles. Documents with one and the same set are one class,
and classes are compared. Who must meet whom is decided without loss: two sets that are similar enough
differ in at most D shingles, so when the shingles' hash space is dealt into more than D segments, some
segment holds the same shingles in both. Segment contents are the keys under which classes meet; shared
passages alone seldom give a common key. There are some segments more than D, so two such sets share several
keys, as many as the band says at least. Keys of more than HOT classes are hot (as very common passages give): a
class with fewer hot keys than that many is sure to meet its partners under others and leaves its hot keys. Under
the other keys, of HOT classes at most, two classes meet if they share enough keys. Classes that meet, in whatever
chains, form a search group.

Inside a group every class, by size, is a T-occurrence query on the inverted lists of the smaller ones:
the L longest lists are set aside, the short ones are merged by a heap of cursors, which leaps over classes that
can't come to T - L occurrences any more, and classes with that many remain; these are probed by binary search in
the long lists until their overlap is sure to reach, or to miss, what the threshold demands. Only links that join
what is not joined yet are sought: a class is first compared with one class of each of a few components near its size,
and if that leaves no other component in reach, its lists aren't merged at all. So near copies of one text cost a
comparison or two each and not one with every other.

A group of more than ``block`` classes or SHINGLES shingles is dealt into blocks. First each block is searched with some of the group's
classes, the hubs, beside it; links by then join most of what belongs together. Classes outside the group's largest
component so far, the minor ones, then meet every class of the group, block by block: two classes of the largest
component are joined already, and of any other two one is minor. So a task's memory is bounded by blocks of
shingles, no link is lost, and the cost is linear where a group is one text's copies; it grows with the square of
the minor classes alone. Never are all pairs of a group emitted: a task returns at most one link for each class.

Cases: null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle
is one shingle; repeated rows share a class; rows that share an id are documents of their own, named by it; further columns are ignored; an empty table gives no rows; a
document without an id belongs to its class but leads none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, carried, mix, shingle_hashes, slices, utf8, word_hashes
from .graph import components as connected

BLOCK, SHINGLES = 1000, 4_000_000  # classes, and their shingles, of a search group in one block
HUBS = 32  # classes of a group, about, that all its blocks see
NEAR = 4  # components near a class that it is compared with before lists are merged
EMPTY = 2  # empty segments that a set may have before they are keys too
HOT = 8  # classes of a key beyond which it is hot
PARTS = 4  # of the keys, which meet one part after the other: they outweigh the texts, and a shuffle holds one part's
FEW = 16_000_000  # shingles of all texts up to which all parts meet at once
MU = 0.0085  # weight of a probe in DivideSkip's choice of L


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and their offsets by row. A shingle is 64 bits made of its words'
    digests, so two shingles of two compared documents are mixed up with probability 2^-64."""
    data, offsets = utf8(column)
    words, at = word_hashes(ASCII_LOWER[data], offsets)
    rows = len(at) - 1
    count = np.diff(at)
    all_of = shingle_hashes(words, n)
    row_of = np.repeat(np.arange(rows), count)
    whole = (np.arange(len(words)) + n <= at[row_of + 1])[: len(all_of)]
    values, of = all_of[whole], row_of[: len(all_of)][whole]
    for k in range(1, n):  # the whole sequence as one shingle
        short = np.flatnonzero(count == k)
        one = np.full(len(short), k, np.uint64)
        for i in range(k):
            one = (one + words[at[short] + i]) * np.uint64(0x9E3779B97F4A7C15)
        values, of = np.append(values, mix(one)), np.append(of, short)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[fresh], of[fresh]
    return values, np.searchsorted(of, np.arange(rows + 1))


def _bands(percent: int) -> np.ndarray:
    """Lower bounds of size bands; sets that can link are in one band or in two adjoining ones."""
    ratio, out = max(1.5, 101 / percent), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array(out)


def _segments(bands: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """By band: segments into which its sets are dealt, 0 where only equal sets link; and keys that linked sets share at least."""
    most = np.append(bands[1:] - 1, bands[-1])
    differ = 2 * most * (100 - percent) // (100 + percent)
    common = 1 + differ // 3
    return np.where(differ > 0, differ + common + EMPTY, 0), common


def segment_keys(values: np.ndarray, at: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys of each row: hashes of its segments' contents, for its own band and the next where it may link there."""
    size = np.diff(at)
    bands = _bands(percent)
    segments, _ = _segments(bands, percent)
    own = np.searchsorted(bands, size, "right") - 1
    keys, rows = [], []
    for up in (0, 1):
        band = own + up
        use = size > 0
        if up:
            use &= 100 * size >= percent * bands[np.minimum(band, len(bands) - 1)]
        k = np.where(use, segments[np.maximum(band, 0)], 0)
        use &= k > 0
        first = np.cumsum(k) - k
        of = np.repeat(np.arange(len(size)), size)
        chosen = use[of]
        v, of = values[chosen], of[chosen]
        seg = (mix(v ^ np.uint64(0xA0761D6478BD642F)) % k[of].astype(np.uint64)).astype(np.int64) if len(v) else np.zeros(0, np.int64)
        sums, n = np.zeros(int(k.sum()), np.uint64), np.zeros(int(k.sum()), np.int64)
        np.add.at(sums, first[of] + seg, mix(v + np.uint64(0x2545F4914F6CDD1D)))
        np.add.at(n, first[of] + seg, 1)
        row = np.repeat(np.arange(len(size)), k)
        number = np.arange(len(row)) - first[row]
        empty = np.bincount(row[n == 0], minlength=len(size))
        emit = (n > 0) | (empty[row] > EMPTY)
        key = mix(mix(sums + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + band[row].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        key = key & np.uint64(~0xFF & (1 << 64) - 1) | band[row].astype(np.uint64)  # a key's last byte is its band
        keys.append(key[emit])
        rows.append(row[emit])
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.split(key[order], np.searchsorted(row[order], np.arange(1, len(size))))


def dealt_keys(keys: list[np.ndarray]) -> list[pa.ListArray]:
    """The keys of each row in PARTS columns of lists, by their upper bits (the last byte is the band)."""
    row, key = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
    part = (key >> np.uint64(32)) % np.uint64(PARTS)
    out = []
    for i in range(PARTS):
        mine = part == i
        lengths = np.append(0, np.cumsum(np.bincount(row[mine], minlength=len(keys)))).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(key[mine].view(np.int64))))
    return out


def need(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m that makes a link."""
    return -(-percent * (n + m) // (100 + percent))


def merge_skip(lists: list[list[int]], t: int) -> tuple[list[int], list[int]]:
    """Members of at least t of the ascending lists, and in how many lists each is, by a heap of cursors.

    Where the smallest member is at the head of fewer than t lists, t - 1 cursors in all leap, by binary search, to
    the least member that could still be in t of them.
    """
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapify(heap)
    found, times = [], []
    while len(heap) >= t:
        low = heap[0][0]
        popped = []
        while heap and heap[0][0] == low:
            popped.append(heappop(heap))
        if len(popped) >= t:
            found.append(low)
            times.append(len(popped))
            goal = low + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], goal, at)
            if at < len(lists[i]):
                heappush(heap, (lists[i][at], i, at))
    return found, times


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def divide_skip(ids: list[int], sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the linked classes of a group into trees. sides: only pairs from different sides are sought
    (classes of one side have met in a task of their own)."""
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    size, sets, ids = size[order], [sets[i] for i in order], [ids[i] for i in order]
    sides = None if sides is None else np.asarray(sides)[order]
    lists: tuple[np.ndarray, ...] | None = None

    def build() -> tuple[np.ndarray, ...]:
        """The lists end to end, members of each in the order of size, where they start, and each member's list."""
        values = np.concatenate(sets)
        by = np.argsort(values, kind="stable")
        postings = np.repeat(np.arange(len(sets), dtype=np.int32), size)[by]
        values = values[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = values[1:] != values[:-1]
        del values
        of_value = np.empty(len(by), np.int32)
        of_value[by] = np.cumsum(fresh, dtype=np.int32) - 1
        return postings, np.append(np.flatnonzero(fresh), len(by)), of_value, np.append(0, np.cumsum(size))

    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def join(r: int, c: int) -> None:
        out.append((ids[r], ids[c]))
        label[label == label[r]] = label[c]

    for r in range(1, len(sets)):
        n = int(size[r])
        low = int(np.searchsorted(size, -(-percent * n // 100)))
        apart, tested, failed = np.zeros(0, np.int64), [], []
        while low < r:  # of each component in reach the class nearest in size
            apart = np.flatnonzero(label[low:r] != label[r]) + low
            if sides is not None:
                apart = apart[sides[apart] != sides[r]]
            fresh = apart[~np.isin(label[apart], failed)] if failed else apart
            if not len(fresh) or len(tested) == NEAR:
                break
            c = int(fresh[-1])
            if _overlap(sets[c], sets[r]) >= need(int(size[c]), n, percent):
                join(r, c)
            else:
                tested.append(c)
                failed.append(label[c])
        if not np.isin(apart, tested, invert=True).any():
            continue
        if lists is None:
            lists = build()
        postings, starts, of_value, bounds = lists
        mine = of_value[bounds[r] : bounds[r + 1]]
        lo, hi = starts[mine], starts[mine + 1]
        length = hi - lo
        t = -(-percent * n // 100)  # any partner is at most as large as r
        rank = np.argsort(length, kind="stable")
        longest = int(length[rank[-1]])
        if longest < 2:
            continue
        skip = min(int(t / (MU * np.log2(longest) + 1)), t - 1)
        short, long = rank[: n - skip], rank[n - skip :]
        several = short[length[short] > 1]
        merge = []
        for a, b in zip(lo[several].tolist(), hi[several].tolist(), strict=True):
            members = postings[a:b]
            members = members[np.searchsorted(members, low) : np.searchsorted(members, r)]
            if len(members):
                merge.append(members.tolist())
        found, count = (np.array(x, np.int64) for x in merge_skip(merge, t - skip))
        if not len(found):
            continue
        ok = label[found] != label[r]
        if sides is not None:
            ok &= sides[found] != sides[r]
        found, count = found[ok], count[ok]
        goal = need(size[found], n, percent)
        left = len(long)
        for a, b in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
            if not len(found):
                break
            members = postings[a:b]
            at = np.searchsorted(members, found)
            count = count + (members[np.minimum(at, b - a - 1)] == found)
            left -= 1
            alive = count + left >= goal
            if not alive.all():
                found, count, goal = found[alive], count[alive], goal[alive]
        for c in found[count >= goal].tolist():
            if label[c] != label[r]:
                join(r, c)
    return out


def _parts(block: int):
    """Into how many blocks classes of n shingles go."""
    return F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / block))


def components(spark: SparkSession, docs: DataFrame, shingle: int = 3, percent: int = 90, block: int = BLOCK, carry: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >= percent * union of their sets.
    carry: a column to hand through."""
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(docs, carry))
    texts = texts.withColumn("print", F.xxhash64("text"))  # tells rows of one id apart

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                values, at = shingle_sets(some.column("text"), shingle)
                size = np.diff(at)
                total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[at]).astype(np.uint64)
                prints = [total(mix(values * np.uint64(c))).astype(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                keys = dealt_keys(segment_keys(values, at, percent))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(size), *map(pa.array, prints), *keys, some.column("carry"), some.column("print")], names=["doc_id", "n", "p", "q", *parts, "carry", "print"])

    parts = [f"keys{i}" for i in range(PARTS)]
    sets = scratch.write(texts.mapInArrow(describe, f"doc_id long, n long, p long, q long, {', '.join(f'{c} array<long>' for c in parts)}, carry long, print long"), "sets")
    same = ["n", "p", "q"]
    # a class is known by a number of its own (rep); its first row, by id, gives its text and, in the end, its name
    row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print")))
    classes = sets.where("n > 0").groupBy(same).agg(row.alias("row"))
    classes = scratch.write(classes.select(*same, F.monotonically_increasing_id().alias("rep"), F.col("row.doc_id").alias("first"), F.col("row.print").alias("of")), "classes")
    members = sets.select("doc_id", "carry", *same).join(classes, same, "left").select("doc_id", "carry", "n", "rep", "first")
    members = scratch.write(members, "members")
    helds = []
    at_once = (sets.agg(F.sum("n")).first()[0] or 0) <= FEW
    for i, keys in enumerate([F.concat(*parts)] if at_once else map(F.col, parts)):  # a key is in one part
        first = sets.select("doc_id", "print", *same, keys.alias("keys")).where("size(keys) > 0").join(classes, same).where("doc_id = first and print = of")
        postings = scratch.write(first.select(F.explode("keys").alias("key"), "rep"), "postings")
        lists = postings.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        lists = scratch.write(lists.select("key", "lo", (F.col("n") > HOT).alias("hot")), "lists")
        helds.append(scratch.write(postings.join(lists, "key").select("key", "rep", "lo", F.col("key").bitwiseAND(255).alias("band"), "hot"), f"held-{i}"))
        scratch.drop("postings", "lists")
    scratch.drop("sets")
    held = reduce(DataFrame.unionByName, helds)
    common = _segments(_bands(percent), percent)[1].tolist()
    least = F.element_at(F.array(*map(F.lit, common)), (F.col("band") + 1).cast("int"))
    hot = scratch.write(held.where("hot").groupBy("rep", "band").agg(F.count("*").alias("h")), "hot")
    # of hot keys those of classes that hold enough of them, tied to the key's first class
    tied = held.where("hot").join(hot.where(F.col("h") >= least).select("rep", "band"), ["rep", "band"], "left_semi").where("rep > lo")
    # other keys have HOT classes at most: a pair must have enough of them in common
    member = F.struct("rep", F.coalesce("h", F.lit(0)).alias("h"))
    few = held.where("not hot").join(hot, ["rep", "band"], "left").groupBy("key", "band").agg(F.array_sort(F.collect_list(member)).alias("m"))
    few = few.select("band", "m", F.posexplode("m").alias("i", "y")).select("band", "y", F.explode(F.slice("m", F.lit(1), F.col("i"))).alias("x"))
    shared = few.groupBy(F.col("y.rep").alias("a"), F.col("x.rep").alias("b"), "band").agg(F.count("*").alias("n"), F.first(F.least("x.h", "y.h")).alias("h"))
    shared = shared.where(F.col("n") >= F.greatest(F.lit(1), least - F.col("h")))
    meet = shared.select("a", "b").unionByName(tied.select(F.col("rep").alias("a"), F.col("lo").alias("b")))
    groups = scratch.write(connected(meet, scratch, "meet"), "groups")
    scratch.drop(*(f"held-{i}" for i in range(len(helds))))

    # of each group's blocks, dealt by shingles; a group of one block is a single task
    weight = classes.select(F.col("rep").alias("node"), "n")
    place = classes.select(F.col("rep").alias("node"), "first", "of")
    dealt = groups.join(weight, "node")
    sizes = dealt.groupBy("component").agg(_parts(block).alias("blocks"), F.count("*").alias("classes")).where("blocks > 1")
    sizes = scratch.write(sizes, "sizes")
    node = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    dealt = dealt.join(sizes, "component", "left").select("node", "component", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce("classes", F.lit(1)).alias("classes"))
    dealt = scratch.write(dealt.withColumn("i", mine).withColumn("hub", (F.col("blocks") > 1) & (node < F.lit(float(HUBS << 40)) / F.col("classes"))), "dealt")
    plain = dealt.select("node", "component", F.lit(0).cast("long").alias("k"), "i", F.lit(False).alias("second"))
    hubs = dealt.where("hub").select("node", "component", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"), "i").where("i <> j")
    tasks = scratch.write(plain.unionByName(hubs.select("node", "component", F.lit(0).cast("long").alias("k"), F.col("j").alias("i"), F.lit(False).alias("second"))), "tasks")
    key = ["component", "k", "i"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, second = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                got = divide_skip(ids, sets, percent, np.array(second) if any(second) else None)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got]), pa.array([x[1] for x in got])], names=["a", "b"])

        for batch in batches:
            for some in slices(batch, "text"):
                values, at = shingle_sets(some.column("text"), shingle)
                for i, row in enumerate(zip(*(some.column(c).to_pylist() for c in (*key, "node", "second")), strict=True)):
                    if row[:3] != now:
                        yield from links()
                        now, ids, sets, second = row[:3], [], [], []
                    ids.append(row[3])
                    second.append(row[4])
                    sets.append(values[at[i] : at[i + 1]].copy())
        yield from links()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(tasks: DataFrame, name: str) -> DataFrame:
        held = tasks.join(place, "node").join(texts, (F.col("doc_id") == F.col("first")) & (F.col("print") == F.col("of"))).select(*key, "node", "second", "text")
        held = held.repartition(n, *key).sortWithinPartitions(*key, "node")
        return scratch.write(held.mapInArrow(search, "a long, b long"), name)

    links = searched(tasks, "links")
    if sizes.limit(1).count():
        large = dealt.where("blocks > 1").select("node", "component", "n", "blocks", "i")
        label = connected(links, scratch, "joined").withColumnRenamed("component", "label")
        label = scratch.write(large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
        counts = label.groupBy("component", "label").agg(F.sum("n").alias("n"))
        most = counts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
        minor = label.join(most, "component").where("label <> most").select("node", "component", "n", "blocks")
        parts = minor.groupBy("component").agg(_parts(block).alias("parts"))
        minor = scratch.write(minor.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))), "minor")
        each = minor.select("node", "component", (F.col("part") + 1).alias("k"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("i"), F.lit(True).alias("second"))
        other = large.join(minor.select("component", "parts").distinct(), "component").join(minor.select("node", F.col("part").alias("own")), "node", "left")
        # a class that is minor itself meets its own part as one of it, and the parts before as all others do
        other = other.select("node", "component", F.explode(F.expr("sequence(1L, parts)")).alias("k"), "i", F.lit(False).alias("second"), "own").where("own is null or own + 1 > k").drop("own")
        own = minor.select("node", "component", (F.col("part") + 1).alias("k"), F.lit(-1).cast("long").alias("i"), F.lit(False).alias("second"))
        links = links.unionByName(searched(scratch.write(each.unionByName(other).unionByName(own), "minor-tasks"), "minor-links"))
    found = scratch.write(connected(links, scratch, "found").join(place, "node").select("node", "component", "first"), "components")
    names = found.groupBy("component").agg(F.min("first").alias("component_id"))
    named = found.join(names, "component").select(F.col("node").alias("rep"), "component_id")
    out = members.join(named, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first", "doc_id").alias("component_id"), *(["carry"] if carry else []))
