"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file and composed with each input:

* the normaliser: the rules of the model's character map (the longest rule at a place applies, other characters pass),
  single blanks in place of runs where the model asks for it, the dummy prefix, and blanks to U+2581;
* the pieces: a trie, whose path from the root to a piece's end reads the piece and writes its id;
* byte fallback: a character without a piece writes its bytes' ids (the unknown id where the model has no bytes).

The composition is a lattice whose states are a position and the piece that ends there; the encoding is its shortest
path in the tropical semiring: weights add along a path, the least total wins. Positions are a topological order, so
the arcs are relaxed in that order. In a unigram model an arc weighs minus its piece's score. A BPE model has no
additive scores: its pieces come from merges in the order of scores. But which pieces may stand side by side decides a
BPE encoding: it is the one segmentation in which every two neighbours are what BPE makes of the two alone. So a BPE
arc weighs nothing if its piece may follow the state's piece and infinity if not. No prefix of a text has two such
segmentations, so a position has one finite state, and one that is reached is settled: no arc is lighter than nothing.
Byte arcs weigh ``FALLBACK`` in both.

No piece holds two characters that are neighbours in no piece, so inputs fall apart there and the parts, the
same ones again and again, are composed once each and remembered. Where the model allows it, white space ends a part.

Cases: null encodes as null; an empty text has no ids; each row is encoded for itself, so repeated rows and ids need no
rule; an empty table gives no rows; further columns are ignored; white space, control characters and very long words
need no rule (a text is held whole). Models of another kind (words, characters, user-defined pieces, blanks as
suffixes) raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
FALLBACK = 1e6
MEMO, MEMO_CHARACTERS = 500_000, 64
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def charsmap(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double array of units, then the texts that the rules write.

    A unit holds a label (low byte), whether a rule ends here (bit 8), and how far its children are (from bit 10, by
    256 times that where bit 9 is set); a rule's own unit holds the place of what it writes.
    """
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    out, todo, labels = {}, [(0, b"")], np.arange(256)
    while todo:
        at, key = todo.pop()
        unit = int(units[at])
        base = at ^ (unit >> 10) << (8 if unit >> 9 & 1 else 0)
        if unit >> 8 & 1:
            place = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[place : texts.index(b"\0", place)].decode()
        near = base ^ labels
        near = np.where(near < len(units), near, 0)
        child = (units[near] & 0x800000FF) == labels
        child[0] = False
        todo += [(int(near[c]), key + bytes([c])) for c in np.flatnonzero(child).tolist()]
    return out


class Normaliser:
    """The first transducer: from a text to the characters that pieces are made of."""

    def __init__(self, rules: dict[str, str], squeeze: bool, prefix: str):
        self.squeeze, self.prefix = squeeze, prefix
        self.trie: dict = {}
        for key, value in rules.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        self.start = re.compile("[" + re.escape("".join(self.trie)) + "]") if self.trie else None

    def _mapped(self, text: str) -> str:
        out, done, found = [], 0, self.start.search(text)
        while found:
            at = found.start()
            node, end, value = self.trie, 0, None
            for j in range(at, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    end, value = j + 1, node[""]
            if value is not None:
                out += [text[done:at], value]
                done = end
            found = self.start.search(text, end if value is not None else at + 1)
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.start:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub("  +", " ", text).strip(" ")
            if not text:
                return ""
        return self.prefix + text.replace(" ", BLANK)


class Units(dict):
    """Ids by unit, composed when they are first asked for."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self.owner.compose(unit)
        if len(unit) <= MEMO_CHARACTERS:
            self[unit] = out
        return out


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or USER in kinds or model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("neither a unigram nor a BPE model, or one with user-defined pieces or blanks as suffixes")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        self.squeeze = spec.remove_extra_whitespaces
        self.normalise = Normaliser(charsmap(spec.precompiled_charsmap) if spec.precompiled_charsmap else {}, self.squeeze, self.prefix)
        self.bpe = model.trainer_spec.model_type == BPE
        self.names = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p: i for i, p in enumerate(self.names) if kinds[i] == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.surface = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(BLANK, " ") for p, k in zip(self.names, kinds, strict=True)]
        self.trie: dict = {}
        self.adjoin: set[str] = set()  # characters that are neighbours in some piece
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
            self.adjoin.update(p[i : i + 2] for i in range(len(p) - 1))
        self.dtype = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")
        self.follow: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.units = Units(self)
        # white space ends a unit unless some piece reaches across it
        self.apart = not any("\n" in pair or (pair[1] == BLANK and pair[0] != BLANK) for pair in self.adjoin)

    def merges(self, text: str) -> list[str]:
        """What BPE makes of a short string: the adjacent two with the best merged score, leftmost first, become one."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def weight(self, before: str, piece: str) -> float:
        """Weight of the arc of a piece in a state (before: the piece that ends there, empty at the start)."""
        if not self.bpe:
            return -self.score[piece]
        key = before, piece
        if key not in self.follow:
            if len(self.follow) >= 4 * MEMO:
                self.follow.clear()
            self.follow[key] = self.merges(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if self.follow[key] else np.inf

    def shortest(self, text: str) -> list[str]:
        """Pieces (or characters without one) of the shortest path over a normalised part: arcs relaxed by position."""
        n, bpe, trie, follow = len(text), self.bpe, self.trie, getattr(self, "follow", None)
        cost, back, last = [0.0] + [np.inf] * n, [0] * (n + 1), [""] * (n + 1)
        for i in range(n):
            here, before = cost[i], last[i]
            if here == np.inf:
                continue
            node, single = trie, False
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                single |= j == i
                if bpe:
                    if cost[j + 1] < np.inf:  # settled
                        continue
                    may = follow.get((before, piece))
                    w = here + (self.weight(before, piece) if may is None else 0.0 if may else np.inf)
                else:
                    w = here + self.weight("", piece)
                if w < cost[j + 1]:
                    cost[j + 1], back[j + 1], last[j + 1] = w, i, piece
            if not single and here + FALLBACK < cost[i + 1]:  # no merge reaches across bytes
                cost[i + 1], back[i + 1], last[i + 1] = here + FALLBACK, i, ""
        out, i = [], n
        while i:
            out.append(text[back[i] : i])
            i = back[i]
        return out[::-1]

    def _ids(self, pieces: Iterable[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            if p in self.id:
                ids.append(self.id[p])
            elif self.byte:
                ids += [self.byte[b] for b in p.encode()]
            else:
                ids.append(self.unknown)
        return np.array(ids, self.dtype).tobytes()

    def compose(self, unit: str) -> bytes:
        """Ids of a unit, part by part."""
        out, lo, adjoin, parts = [], 0, self.adjoin, self.parts
        for hi in range(1, len(unit) + 1):
            if hi < len(unit) and unit[hi - 1 : hi + 1] in adjoin:
                continue
            part = unit[lo:hi]
            got = parts.get(part)
            if got is None:
                if len(parts) >= MEMO:
                    parts.clear()
                got = parts[part] = self._ids(self.shortest(part))
            out.append(got)
            lo = hi
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian bytes of ``dtype``."""
        text = self.normalise(text)
        if not text:
            return b""
        return b"".join(map(self.units.__getitem__, UNIT.findall(text))) if self.apart else self.compose(text)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, self.dtype).tolist()
        if self.byte_of and any(i in self.byte_of for i in set(numbers)):
            out: list[str] = []
            run = bytearray()
            for i in numbers:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.surface[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(self.surface.__getitem__, numbers))
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_ids, n_byte_ids, decoded): ids as little-endian uint32 of each whole text, and the text that they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        fallback = np.zeros(1 << 8 * t.dtype.itemsize if t.dtype.itemsize == 2 else len(t.names), bool)
        fallback[list(t.byte_of)] = True
        for batch in batches:
            for some in slices(batch, "text"):
                ids, n, low, back = [], [], [], []
                for x in some.column("text").to_pylist():
                    if x is None:
                        for out in (ids, n, low, back):
                            out.append(None)
                        continue
                    own = t.encode(x)
                    numbers = np.frombuffer(own, t.dtype)
                    ids.append(numbers.astype("<u4").tobytes())
                    n.append(len(numbers))
                    low.append(int(fallback[numbers].sum()))
                    back.append(t.decode(own))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(back, pa.string())], names=["doc_id", "ids", "n_ids", "n_byte_ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids binary, n_ids long, n_byte_ids long, decoded string")
