"""Token ids of whole texts by public tokenizer files, as little-endian uint16 or uint32 bytes.

``ByteLevel`` runs a byte-level BPE file; ``WordLevel`` runs a file that drops white space, with a
memo of white-space units, told apart byte by byte. Both give what the tokenizers library gives for the whole text
(add_special_tokens=False); texts for which that could be in doubt are passed to it whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np

from .common import ASCII_LOWER, numbered, utf8, word_spans

#: white space to Python only, or the start of a special token's string
ODD = re.compile("[\x1c-\x1f\x85᠎]|<\\|")
#: white space that the fast encoder's pattern would need too deep a stack for
LONG_RUN = 100_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}")
MEMO = 300_000  # units of a generation; two are held


#: ASCII symbols but the apostrophe, which may begin a contraction
SYMBOL = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])


def _dtype(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (printable ones are themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = _dtype(self.whole.get_vocab_size())
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}
        added = {x["id"] for x in json.loads(self.whole.to_str())["added_tokens"]}
        # ids of a byte-level file are its merge order; the split pattern is the kind's fixed one
        self.fast = tiktoken.Encoding(
            "byte-level",
            pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
            mergeable_ranks={k: v for k, v in ranks.items() if v not in added},
            special_tokens={},
        )

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        out = []
        for x in texts:
            x = x or ""
            doubtful = ODD.search(x) or len(x) > LONG_RUN and RUN.search(x)
            ids = self.whole.encode(x, add_special_tokens=False).ids if doubtful else self.fast.encode_ordinary(x)
            out.append(np.array(ids, self.dtype).tobytes())
        return out


class WordLevel:
    """White-space units of the lower-cased text are encoded once each, by whole arrays of units.

    The file lower-cases, and splits at white space and between letters and symbols, before any merge; so
    units, and symbols after a letter at a unit's end, can be encoded one by one. Rows that may hold a special
    token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = _dtype(self.whole.get_vocab_size())
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for piece, i in self.whole.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def _learn(self, units: list[bytes]) -> None:
        """Encode many units as one text each 1000 units.

        A unit of letters is one split piece, whose last token ends a word; of other units a token belongs to the
        one in which it starts.
        """
        step = self.dtype.itemsize
        texts = [(u, u.decode()) for u in units]
        for plain in (True, False):
            chosen = [x for x in texts if x[1].isalpha() == plain]
            for lo in range(0, len(chosen), 1000):
                some = chosen[lo : lo + 1000]
                found = self.whole.encode_batch([" ".join([t for _, t in some])], add_special_tokens=False)[0]
                ids = np.array(found.ids, self.dtype)
                cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
                if not plain or len(cut) != len(some) + 1:
                    starts = np.array([a for a, _ in found.offsets], np.int64)
                    lengths = np.array([len(t) + 1 for _, t in some], np.int64)
                    cut = np.append(np.searchsorted(starts, np.cumsum(lengths) - lengths), len(ids))
                data, cut = ids.tobytes(), (cut * step).tolist()
                self.memo.update(zip([u for u, _ in some], [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))

    def column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column, end to end, and their offsets by row."""
        data, offsets = utf8(column)
        marked = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|": the row may hold a special token's string
        if not len(marked):
            return self._rows(ASCII_LOWER[data], offsets)
        data, whole = data.copy(), {}
        for r in np.unique(np.searchsorted(offsets, marked, "right") - 1).tolist():
            a, b = offsets[r], offsets[r + 1]
            whole[r] = np.array(self.whole.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, self.dtype)
            data[a:b] = 32
        ids, at = self._rows(ASCII_LOWER[data], offsets)
        parts = [whole.get(r, ids[at[r] : at[r + 1]]) for r in range(len(at) - 1)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(s, e) for s, e, _, _ in word_spans(data, offsets)] or [(np.zeros(0, np.int64),) * 2]
        starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.searchsorted(starts, offsets)
        run, here = np.zeros(len(ends), np.int64), np.ones(len(ends), bool)
        for k in range(1, 5):  # symbols at the unit's end, four at most
            here &= (ends - starts > k) & SYMBOL[data[np.maximum(ends - k, 0)]]
            run += here
        before, second = data[np.maximum(ends - run - 1, 0)], data[np.maximum(ends - run - 2, 0)]
        # a letter of ASCII or of Latin-1 (in UTF-8: 0xC3 and a byte; 0x97 and 0xB7 are the signs of arithmetic)
        letter = (before >= 97) & (before <= 122) | (second == 0xC3) & (ends - starts > run + 1) & (before >= 128) & (before != 0x97) & (before != 0xB7)
        stop = (run > 0) & letter
        if stop.any():  # a unit with symbols at its end is two
            place = np.arange(len(starts)) + np.cumsum(stop) - stop
            n = len(starts) + int(stop.sum())
            s, e = np.empty(n, np.int64), np.empty(n, np.int64)
            run = np.where(stop, run, 0)
            s[place], e[place] = starts, ends - run
            s[place[stop] + 1], e[place[stop] + 1] = (ends - run)[stop], ends[stop]
            at = np.append(place, n)[at]
            starts, ends = s, e
        inverse, units = numbered(data, starts, ends)
        if len(self.memo) > MEMO:  # units in use move on to the new generation
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        missing = [u for u in units if u not in memo]
        memo.update((u, older[u]) for u in missing if u in older)
        self._learn([u for u in missing if u not in older])
        pieces = [memo[u] for u in units]
        size = np.array([len(x) for x in pieces], np.int64) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(pieces), self.dtype)
        pool_at = np.cumsum(size) - size
        n = size[inverse]
        total = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(pool_at[inverse] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[at]


_LOADED: dict[tuple[type, str], ByteLevel | WordLevel] = {}


def encoder(kind: type, path: str):
    """One encoder per worker process and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
