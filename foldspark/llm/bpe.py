"""Ids of a byte-level BPE vocabulary for batches of texts.

Texts are cut into pre-tokens in numpy, over code points, by the rules of the vocabulary's pattern; each distinct
pre-token is encoded once by the tokenizer library and remembered. Few of the pre-tokens of a corpus are distinct, so
most of the work is array look-ups.
"""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from foldspark.llm.words import U, mix

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Unicode's White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a token of its own.
_SHORT = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_R, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Distinct pre-tokens remembered before the memory starts anew, and code points worked on at once.
REMEMBERED, POINTS = 500_000, 1 << 19


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = _SPACE
    return table


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of consecutive texts start; ``edges``: the first code point of each text that has any."""
    n = len(points)
    kind = _classes()[points]
    begin = np.zeros(n, dtype=bool)
    begin[edges] = True
    change = begin.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    ends = np.ones(n, dtype=bool)  # the last code point of a run
    ends[:-1] = change[1:]
    text_end = np.ones(n, dtype=bool)
    text_end[:-1] = begin[1:]
    # the last white space of a run stands apart when more text follows, and a plain space joins what follows
    last = np.flatnonzero(ends & ~text_end & (kind == _SPACE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # a lone apostrophe that begins a pre-token takes the short ending after it
    for p in np.flatnonzero((points == 0x27) & change & ends & start & ~text_end):
        tail = "".join(map(chr, points[p + 1 : p + 3]))
        size = _SHORT.get(tail[:1]) or _SHORT.get(tail)
        if size and not (size == 2 and begin[p + 2]):
            start[p + 1] = False
            if p + 1 + size < n:
                start[p + 1 + size] = True
    return np.flatnonzero(start)


class BatchEncoder:
    """``path``: the tokenizers file; ``ranks``: the same vocabulary for tiktoken."""

    def __init__(self, path: str, ranks: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.word = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = np.zeros(max(table.values()) + 1, dtype=np.int64)
        self.bytes_of[list(table.values())] = [len(t) for t in table]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=U)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _look_up(self, hashes: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each pre-token."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == distinct[known]
        if not known.all():
            new = np.flatnonzero(~known)
            begins = start[first[new]]
            spaced = points[begins] == 0x20
            spaced[spaced] = _classes()[points[np.minimum(begins[spaced] + 1, len(points) - 1)]] == _LETTER
            new = np.concatenate((new[spaced], new[~spaced]))
            ids, sizes = self._encode_new(points, start[first[new]], end[first[new]], int(spaced.sum()))
            at = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate((self.pool, ids))
            keys = np.concatenate((self.keys, distinct[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.size = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, sizes))[order]
            where = np.searchsorted(self.keys, distinct)
        return self.at[where][inverse], self.size[where][inverse]

    def _encode_new(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of new pre-tokens. The first ``spaced`` are a space and letters: set side by side they stay apart, so one call encodes them."""
        raw = points.astype("<u4").tobytes()
        words = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        joined = np.array(self.word.encode_ordinary("".join(words[:spaced])), dtype=np.uint32)
        upto = np.cumsum(np.fromiter((len(w.encode()) for w in words[:spaced]), np.int64, spaced))
        after = np.searchsorted(np.cumsum(self.bytes_of[joined]), upto) + 1
        rest = [self.word.encode_ordinary(w) for w in words[spaced:]]
        ids = np.concatenate((joined, np.fromiter((x for y in rest for x in y), np.uint32)))
        return ids, np.concatenate((np.diff(after, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest)))).astype(np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not len(points):
            return [np.zeros(0, dtype=np.uint32)] * len(texts)
        start = pretoken_starts(points, (ends - lengths)[lengths > 0])
        end = np.append(start[1:], len(points))
        up = np.full(len(points), _R, dtype=U)
        up[0] = 1
        np.cumprod(up, out=up)
        total = np.zeros(len(points) + 1, dtype=U)
        np.cumsum((points.astype(U) + U(0xABCDEF)) * up, out=total[1:])
        up[1:] = _INVERSE
        np.cumprod(up, out=up)
        at, size = self._look_up(mix((total[end] - total[start]) * up[start] + (end - start).astype(U)), points, start, end)
        before = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=before[1:])
        ids = self.pool[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return np.split(ids, before[np.searchsorted(start, ends[:-1])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizers library gives them without added special tokens."""
        out: list[np.ndarray] = []
        held, points = [], 0
        for t in [*texts, None]:
            if held and (t is None or points + len(t) > POINTS):
                out += self._encode(held)
                held, points = [], 0
            if t is not None:
                if any(s in t for s in self.special):
                    out += self._encode(held) if held else []
                    held, points = [], 0
                    out.append(np.array(_library(self.path).encode(t, add_special_tokens=False).ids, dtype=np.uint32))
                else:
                    held.append(t)
                    points += len(t)
        return out


@functools.lru_cache(1)
def _library(path: str) -> Tokenizer:
    """Only texts with a special token's string need it; it takes far more memory than the ranks."""
    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def encoder(path: str, ranks: str) -> BatchEncoder:
    """One for each Python worker."""
    return BatchEncoder(path, ranks)
