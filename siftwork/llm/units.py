"""Matches of the splitting pattern of byte-level tokenizers, and a bounded cache of their ids.

Texts of plain characters (ASCII, Latin letters, some punctuation) are split in NumPy on their bytes, for the
one pattern whose rules are spelled out here; all others by the pattern itself. A match of a plain text of at
most SHORT bytes is known by a 64-bit hash, any other by its string.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .arrow import mix, texts
from .fragments import ranges

LIMIT = 1_000_000
#: Bytes of text that are split at once; the longest match that is known by its hash.
STEP, SHORT = 512 << 10, 64
#: The pattern that plain() implements.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTER, _DIGIT, _BLANK, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[9:14] = _BLANK
_KIND[32:127] = _OTHER
_KIND[32] = _BLANK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:192] = _OTHER  # settled by the byte before
_KIND[195:198] = _LETTER  # U+00C0 to U+017F, but for two signs
_KIND[194] = _KIND[226] = _OTHER
#: Second bytes after 0xC2 of signs that are neither letters, digits nor blanks.
_SIGNS = np.zeros(256, bool)
_SIGNS[[0xA1, 0xA7, 0xAB, 0xBB, 0xBF]] = True
_DRAW = random.Random(23)
_WEIGHT = np.array([_DRAW.getrandbits(64) | 1 for _ in range(256)], np.uint64)
_BASE = 0xD1342543DE82EF95
_POWER, _INVERSE = np.full(STEP + 1, _BASE, np.uint64), np.full(STEP + 1, pow(_BASE, -1, 1 << 64), np.uint64)
for _x in (_POWER, _INVERSE):
    _x[0] = 1
    np.cumprod(_x, out=_x)


def plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the matches of all texts, and which texts are not plain (their starts mean nothing)."""
    kind = _KIND[data]
    lead = np.flatnonzero((kind != _ODD) & (data >= 0xC2))
    bad = [np.flatnonzero(kind == _ODD)]
    if len(lead):
        then = data[lead + 1]  # valid UTF-8 has one
        kind[lead + 1] = kind[lead]
        three = lead[data[lead] == 0xE2]
        if len(three):
            kind[three + 2] = _OTHER
            a, b = data[three + 1], data[three + 2]  # U+2010 to U+2027, and the euro sign
            bad.append(three[~((a == 0x80) & (b >= 0x90) & (b <= 0xA7) | (a == 0x82) & (b == 0xAC))])
        bad.append(lead[(data[lead] == 0xC3) & ((then == 0x97) | (then == 0xB7)) | (data[lead] == 0xC2) & ~_SIGNS[then]])
    slow = np.zeros(len(off) - 1, bool)
    slow[np.searchsorted(off, np.concatenate(bad), "right") - 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge = edge[:-1]
    run = edge.copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    after = np.zeros(len(data), bool)  # a space just before, in the same text
    after[1:] = (data[:-1] == 32) & ~edge[1:]
    start = run & (blank | ~after)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:]
    # 's 't 'm 'd 're 've 'll where a match starts at the apostrophe
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[quote + 1 < len(data)]
    quote = quote[run[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        inside = (quote + 2 < len(data)) & ~edge[np.minimum(quote + 2, len(data) - 1)]
        n = np.where(np.isin(one, (115, 116, 109, 100)), 1, np.where(inside & ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)), 2, 0))
        quote, n = quote[n > 0], n[n > 0]
        start[quote + 1] = False
        rest = quote + 1 + n
        rest = rest[rest < len(data)]
        start[rest] = True
    return np.flatnonzero(start), slow


class Table:
    """Whole numbers by 64-bit hash, in open addressing."""

    def __init__(self):
        self.bits, self.used = 17, 0
        self.keys, self.values = np.zeros(1 << 17, np.uint64), np.full(1 << 17, -1, np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        at, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            value = self.values[at]
            same = (self.keys[at] == h[left]) & (value >= 0)
            out[left[same]] = value[same]
            go = ~same & (value >= 0)
            at, left = (at[go] + 1) & (len(self.keys) - 1), left[go]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that are not there."""
        if 2 * (self.used + len(h)) > len(self.keys):
            held = self.values >= 0
            h, values = np.concatenate([self.keys[held], h]), np.concatenate([self.values[held], values])
            while 2 * len(h) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.used = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64), 0
        self.used += len(h)
        at, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.values[at] < 0
            self.values[at[free]] = values[left[free]]  # of several for one place the last stays
            self.keys[at[free]] = h[left[free]]
            go = self.keys[at] != h[left]
            at, left = (at[go] + 1) & (len(self.keys) - 1), left[go]


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and the size of each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class Units:
    """Ids of matches, from `encode` (a list of strings to all ids, and how many each has), for a bounded number of strings."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT):
        self.pattern, self.encode, self.limit = regex.compile(pattern), encode, limit
        self.quick = pattern == PLAIN
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = Table()
        self.count = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Numbers of new strings."""
        ids, sizes = self.encode(keys)
        n, first = len(ids), self.count
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(keys) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + n] = ids
        self.size[first : first + len(keys)] = sizes
        self.start[first : first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += n
        self.count += len(keys)
        return np.arange(first, self.count)

    def _of_strings(self, keys: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(x for x in keys if x not in self.index))
        if new:
            self.index.update(zip(new, self._learn(new).tolist(), strict=True))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def _of_bytes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Numbers of the matches data[s:e]; data has at most STEP bytes."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_WEIGHT[data] * _POWER[: len(data)], out=total[1:])
        h = mix((total[e] - total[s]) * _INVERSE[s] ^ ((e - s).astype(np.uint64) << np.uint64(57)))
        out = self.table.get(h)
        short = e - s <= SHORT
        new = np.flatnonzero((out < 0) & short)
        if len(new):
            kinds, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            view = data.tobytes()
            numbers = self._learn([view[a:b].decode() for a, b in zip(s[new[first]].tolist(), e[new[first]].tolist(), strict=True)])
            self.table.put(kinds, numbers)
            out[new] = numbers[back]
        if not short.all():
            long = np.flatnonzero(~short)
            out[long] = self._of_strings([data[a:b].tobytes().decode() for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)])
        return out

    def _numbers(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all matches of texts of STEP bytes at most together, and how many each text has."""
        if self.quick and len(data):
            s, slow = plain(data, off)
            text = np.searchsorted(off, s, "right") - 1
            e = np.append(s[1:], len(data))
            fast = ~slow[text]
            s, e, text = s[fast], e[fast], text[fast]
            numbers = self._of_bytes(data, s, e)
        else:
            slow, text, numbers = np.diff(off) > 0, np.empty(0, np.int64), np.empty(0, np.int64)
        for i in np.flatnonzero(slow).tolist():
            own = self._of_strings(self.pattern.findall(data[off[i] : off[i + 1]].tobytes().decode()))
            numbers, text = np.concatenate([numbers, own]), np.concatenate([text, np.full(len(own), i)])
        if slow.any():
            numbers = numbers[np.argsort(text, kind="stable")]
        return numbers, np.bincount(text, minlength=len(off) - 1)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Numbers of the matches of one text of any length, cut where a match starts: at a space between two words."""
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > STEP:
                word = _KIND[data[at : at + STEP]] == _LETTER
                cut = np.flatnonzero(word[:-2] & (data[at + 1 : at + STEP - 1] == 32) & word[2:])
                if not self.quick or not len(cut):  # no such place
                    out.append(self._of_strings(self.pattern.findall(data[at:].tobytes().decode())))
                    break
                end = at + 1 + int(cut[-1])
            out.append(self._numbers(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text in them; null texts have none."""
        if self.count > self.limit:
            self._clear()
        data, off = texts(column)
        found, counts, at = [np.empty(0, np.int64)], [], 0
        while at < len(off) - 1:
            end = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
            part = data[off[at] : off[end]]
            if len(part) > STEP:
                found.append(self._long(part))
                counts.append([len(found[-1])])
            else:
                numbers, n = self._numbers(part, off[at : end + 1] - off[at])
                found.append(numbers)
                counts.append(n)
            at = end
        k = np.concatenate(found)
        size = self.size[k]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.pool[ranges(self.start[k], size)], ends[np.concatenate([[0], *counts]).astype(np.int64).cumsum()]
