"""Words and word shingles of many texts at once, as 64-bit hashes (NumPy on Arrow buffers)."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from .arrow import mix, texts

#: Bytes of text whose words are hashed at once; some 100 bytes are held for each.
SLICE = 512 << 10

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_DRAW = random.Random(11)
_BYTE = np.array([_DRAW.getrandbits(64) | 1 for _ in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        n = max(n, 2 * len(_POWER))
        inv = pow(_BASE, -1, 1 << 64)
        for name, base in (("_POWER", _BASE), ("_INVERSE", inv)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x)
    return _POWER[:n], _INVERSE[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, runs of bytes other than [\\x20\\x09-\\x0D], and the text of each."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word ends with its text
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    s = np.flatnonzero(start)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | first[1:-1]
    e = np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word with A-Z lower-cased."""
    if not len(s):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOW[data]] * power[: len(data)], out=total[1:])
    return mix(((total[e] - total[s]) * inverse[s]) ^ ((e - s).astype(np.uint64) << np.uint64(48)))


def shingles(h: np.ndarray, doc: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words (of the whole text where it has fewer), and the text of each."""
    k = np.uint64(0xD6E8FEB86659FD93)
    count = np.bincount(doc, minlength=n)
    ends = np.cumsum(count)
    out, of = [], []
    if len(h) >= width:
        x = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            x = mix(x * k + h[i : len(h) - width + 1 + i])
        whole = doc[: len(x)] == doc[width - 1 :]
        out.append(x[whole])
        of.append(doc[: len(x)][whole])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            more = count[short] > i
            x[more] = mix(x[more] * k + h[(ends - count)[short[more]] + i] + np.uint64(i + 1))
        out.append(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        of.append(short)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(out) == 1:
        return out[0], of[0]
    x, d = np.concatenate(out), np.concatenate(of)
    order = np.argsort(d, kind="stable")
    return x[order], d[order]


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word, as hashes() gives it, in steps."""
    power, _ = _powers(SLICE)
    total = 0
    for at in range(0, len(data), SLICE):
        step = _BYTE[_LOW[data[at : at + SLICE]]] * power[: min(SLICE, len(data) - at)]
        total += int(step.sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([(total ^ (len(data) << 48)) & ((1 << 64) - 1)], np.uint64))[0]


def stretches(data: np.ndarray):
    """One text in stretches of at most SLICE bytes that end with a blank, or of one longer word alone."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            blank = np.flatnonzero(_SPACE[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                while end < len(data) and not _SPACE[data[end : end + SLICE]].any():
                    end = min(len(data), end + SLICE)
                if end < len(data):
                    end += int(np.argmax(_SPACE[data[end : end + SLICE]]))
        yield data[at:end]
        at = end


def text_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all words of one text of any length."""
    out = [np.empty(0, np.uint64)]
    for part in stretches(data):
        if len(part) > SLICE:
            out.append(np.array([_long_word(part)]))
        else:
            s, e, _ = spans(part, np.array([0, len(part)]))
            out.append(hashes(part, s, e))
    return np.concatenate(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def sets(part: pa.RecordBatch, width: int):
    """The sorted distinct shingle hashes of each text of a slice (at most SLICE bytes, or one row)."""
    data, off = texts(part.column("text"))
    if len(data) > SLICE:
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            h = text_hashes(data[a:b])
            yield _distinct(shingles(h, np.zeros(len(h), np.int64), 1, width)[0])
        return
    s, e, doc = spans(data, off)
    x, d = shingles(hashes(data, s, e), doc, part.num_rows, width)
    at = np.searchsorted(d, np.arange(part.num_rows + 1)).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield _distinct(x[a:b])
