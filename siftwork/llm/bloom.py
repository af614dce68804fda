"""A blocked Bloom filter: each key sets PROBES bits within one block of 512 bits."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mix

PROBES, BLOCK = 8, 512
#: Keys whose bits are placed at once.
STEP = 16_384
#: The largest filter, in bits (16 MiB). Beyond it the rate of false hits grows, which an exact join removes.
MAX_BITS = 1 << 27


def bits_for(n: int, per_key: int = 16, most: int = MAX_BITS) -> int:
    """A power of two of bits, at least one block and at most `most`."""
    want = max(BLOCK, n * per_key)
    return min(most, 1 << int(want - 1).bit_length())


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of the bits of each 64-bit key hash: one block each, PROBES places within."""
    h = mix(np.asarray(h).view(np.uint64))
    block = (h >> np.uint64(32)) % np.uint64(max(1, bits // BLOCK))
    g = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    within = (g[:, None] >> (np.uint64(7) * np.arange(PROBES, dtype=np.uint64))) % np.uint64(BLOCK)
    return block[:, None] * np.uint64(BLOCK) + within


def empty(bits: int) -> np.ndarray:
    return np.zeros(bits // 8, np.uint8)


def add(words: np.ndarray, h: np.ndarray) -> None:
    for low in range(0, len(h), STEP):
        at = _places(h[low : low + STEP], len(words) * 8).ravel()
        np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    for low in range(0, len(h), STEP):
        at = _places(h[low : low + STEP], len(words) * 8)
        out[low : low + STEP] = ((words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool).all(axis=1)
    return out


def build(keys: DataFrame, column: str, bits: int) -> bytes:
    """The filter over a long column of key hashes, compressed.

    Each task (4 to 128 of them, by size) fills a filter of the fixed size; slots of it are joined by
    key, so neither a task nor the driver gets more than the fixed size for each input task.
    """
    tasks = max(4, bits >> 20)
    slots = min(64, max(1, bits // 8 // 4096))

    def fill(batches):
        words = empty(bits)
        for b in batches:
            add(words, np.asarray(b.column(0).drop_null()).astype(np.int64))
        for s, part in enumerate(np.split(words, slots)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slot": pa.array([s], pa.int32()), "part": [zlib.compress(part.tobytes(), 1)]})

    def join(table: pa.Table) -> pa.Table:
        out = None
        for x in table.column("part").to_pylist():
            got = np.frombuffer(zlib.decompress(x), np.uint8)
            out = got.copy() if out is None else out | got
        return pa.table({"slot": table.column("slot")[:1], "part": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    parts = keys.select(F.col(column).cast("long")).repartition(tasks, column).mapInArrow(fill, "slot int, part binary")
    words = empty(bits)
    each = len(words) // slots
    for r in parts.groupBy("slot").applyInArrow(join, "slot int, part binary").collect():
        words[r.slot * each : (r.slot + 1) * each] = np.frombuffer(zlib.decompress(r.part), np.uint8)
    return zlib.compress(words.tobytes(), 1)


def load(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)
