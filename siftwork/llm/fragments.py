"""Fragments of the global n-gram order: segments that linked sets must share, and partial overlaps.

The global order is that of the n-grams' 64-bit hashes, so fragments of equal width carry equal weight
without sampled pivots. A set is cut at fragment borders into segments.

Which sets can link. With percent p and sizes a and b, a link differs in at most (a + b)(100 - p) / (100 + p)
n-grams. Sizes fall into bands so that links stay within a band or its neighbour; scheme s serves pairs whose
larger set is in band s, and H is the most that such a pair differs in. The scheme cuts the order into
k = H + 1 + z fragments, so at least 1 + z segments of a pair are equal. Hence:
- segments of at most `least` n-grams, which sets share by chance, are left out by sets that have z of them
  or fewer. If one set of a pair leaves its small ones out, the pair still shares a larger segment.
- sets with more small ones than z (few) are cut again at the next level, with more fragments; a pair of two
  such sets meets there. At the last level they show their small segments, too.
- a set that leaves out m small segments shares `need` = 1 + z - m shown ones with any set that it links with.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .arrow import mix

#: z as a share of H + 1, by level.
SLACK = (0.25, 0.5, 1.0, 2.0)
_LARGEST = 1 << 36


@cache
def bands(percent: int) -> np.ndarray:
    """First sizes of bands: a link's larger set is in the band of the smaller or in the next one."""
    out = [1]
    while out[-1] < _LARGEST:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


@cache
def schemes(percent: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments, z, and the size of segments that count as small, for each scheme; no fragments where H is 0."""
    first = bands(percent)
    top = np.append(first[1:] - 1, first[-1])
    most = 2 * top * (100 - percent) // (100 + percent)
    z = np.ceil((most + 1) * SLACK[level]).astype(np.int64)
    k = most + 1 + z
    below = np.append(1, first[:-1])
    return np.where(most > 0, k, 0), z, (below / k / 3).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole numbers of the ranges that begin at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Parts:
    """Shown segments of sets: for each part (a set under a scheme at a level) its set, role, need, and signatures."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self._doc, self._own, self._need, self._size, self._sigs = ([] for _ in range(5))
        n = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        first = np.cumsum(n) - n
        weight = mix(flat)
        for role in (0, 1):  # with sets of its own band and smaller ones; with larger ones
            docs = np.flatnonzero(n)
            scheme = np.searchsorted(bands(percent), n, "right") - 1 + role
            for level in range(len(SLACK)):
                docs = docs[schemes(percent, level)[0][scheme[docs]] > 0]
                if len(docs):
                    at = ranges(first[docs], n[docs])
                    docs = docs[self._cut(docs, scheme[docs], n[docs], flat[at], weight[at], percent, level, role == 0)]
        doc = np.concatenate([*self._doc, np.empty(0, np.int64)])
        size = np.concatenate([*self._size, np.empty(0, np.int64)])
        order = np.argsort(doc, kind="stable")
        self.doc, self.size = doc[order], size[order]
        self.own = np.concatenate([*self._own, np.empty(0, bool)])[order]
        self.need = np.concatenate([*self._need, np.empty(0, np.int64)])[order]
        self.sigs = np.concatenate([*self._sigs, np.empty(0, np.uint64)])[ranges((np.cumsum(size) - size)[order], self.size)].view(np.int64)

    def _cut(self, docs: np.ndarray, scheme: np.ndarray, n: np.ndarray, x: np.ndarray, weight: np.ndarray, percent: int, level: int, own: bool) -> np.ndarray:
        """Adds the parts of sets with n-grams x, and returns which sets have too many small segments."""
        k, z, least = (a[scheme] for a in schemes(percent, level))
        base = np.cumsum(k) - k
        of = np.repeat(np.arange(len(docs)), n)
        fragment = ((x >> np.uint64(32)) * k[of].astype(np.uint64)) >> np.uint64(32)
        total = int(k.sum())
        count = np.bincount(base[of] + fragment.astype(np.int64), minlength=total)
        ends = np.cumsum(count)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(docs)), k)
        tag = ((np.arange(total) - base[owner]) << 12 | scheme[owner] << 2 | level).astype(np.uint64)
        sig = mix(mix(sums[ends] - sums[ends - count] + mix(tag)) ^ count.astype(np.uint64))
        small = count <= least[owner]
        left = np.bincount(owner[small], minlength=len(docs))
        odd = left > z
        show = ~small | odd[owner] if level + 1 == len(SLACK) else ~small
        self._doc.append(docs)
        self._own.append(np.full(len(docs), own))
        self._need.append(np.maximum(1, 1 + z - left))
        self._size.append(np.bincount(owner[show], minlength=len(docs)))
        self._sigs.append(sig[show])
        return odd


def cuts(n: int, segment: int) -> int:
    """Bits of the n-gram hash that number the fragments when a set of n counts its overlaps."""
    return max(0, int(np.ceil(np.log2(max(1, n / segment)))))


def partial(hub: np.ndarray, members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many n-grams of a hub's sorted segment each member's segment has (members one after the other)."""
    if not len(hub) or not len(members):
        return np.zeros(len(sizes), np.int64)
    at = np.searchsorted(hub, members)
    same = np.concatenate([[0], np.cumsum(hub[np.minimum(at, len(hub) - 1)] == members)])
    ends = np.cumsum(sizes)
    return same[ends] - same[ends - sizes]


#: Bits of the largest parity map.
MAP_BITS = 2048


def map_bits(percent: int, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Bits of the parity maps of sets of n for pairs of their own band's scheme, or of the next one."""
    first = bands(percent)
    top = first[np.searchsorted(first, n, "right") + np.where(own, 0, 1)] - 1
    return np.minimum(MAP_BITS, 64 << np.ceil(np.log2(np.maximum(1, 1.5 * top / 64))).astype(np.int64))


def parity(x: np.ndarray, bits: int) -> bytes:
    """A bit for each cell: whether an odd number of n-grams falls there. Maps differ in as many bits as sets at most."""
    cells = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(cells.astype(np.uint8) & 1).tobytes()


def differ(left: np.ndarray, right: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Bits in which maps (rows of 64-bit words) differ, for each pair."""
    out = np.empty((len(left), len(right)), np.int64)
    rows = max(1, step // max(1, right.size))
    for a in range(0, len(left), rows):
        out[a : a + rows] = np.bitwise_count(left[a : a + rows, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
    return out
