"""Shingle sets of texts as sorted 64-bit hashes, and their PartEnum signatures; numpy inside tasks."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import combinations

import numpy as np

U = np.uint64
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
CHUNK = 1 << 20  # bytes of a text that are hashed at once
TAIL = 1e-3  # share of the smallest sets of a band that may keep empty subsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15 | 1
BYTES = mix(np.arange(1, 257, dtype=U))
_powers = np.ones(1, dtype=U)
_inverse = np.ones(1, dtype=U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[U(1)], np.full(size, BASE, dtype=U)]).cumprod(dtype=U)
            _inverse = np.concatenate([[U(1)], np.full(size, pow(BASE, -1, 1 << 64), dtype=U)]).cumprod(dtype=U)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of the text, in order; words are parted by ASCII white space, A-Z lower-cased."""
    text = text.translate(LOWER)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and not SPACE[text[end]]:  # a word isn't cut
            end += 1
        b = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[b], [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        _grow(len(b) + 1)
        sums = np.concatenate([[U(0)], np.cumsum(BYTES[b] * _powers[: len(b)], dtype=U)])
        out.append(mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; of fewer words, the whole sequence is one."""
    h = word_hashes(text.encode("utf-8", "replace") if isinstance(text, str) else (text or b""))
    if not len(h):
        return h
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, dtype=U)
    for j in range(n):
        s = mix(s * U(0xD6E8FEB86659FD93) + h[j : len(h) - n + 1 + j])
    return np.unique(s)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _beyond(mean: float, n: int) -> float:
    """How likely a Poisson count of that mean is over n. What is twelve deviations below the mean, and so below 1e-30, counts as nothing."""
    low = max(0, int(mean - 12 * math.sqrt(mean) - 30))
    if mean <= 0 or low > n:
        return float(mean > 0)
    term = math.exp(-mean + low * math.log(mean) - math.lgamma(low + 1))
    total = term
    for i in range(low + 1, n + 1):
        term *= mean / i
        total += term
    return 1 - total


class PartEnum:
    """Signatures by which any two sets with num / den or more Jaccard similarity share one.

    Sizes fall in bands of which only neighbours can hold similar sets. In a band two similar sets differ in at most k
    elements. The hash domain is cut into n1 parts of n2 cells each. k differences leave at least 1 + extra of the
    n1 parts with at most k2 cells that differ, so the two agree on some n2 - k2 cells of that part: all such subsets
    are signatures. Subsets that hold no element would be shared by many sets. A set in which at most `extra` parts have
    such a subset leaves those out, for it has an agreeing part without; only another set keeps them. n1, n2, k2
    and extra are those with the fewest signatures for the band.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bands = [0]  # largest size of band i
        self.plans: dict[int, tuple[int, int, np.ndarray]] = {}  # some hundreds

    def band(self, size: int) -> int:
        while self.bands[-1] < size:
            self.bands.append((self.bands[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.bands, size))

    def differences(self, band: int) -> int:
        """The most elements in which two similar sets of the band and the one before differ."""
        while len(self.bands) <= band:
            self.bands.append((self.bands[-1] + 1) * self.den // self.num)
        return 2 * (self.den - self.num) * self.bands[band] // (self.den + self.num)

    def plan(self, band: int) -> tuple[int, int, np.ndarray]:
        """extra, the number of cells, and the cells of each subset, part by part. Worked out once."""
        if band not in self.plans:
            self.plans[band] = self._planned(band)
        return self.plans[band]

    def _planned(self, band: int) -> tuple[int, int, np.ndarray]:
        self.differences(band)
        low, high = (self.bands[band - 2] if band > 1 else 0) + 1, self.bands[band]
        k = self.differences(band)
        if k == 0:
            return 0, 1, np.zeros((1, 1), dtype=np.int64)
        best = None
        for n2 in range(1, 9):
            for k2 in range(n2):
                subsets = math.comb(n2, k2)
                for extra in range(k + 20):
                    n1 = k // (k2 + 1) + 1 + extra
                    mean = n1 * min(1.0, subsets * (1 - (n2 - k2) / (n1 * n2)) ** low)
                    tail = _beyond(mean, extra)
                    # The fewest signatures with which few sets have to keep empty subsets; else the fewest such sets.
                    rank = (max(tail, TAIL), n1 * subsets) if n1 * subsets <= max(100, 3 * k) else (2, n1 * subsets)
                    if best is None or rank < best[0]:
                        best = (rank, n1, n2, k2, extra)
                    if tail < TAIL or n1 * subsets > max(100, 3 * k):
                        break
        _, n1, n2, k2, extra = best
        cells = np.array(list(combinations(range(n2), n2 - k2)), dtype=np.int64)
        return extra, n1 * n2, (np.arange(n1)[:, None, None] * n2 + cells[None]).reshape(n1, len(cells), -1)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of a sorted set of hashes, for its own band and for the next, as 64-bit numbers."""
        if not len(s):
            return s
        own = self.band(len(s))
        sums = np.concatenate([[U(0)], np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)])
        out = []
        for band in (own, own + 1):
            extra, cells, subsets = self.plan(band)
            if cells == 1:
                if band == own:
                    out.append(mix(sums[-1:] + U(band)))
                continue
            cuts = (np.arange(1, cells, dtype=np.float64) * (2.0**64 / cells)).astype(U)
            edges = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
            count = np.diff(edges)
            value = mix(sums[edges[1:]] - sums[edges[:-1]] + np.arange(1, cells + 1, dtype=U) * U(BASE))
            held = count[subsets].sum(axis=2)  # part, subset
            sig = mix(value[subsets].sum(axis=2, dtype=U) + mix(np.arange(held.size, dtype=U).reshape(held.shape) + U(band << 32)))
            empty = held == 0
            out.append(sig[~empty] if empty.any(axis=1).sum() <= extra else sig.ravel())
        return np.concatenate(out)


@lru_cache(maxsize=None)
def part_enum(num: int, den: int) -> PartEnum:
    """The one of a process: its plans outlast a task, for they take longer than the signatures of a task's sets."""
    return PartEnum(num, den)


def shared_pairs(d: np.ndarray, size: int, enum: PartEnum) -> np.ndarray:
    """Signatures of a set of `size` elements of which d (sorted) differ from a pivot's.

    Two similar sets, not both similar to the pivot, have one in common. They differ in at most k elements and share t of those
    of d; as |d| is known to within a step for both, t is at least (|d| + |d'| - k) / 2, and at least 1: where they share none,
    each is less similar to the other than to the pivot. Of t shared elements in t - 1 buckets two share a bucket.
    """
    own, out = enum.band(size), []
    for band in (own, own + 1):
        k = enum.differences(band)
        step = max(1, k // 4)
        at, buckets = len(d) // step, {}
        for other in range(max(0, at - k // step - 1), at + k // step + 2):
            low, high = min(at, other), max(at, other)
            t = max(1, -(-((low + high) * step - k) // 2))
            if t >= (low + 1) * step and t > 1:
                continue  # the smaller d has fewer
            if t not in buckets:
                buckets[t] = d if t == 1 else _pairs(d, t - 1)
            out.append(mix(buckets[t] + mix(np.array([band << 42 | low << 21 | high], dtype=U))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=U)


def _pairs(d: np.ndarray, buckets: int) -> np.ndarray:
    """A hash of each pair of elements that share a bucket."""
    h = mix(d ^ U(0x2545F4914F6CDD1D))
    b = h % U(buckets)
    order = np.argsort(b, kind="stable")
    b, h = b[order], h[order]
    out, gap = [], 1
    while gap < len(b):
        same = b[gap:] == b[:-gap]
        if not same.any():
            break
        x, y = h[gap:][same], h[:-gap][same]
        out.append(mix(np.minimum(x, y)) + np.maximum(x, y))
        gap += 1
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def parity(d: np.ndarray) -> np.ndarray:
    """128 bits: whether an odd number of the elements fall on each. Those of two sets differ in no more bits than the sets in elements."""
    odd = np.bincount((mix(d ^ U(0x9FB21C651E98DF25)) >> U(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def odd_bits(s: np.ndarray) -> bytes:
    """Whether an odd number of the elements fall on each of about as many bits as there are elements (a power of 2, 64 at least).

    Those of two sets differ in no more bits than the sets in elements; of unrelated sets in nearly half of them.
    """
    size = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ U(0x7FB5D329728EA185)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def odd_gap(a: bytes, b: bytes) -> int:
    """In how many bits two odd_bits() differ; the longer one is folded to the length of the other first."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
