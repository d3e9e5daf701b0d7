"""Word shingles of many texts at once: distinct hashes, fingerprints and prefixes in numpy.

A slab of texts is hashed as one array: words by running sums, shingles by sums over neighbouring
words, so the cost follows the bytes and not the number of texts or shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliant.llm.substrings import MIX, STEP, STEP_BACK, powers, window_hashes, word_hashes, word_places

SLAB = 1 << 18
ROWS = 1 << 15
CLASSES = 512
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Powers:
    """The factors of the running sums, for texts up to a length that grows on demand."""

    def __init__(self) -> None:
        self.ahead, self.back = powers(STEP, 1 << 16), powers(STEP_BACK, 1 << 16)

    def upto(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length > len(self.ahead):
            self.ahead, self.back = powers(STEP, 2 * length), powers(STEP_BACK, 2 * length)
        return self.ahead, self.back


@dataclass
class Shingled:
    """The distinct shingle hashes of texts, text by text, in the order of (in `last`, hash); `sizes` counts them, `early` those not in `last`."""

    hashes: np.ndarray
    sizes: np.ndarray
    early: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def parts(self, most: np.ndarray | None = None) -> list[bytes]:
        """Each text's hashes as bytes, the first `most` of them if given."""
        counts = self.sizes if most is None else np.minimum(most, self.sizes)
        return [self.hashes[a : a + n].tobytes() for a, n in zip(self.starts.tolist(), counts.tolist())]

    def heads(self, most: np.ndarray, count: int) -> np.ndarray:
        """Each text's first `count` hashes that are not in `last`, and its first `count` in it, all among its first `most`; zeros fill up."""
        rows = np.zeros((len(self.sizes), 2 * count), np.uint64)
        ends = np.minimum(most, self.sizes)
        for begin, end, columns in ((np.zeros_like(ends), np.minimum(ends, self.early), slice(0, count)), (self.early, ends, slice(count, 2 * count))):
            place = begin[:, None] + np.arange(count)
            there = place < end[:, None]
            rows[:, columns][there] = self.hashes[(self.starts[:, None] + place)[there]]
        return rows

    def parities(self, classes: int = CLASSES) -> np.ndarray:
        """For each text, a bit for each hash class: whether the number of its hashes in it is odd; as rows of 64-bit words."""
        place = np.repeat(np.arange(len(self.sizes)) * classes, self.sizes) + (self.hashes % np.uint64(classes)).astype(np.int64)
        odd = (np.bincount(place, minlength=classes * len(self.sizes)) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.uint64).reshape(-1, classes // 64)

    def fingerprints(self) -> np.ndarray:
        """Each text's 64 bits that are set in over half of its hashes; zero without any."""
        sums = np.zeros((len(self.sizes), 64), np.int64)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        for first in range(0, len(owner), ROWS):
            own = owner[first : first + ROWS]
            bits = np.unpackbits(self.hashes[first : first + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        return np.packbits(2 * sums > self.sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def shingled(texts: list[bytes], size: int, factors: Powers, last: np.ndarray | None = None) -> Shingled:
    """The distinct shingles of `size` words (fewer words: the whole sequence; none: none); hashes in `last` (sorted) go last."""
    blob = b"\n".join([t.translate(LOWER) for t in texts]) + b"\n"
    starts, ends = word_places(blob)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    words = word_hashes(blob, starts, ends, *factors.upto(len(blob)))
    found = window_hashes(words, size)
    whole = owner[: len(found)] == owner[size - 1 : size - 1 + len(found)]
    hashes, texts_of = [found[whole]], [owner[: len(found)][whole]]
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for n in range(1, size):
        own = np.flatnonzero(counts == n)
        if len(own):
            value = sum((words[first[own] + k] * MIX[k] for k in range(n)), np.zeros(len(own), np.uint64)) + MIX[size + n]
            hashes.append((value ^ (value >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)), texts_of.append(own)
    h, d = np.concatenate(hashes), np.concatenate(texts_of)
    late = np.zeros(len(h), bool) if last is None or not len(last) else last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
    order = np.lexsort((h, late, d))
    h, d, late = h[order], d[order], late[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return Shingled(h[new], np.bincount(d[new], minlength=len(texts)), np.bincount(d[new & ~late], minlength=len(texts)))


def prefix_lengths(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """So many first shingles, in any common order, of sets of these sizes: two sets that are similar enough share one of them at least."""
    return np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)


def least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """So many shingles of their prefixes two similar sets of these sizes share at least: what they share less what may lie behind a prefix."""
    both = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    behind = np.maximum(np.ceil(similarity * n - 1e-9), np.ceil(similarity * m - 1e-9)) - 1
    return np.maximum(1, both - behind).astype(np.int64)


def may_be_similar(n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and parities can be similar: each bit that differs is a shingle that only one has, and similar sets have few."""
    apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `similarity` at least."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9
