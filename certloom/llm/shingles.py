"""Word shingles as 64-bit hashes, and what regions are made of."""

from __future__ import annotations

import numpy as np
import xxhash

from certloom.shipping import by_value

#: Multipliers of the words of a shingle: odd numbers out of a linear rule.
_FACTORS = (np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z lowered (bytes.split and bytes.lower know ASCII alone)."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words are one run."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), dtype=np.uint64, count=len(found))
    with np.errstate(over="ignore"):
        if len(h) < size:
            return mix((h * _FACTORS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)) * _FACTORS[-1])
        total = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for i in range(size):
            total += h[i : len(h) - size + 1 + i] * _FACTORS[i]
    return np.unique(mix(total))


def node_of(found: np.ndarray) -> int:
    """One number for a set: equal sets have the same."""
    digest = xxhash.xxh3_64_intdigest(found.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def parities(found: np.ndarray, width: int = 512) -> list[int]:
    """`width` bits, each the parity of how many elements fall on it: two sets differ in at least as many elements as bits."""
    bits = np.bincount((found >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


#: Counters of how common shingles are, and the chunks in which they are added up: a fixed size whatever the corpus.
COUNTERS = 1 << 22
CHUNKS = 1 << 10


def counters(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(42)).astype(np.int64)


def rarest(found: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set of which a linked one must have some, rarest first by class, then by hash.

    A set of n elements that links, at percent / 100 similarity or more, shares at least n * percent / 100 of them:
    it can lack few enough that it has one of the rarest ones returned. With a set of its own size or a larger one it
    shares even 2 * percent / (100 + percent) of its own, so one of the first `inner` of these is in both.
    Sets that link with equal ones alone need none.
    """
    n = len(found)
    if n * (100 - percent) < percent:
        return found[:0], 0
    outer = n + (-n * percent // 100) + 1
    inner = n + (-2 * n * percent // (100 + percent)) + 1
    return found[np.lexsort((found, classes[counters(found)]))[:outer]], inner


by_value(__name__)
