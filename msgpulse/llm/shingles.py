"""Word shingles as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


_hashes = _WordHashes()


def mixed_bits(values: np.ndarray) -> np.ndarray:
    """A bijection on ``uint64`` that spreads every bit."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def forget() -> None:
    """Drop the word hashes kept by this worker; a task calls it when it ends, so that a reused
    worker does not carry them into the next stage."""
    global _hashes
    _hashes = _WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words (runs without ASCII white space).

    A text of fewer words has one shingle, all of it; a text without words has none.
    """
    global _hashes
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > _LIMIT:
        _hashes = _WordHashes()
    found = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = found[: len(found) - width + 1].copy()
    for k in range(1, width):
        runs *= _PRIME
        runs += found[k : len(found) - width + 1 + k]
    return np.unique(mixed_bits(runs + np.uint64(width)))


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Banding:
    """MinHash signatures of a set, folded into one hash per band."""

    def __init__(self, bands: int, rows: int, seed: int = 2):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self._factors = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        self._shifts = draw.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 512):
            least = np.minimum(least, (short[at : at + 512, None] * self._factors + self._shifts).min(axis=0))
        folded = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            folded = mixed_bits(folded * _PRIME + row)
        return folded.view(np.int64)


def banding_for(similarity: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows with which pairs at ``similarity`` still meet with ``recall``."""
    fitting = [r for r in range(1, hashes + 1) if 1 - (1 - similarity**r) ** (hashes // r) >= recall]
    rows = max(fitting, default=1)
    return hashes // rows, rows
