"""Shingle sets of texts as 64-bit hashes, and their circulant MinHash signatures (NumPy, batch-wise)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

#: A word is one kana or Han character, or a longest run of other letters and numbers.
WORD = re.compile("[぀-ヿ㐀-鿿]|[^\\W_぀-ヿ㐀-鿿]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 32-bit values (murmur finaliser), in place."""
    x ^= x >> np.uint32(16)
    x *= _A
    x ^= x >> np.uint32(13)
    x *= _B
    x ^= x >> np.uint32(16)
    return x


class WordHashes(dict):
    """Word to 64-bit hash; forgotten when it holds too many words, which changes no result."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Characters of text that one NumPy pass takes together.
PASS_CHARS = 1_000_000


def passes(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of successive runs of ``texts`` with some ``PASS_CHARS`` characters each."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= PASS_CHARS or i == len(texts) - 1:
            yield start, i + 1
            start, chars = i + 1, 0


def _runs(parts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``span`` successive parts inside each text: distinct, sorted by text and hash, with their texts."""
    h = np.zeros(max(0, len(parts) - span + 1), np.uint64)
    for i in range(span):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[i : i + len(h)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[: len(h)] == owner[span - 1 :][: len(h)]
    h, owner = h[inside], owner[: len(h)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[new], owner[new]
    return h, owner


def word_shingles(texts: list[str], words: int, least: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` successive words of each text, and their texts; none for texts under ``least`` words."""
    found = [WORD.findall(t.lower()) for t in texts]
    found = [f if len(f) >= least else [] for f in found]
    sizes = np.array([len(f) for f in found], np.int64)
    return _runs(np.fromiter(map(cache.__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum())), sizes, words)


def char_shingles(texts: list[str], chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the substrings of ``chars`` characters of each text, and their texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _runs(codes, np.array([len(t) for t in texts], np.int64), chars)


def signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of the sets that begin at ``starts``: one permutation of the 32-bit universe spreads the elements,
    a second one, shifted circularly by k, ranks them for coordinate k."""
    spread = mix32((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        x = spread + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
        x ^= np.uint32(0x5BD1E995)
        out[:, k] = np.minimum.reduceat(mix32(x), starts)
    return out


def bands(sigs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per set and band of ``rows`` coordinates; keys of different bands differ."""
    m = sigs.reshape(len(sigs), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, m.shape[1] + 1, dtype=np.uint64), m.shape[:2])
    for j in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, j])
    return h


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit keys of whole sets."""
    ends = np.append(starts[1:], len(shingles))
    raw = shingles.view(np.uint8)
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(starts, ends)], np.uint64)
