"""Word shingles as 64-bit hashes, shared by the fingerprint and Jaccard-join operators.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased.  Words are hashed with a
multilinear hash (a random multiplier for each position, a random value for each byte), shingles with
a weighted sum of their words' hashes; both are finished with a bijective mixer.  Two different
shingles share a hash with a chance of about 2**-63.  Everything is vectorised numpy over whole texts.
"""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5
#: Bytes hashed at once; longer texts go in segments cut at white space, so memory stays bounded.
SEGMENT_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POSITION = _RNG.integers(0, 2**63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RNG.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _segments(data: bytes) -> list[bytes]:
    """The text in parts of about SEGMENT_BYTES that never cut a word."""
    if len(data) <= SEGMENT_BYTES:
        return [data]
    parts, start = [], 0
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)].nonzero()[0]
    while len(data) - start > SEGMENT_BYTES:
        k = np.searchsorted(space, start + SEGMENT_BYTES)
        if k == len(space):
            break
        parts.append(data[start : space[k]])
        start = int(space[k])
    return [*parts, data[start:]]


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a text in UTF-8, in order, and the byte behind its end."""
    out, ends, offset = [], [], 0
    for part in _segments(data) if data else []:
        b = np.frombuffer(part, dtype=np.uint8)
        inside = ~_SPACE[b]
        at = inside.nonzero()[0]
        if len(at):
            starts = np.empty(len(at), dtype=bool)
            starts[0] = True
            np.not_equal(at[1:], at[:-1] + 1, out=starts[1:])
            first = starts.nonzero()[0]
            size = np.diff(first, append=len(at))
            position = np.arange(len(at)) - np.repeat(first, size)
            value = _BYTE[b[at]] * _POSITION[position & 0xFFFF]
            if size.max() > 1 << 16:
                value *= (position >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            out.append(mix64(np.add.reduceat(value, first) + size.astype(np.uint64)))
            ends.append(at[first] + size + offset)
        offset += len(part)
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(ends)


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word of a whole text, in order; null and blank texts have none."""
    return words_at(text.encode("utf-8", "surrogatepass") if text else b"")[0]


def shingle_hashes(words: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hashes of all n-word shingles in text order; fewer words give one shingle, no words none."""
    if not len(words):
        return words
    if len(words) < n:
        return mix64(np.array([(words * _WORD[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64))
    m = len(words) - n + 1
    total = words[:m] * _WORD[0]
    for j in range(1, n):
        total += words[j : j + m] * _WORD[j]
    return mix64(total)


def shingle_set(text: str | None, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text), n))
