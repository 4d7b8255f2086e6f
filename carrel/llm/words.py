"""Words of a text as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(77_003).integers(1, 2**64 - 1, 256, dtype=np.uint64)[_LOWER]
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 2**64)
SEGMENT = 1 << 20
SHINGLE = 5


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 2**64))
        done += k
    return out


_POWERS = {b: _powers(b, 4096) for b in (_STEP, _BACK)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, 1 << (n - 1).bit_length())
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorts ``values`` in place."""
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about a megabyte, cut at white space; a longer word stays whole."""
    at = 0
    while len(data) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + SEGMENT)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word ``[^ \\x09-\\x0D]+`` of the text with A-Z lower-cased, in order."""
    if not text:
        return np.empty(0, np.uint64)
    out = []
    for data in _segments(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)):
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        bounds = np.concatenate(([0] if not space[0] else [], edge, [len(data)] if not space[-1] else [])).astype(np.int64) if len(data) else np.empty(0, np.int64)
        if not len(bounds):
            continue
        start, end = bounds[0::2], bounds[1::2]
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[data] * _power(_STEP, len(data)), out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * _power(_BACK, len(data))[start]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; of fewer words, the whole sequence as one; of none, none."""
    if not len(words):
        return words
    n = min(width, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = (h + words[i : len(words) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return distinct(mix(h + np.uint64(n)))
