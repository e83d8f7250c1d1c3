"""Vectorised words of UTF-8 texts: whole batches become arrays of 64-bit word hashes.

Both word classes of the contracts only tell ASCII bytes apart, so that every byte of a
multi-byte character is a word byte and one pass over bytes equals one over code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(others: str) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[[ord(c) for c in others]] = False
    return out


#: Letters, digits and all beyond ASCII.
ALNUM = _table("".join(map(chr, range(128))))
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = True
#: All but white space.
SOLID = _table(" \t\n\x0b\x0c\r")

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and the bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    flags = np.zeros(len(raw) + 2, dtype=np.int8)
    flags[1:-1] = is_word[raw]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), raw


def _hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, raw = spans(data, is_word)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def pieces(data: bytes, is_word: np.ndarray) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while len(data) - at > PIECE:
        part = np.frombuffer(data, np.uint8, PIECE, at)
        gaps = np.flatnonzero(~is_word[part])
        end = at + PIECE
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one word longer than a piece
            rest = np.flatnonzero(~is_word[np.frombuffer(data, np.uint8, offset=end)])
            end = end + int(rest[0]) if len(rest) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def words_of(texts: Sequence[bytes | None], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the offsets of each text's words (one more than texts)."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    group: list[bytes] = []
    first, size = 0, 0

    def flush() -> None:
        if group:
            h, starts = _hashes(b"\n".join(group), is_word)
            parts.append(h)
            begins = np.cumsum([0, *(len(x) + 1 for x in group)])
            counts[first : first + len(group)] = np.diff(np.searchsorted(starts, begins))
            group.clear()

    for i, text in enumerate(texts):
        data = text or b""
        if len(data) > PIECE:
            flush()
            for piece in pieces(data, is_word):
                h, _ = _hashes(piece, is_word)
                parts.append(h)
                counts[i] += len(h)
            first, size = i + 1, 0
            continue
        if size + len(data) > PIECE:
            flush()
        if not group:
            first, size = i, 0
        group.append(data)
        size += len(data) + 1
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingles_of(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words; a text of fewer words, but not none, has its whole sequence as one. With offsets."""
    n = np.diff(offsets)
    sizes = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(sizes)))
    if not len(words):
        return np.empty(0, np.uint64), out_offsets
    start = np.repeat(offsets[:-1] - out_offsets[:-1], sizes) + np.arange(out_offsets[-1])
    have = np.minimum(np.repeat(n, sizes), k)
    h = np.zeros(len(start), dtype=np.uint64)
    last = len(words) - 1
    for j in range(k):
        step = mix(h ^ (words[np.minimum(start + j, last)] + np.uint64(j + 1)))
        h = step if j == 0 else np.where(have > j, step, h)
    return h, out_offsets
