"""Array kernels over concatenated UTF-8 texts: words, rolling hashes, word shingles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and odd factors for the places of a shingle's words.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Words longer than this are hashed one by one (rolling hashes of long regular strings can be made to collide).
LONG_WORD = 256

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, base % (1 << 64), U64)])) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of value(byte i) * base**i over s <= i < e."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e], independent of where the span stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed after each, as bytes, and where each begins (then the end)."""
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space; the data ends with white space."""
    inside = np.concatenate([[False], IS_WORD[data]]).astype(np.int8)
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.append(np.flatnonzero(change == -1), []).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    out = span_hashes(prefix_sums(data) if sums is None else sums, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def shingles(texts: Sequence[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes of each text, sorted within the text, and where each text's part begins (then the end).

    Words are lower-cased (A-Z). A text of fewer words than ``size`` has its whole sequence as
    its one shingle; one without words has none.
    """
    data, at = joined(texts)
    data = lower_ascii(data)
    starts, ends = words(data)
    ends = ends[: len(starts)]
    hashes = word_hashes(data, starts, ends)
    text = np.searchsorted(at, starts, "right") - 1
    counts = np.bincount(text, minlength=len(texts))
    n = len(starts) - size + 1
    parts, owners = [], []
    if n > 0:
        fits = np.flatnonzero(text[:n] == text[size - 1 :])
        total = np.zeros(len(fits), U64)
        for j in range(size):
            total += hashes[fits + j] * PLACE[j]
        parts.append(mix(total))
        owners.append(text[fits])
    first = np.concatenate([[0], np.cumsum(counts)])
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        parts.append(mix(np.array([sum(int(h) * int(p) for h, p in zip(hashes[first[i] : first[i + 1]], PLACE[8 * counts[i] :])) % (1 << 64) for i in few], U64)))
        owners.append(few)
    if not parts:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` (at most 32) values, the place of its least value (the leftmost of equals; low 6 bits don't count).

    A window lies in two neighbouring rows of that width: a suffix scan of the left one and a prefix scan of the
    right one meet. The place within the two rows stands in the low bits, so equals go to the left.
    """
    n = len(values)
    rows = -(-n // width) + 1
    grid = np.full(rows * width, U64(0xFFFFFFFFFFFFFFC0))
    grid[:n] = values & U64(0xFFFFFFFFFFFFFFC0)
    grid = grid.reshape(rows, width)
    column = np.arange(width, dtype=np.uint64)
    left = np.minimum.accumulate((grid | column)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    right = np.minimum.accumulate(grid | (column + U64(width)), axis=1).reshape(-1)
    first = np.arange(n - width + 1)
    least = left[: n - width + 1].copy()
    if width > 1:
        inner = first % width > 0  # a window that fills a row has no right part
        least[inner] = np.minimum(least[inner], right[first[inner] + width - 1])
    return first // width * width + (least & U64(63)).astype(np.int64)
