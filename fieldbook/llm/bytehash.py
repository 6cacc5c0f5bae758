"""Vectorised 64-bit fingerprints of words, shingles and byte spans.

A span's fingerprint is a polynomial over a table of random numbers, modulo
2**64, so one running sum gives every span of a buffer; a final mix spreads
the bits. Two different spans agree with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: The same, blind to the case of A-Z.
TABLE_LOWER = TABLE.copy()
TABLE_LOWER[65:91] = TABLE[97:123]
#: The white space that parts words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Odd multipliers for the places of a shingle.
PLACES = mix(np.arange(1000, 1064, dtype=U)) | U(1)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """The first n+1 powers of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = (int(n) // (1 << 20) + 1) << 20
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size + 1, r, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def sums(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Running sums over the bytes of buf; spans() takes its fingerprints from them."""
    out = np.empty(len(buf) + 1, U)
    out[0] = 0
    np.cumsum(table[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def spans(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans [start, end)."""
    inverse = powers(len(running))[1]
    return mix((running[end] - running[start]) * inverse[start] + (end - start).astype(U))


def groups(sizes: list[int], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of at most limit bytes in all, or of one item."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a separator after each, and where each starts."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(sep) for t in texts], out=starts[1:])
    return buf, starts


def words(buf: np.ndarray, table: np.ndarray = TABLE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of every word of a buffer that ends in white space."""
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return start, spans(sums(buf, table), start, end)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted fingerprints.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    out: list[np.ndarray] = []
    for lo, hi in groups([len(t) for t in texts]):
        buf, starts = joined(texts[lo:hi])
        at, h = words(buf)
        first = np.searchsorted(at, starts)
        full = np.zeros(max(0, len(h) - size + 1), U)
        for k in range(size):
            full += h[k : k + len(full)] * PLACES[k]
        full = mix(full)
        for k in range(hi - lo):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= size:
                s = np.sort(full[a : b - size + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                out.append(mix((h[a:b] * PLACES[: b - a]).sum(keepdims=True) + U(b - a)))
            else:
                out.append(np.empty(0, U))
    return out
