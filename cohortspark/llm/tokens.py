"""Vectorised hashing of words and punctuation runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed in pieces of at most this size, so memory does not follow the longest text.
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 0 white space, 1 letters, digits and non-ASCII bytes, 2 other signs
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64: ``size`` at least, kept for the process."""
    global _powers
    if _powers is None or len(_powers[0]) < size:
        size = 1 << max(18, size.bit_length())
        tables = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers = tables[0], tables[1]
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(33))) * _MIX[0]
    values = (values ^ (values >> np.uint64(33))) * _MIX[1]
    return values ^ (values >> np.uint64(33))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of at most ``PIECE_BYTES``, cut at white space where there is some."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        cut = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
        end = cut if cut > start else end
        yield text[start:end]
        start = end
    yield text[start:]


def groups(texts: Iterable[bytes], most: int | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of many texts in groups of about ``most`` bytes, with the number of their text.

    As large as a piece may be if not given; a larger piece is a group of its own.
    """
    most = most or PIECE_BYTES
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0
    for number, text in enumerate(texts):
        for piece in pieces(text):
            if parts and size + len(piece) + 1 > most:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(number)
            parts.append(piece)
            size += len(piece) + 1
    if parts:
        yield numbers, parts


def token_hashes(parts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the pieces, in order, and the index of its piece.

    A token is a run of letters, digits and non-ASCII bytes, or a run of other signs. Its
    hash is a polynomial of its bytes, read off prefix sums.
    """
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _KIND[data]
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(data)]])
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    powers, inverse = _power_tables(len(data))
    weights = ((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * powers[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weights, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return hashes, np.searchsorted(np.cumsum(sizes), starts, side="right")
