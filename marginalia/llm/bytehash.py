"""Vectorised hashing of byte buffers: many texts laid end to end, hashed with prefix sums modulo 2^64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: ASCII white space: what `[^\x20\x09-\x0D]+` does not take.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are handled in pieces of about so many bytes, so that a task's memory does not depend on the batch.
PIECE = 2 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse; kept while they are of a piece's size."""
    have = _POWERS.get(which)
    if have is not None and len(have[0]) >= n:
        return have[0][:n], have[1][:n]
    made = []
    for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(max(n, PIECE + 64), b, dtype=U)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 2 * PIECE:
        _POWERS[which] = (made[0], made[1])
    return made[0][:n], made[1][:n]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i..j) times powers."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(which, len(values) + 1)[0][:-1], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[start..end), equal for equal values wherever they stand."""
    return mix((p[end] - p[start]) * powers(which, len(p))[1][start])


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text comes alone. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, len(texts))
        yield at, data[off[at] : off[to]], (off[at : to + 1] - off[at]).astype(np.int64)
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text; words never cross texts. gap: by byte, no word."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~gap[buf]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[:n]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    end = np.flatnonzero(np.concatenate([[False], after[:n] & (~inside[1:] | edge[1:])]))
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, after the byte table `fold`."""
    values = (fold[buf] if fold is not None else buf).astype(U) + U(1)
    return spans(prefix(values, which), start, end, which)
