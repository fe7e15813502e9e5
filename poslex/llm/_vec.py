"""Vectorised text work on Arrow string columns, shared by the operators of this subpackage.

A *token* is a maximal run of bytes outside ASCII white space (tab to carriage return, and space). Hashes are
polynomial over the bytes, modulo 2**64, then mixed; they depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 20
#: Bytes of text worked on at a time (a longer single text is worked on whole).
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[U, np.ndarray] = {}


def _powers(base: U, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n + 1:
        steps = np.full(max(n + 1, _BLOCK + 1), base, U)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U)
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; another seed gives an independent-looking function."""
    with np.errstate(over="ignore"):
        h = h + U((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(32))


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """The column as one large_string array with null read as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a large_string array, offsets starting at 0."""
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that cover the column, of about size bytes each and one row at least."""
    off = buffers(column)[1]
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every token; tokens never run over a row's end."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for ascending spans that don't overlap."""
    out = np.empty(len(start), U)
    at, n = 0, len(start)
    with np.errstate(over="ignore"):
        while at < n:
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, base + _BLOCK, "right")))
            size = int(end[to - 1]) - base
            sums = np.zeros(size + 1, U)
            np.cumsum(raw[base : base + size].astype(U) * _powers(_P, size)[:size], out=sums[1:])
            s = start[at:to] - base
            out[at:to] = (sums[end[at:to] - base] - sums[s]) * _powers(_PINV, size)[s]
            out[at:to] += (end[at:to] - start[at:to]).astype(U) << U(56)
            at = to
    return mix(out)


def counts_by(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)
