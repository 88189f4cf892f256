"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of ASCII digits, ASCII letters (lower-cased) and any non-ASCII
characters: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Both are decided byte by byte in UTF-8, so a block of texts is processed as
one numpy byte array without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, start: int) -> np.ndarray:
    """n fixed 64-bit constants derived from ``start``."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(start & _MASK)) | _U(1)


_BYTE_CODE = seeds(256, 7)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 18), base, dtype=_U)
        p[0] = 1
        _powers[kind] = have = np.cumprod(p, dtype=_U)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n+1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def blocks(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into row ranges (lo, hi, bytes, offsets) of at most
    ``max_bytes``; a longer row is a range of its own."""
    raw, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    """Words of a block: row, byte range and 64-bit hash of each."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes any byte range's hash."""
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_CODE[data] * _power("pow", _BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal byte strings have equal hashes wherever they stand."""
    inv = _power("inv", _BASE_INV, len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * inv[start]
        return mix(h ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, np.zeros(0, _U))
    low = LOWER[data]
    w = IS_WORD[low]
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(row, start, end, span_hash(byte_prefix(low), start, end))


def windows(w: Words, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of k consecutive words of one row, in
    order; a row of fewer words, but not none, is one window."""
    c = seeds(k, seed)
    n = len(w.hash)
    out_row, out_hash = [], []
    with np.errstate(over="ignore"):
        if n >= k:
            h = np.zeros(n - k + 1, _U)
            for j in range(k):
                h += w.hash[j:n - k + 1 + j] * c[j]
            ok = w.row[:n - k + 1] == w.row[k - 1:]
            out_row.append(w.row[:n - k + 1][ok])
            out_hash.append(mix(h[ok] ^ _U(k)))
        rows, first, count = np.unique(w.row, return_index=True, return_counts=True)
        for r, f, m in zip(rows[count < k], first[count < k], count[count < k]):
            out_row.append(np.array([r]))
            out_hash.append(mix(np.array([(w.hash[f:f + m] * c[:m]).sum(dtype=_U) ^ _U(m)], dtype=_U)))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    row, h = np.concatenate(out_row), np.concatenate(out_hash)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def content_key(w: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's word sequence, as two signed 64-bit arrays; rows
    without words get (0, 0)."""
    parts = []
    counts = np.bincount(w.row, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    pos = np.arange(len(w.row)) - begin[w.row] if len(w.row) else np.zeros(0, np.int64)
    for s in (101, 202):
        with np.errstate(over="ignore"):
            h = mix(mix(w.hash ^ seeds(1, s)[0]) + pos.astype(_U) * _U(_BASE))
        total = np.zeros(n_rows, _U)
        if len(h):
            some = counts > 0
            total[some] = np.add.reduceat(h, begin[some])
        parts.append(np.where(counts > 0, mix(total ^ counts.astype(_U)), _U(0)).astype(np.int64))
    return parts[0], parts[1]
