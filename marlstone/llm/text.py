"""Vectorised text kernels: bytes, words and n-gram hashes of Arrow string batches.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters.
A string batch is handled as one byte buffer with offsets, so that cost is a few
numpy passes over the bytes, whatever the number of rows. Null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _MIX = 0x9E3779B97F4A7C15 | 1, U(0xBF58476D1CE4E5B9)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_KEPT = 1 << 21
_POW: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; up to ``_KEPT`` of them are kept."""
    have = _POW
    if len(have["p"]) < n:
        m = 1 << (n - 1).bit_length()
        have = _POW if m <= _KEPT else {}
        for k, base in (("p", _P), ("i", pow(_P, -1, 2**64))):
            a = np.full(m, base, U)
            a[0] = 1
            have[k] = np.cumprod(a, dtype=U)
    return have["p"][:n], have["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MIX
    return h ^ (h >> U(29))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string array."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``span``; and the inverse powers."""
    p, inv = powers(len(data) + 1)
    s = np.empty(len(data) + 1, U)
    s[0] = 0
    np.cumsum(_BYTE[data] * p[:-1], out=s[1:])
    return s, inv


def span(s: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), equal wherever the bytes are equal."""
    return mix((s[end] - s[start]) * inv[start])


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's offsets into them (rows + 1)."""
    w = table[data]
    before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    if len(w):
        full = offs[:-1] < offs[1:]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(w & ~before)
    return starts, np.flatnonzero(w & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    s, inv = sums(data)
    return span(s, inv, starts, ends)


def owners(offs: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(h: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and their offsets.

    A row of 1 to n-1 words has one shingle, of all its words; a row without words none.
    """
    p, inv = powers(len(h) + 1)
    s = np.empty(len(h) + 1, U)
    s[0] = 0
    np.cumsum(h * p[:-1], out=s[1:])
    size = np.diff(woffs)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    row = owners(offs)
    start = np.arange(offs[-1]) - offs[:-1][row] + woffs[:-1][row]
    return span(s, inv, start, np.minimum(start + n, woffs[1:][row])), offs


def distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats, and their offsets."""
    row = owners(offs)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)))


def lists(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    """An Arrow list array of 64-bit values."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))


def ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A long column as numpy, null as the least value (rows without an id are dropped earlier)."""
    return pc.fill_null(batch.column(column), -(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)
