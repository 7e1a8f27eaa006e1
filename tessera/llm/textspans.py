"""Vectorised views of text: Arrow string columns as byte arrays with word, line and window spans.

All functions work on one slice of a batch: ``data`` (uint8) holds the documents' UTF-8 bytes end to end and
``offsets`` (n + 1) the documents' borders. ASCII white space never is part of a longer UTF-8 sequence, so words and
lines can be cut on bytes; code points are counted as bytes that don't continue a sequence.

Memory follows the slice (``SLICE_BYTES``) or, if that is longer, the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 3 << 20
LONG_SPAN = 96  # bytes; longer spans are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The low k bytes of a word of eight.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, or of a single longer document."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, data, offsets from 0) for each slice of a column."""
    data, offsets = text_arrays(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The document that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that aren't ASCII white space, never over a document's border."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(data)]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = borders[borders > 0] - 1
    last[ends_at] = inside[ends_at]
    return starts, np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, of A-Z in lower case if asked for.

    A span is taken in by words of eight bytes with a full mix after each, so structured texts don't collide as they do
    in a polynomial modulo 2**64; spans of one size of at most eight bytes never collide.
    """
    if lower:
        data = _LOWER[data]
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at, left = starts[live], sizes[live]
    while len(live):
        out[live] = mix(out[live] ^ (loads[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed))
    return out


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``width`` words of one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[first + k])
    return first, total


def per_document(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights, or number of rows, by document."""
    return np.bincount(owner, weights, n).astype(np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
