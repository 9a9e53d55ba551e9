"""Texts of an Arrow column as byte arrays, and the words in them, without a Python object per word.

All functions work on pieces of about a megabyte, so that memory does not follow the batch or the
number of rows; only one very long text can make a piece larger. Missing texts count as empty.
Words and sets of words are compared by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_LONG_SPAN = 512
_SIDE_BY_SIDE = 64
_TAIL = np.append((np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1), ~np.uint64(0))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets of each row and the end) for runs of rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, whole[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def give_back() -> None:
    """Return what earlier tasks of this worker process have freed to the system; workers serve one stage after another."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class _Powers:
    """Powers known so far. They do not travel with pickled functions; each process works out its own."""

    def __init__(self) -> None:
        self.known = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers.known[0]) < n:
        found = []
        for base in (_BASE, _BASE_INVERSE):
            factors = np.full(max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)
            factors[0] = 1
            found.append(np.cumprod(factors, dtype=np.uint64))
        _powers.known = tuple(found)
    return _powers.known[0][:n], _powers.known[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which neighbouring inputs have unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; a run never crosses a row's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    borders = np.unique(offsets[1:-1])
    borders = borders[(borders > 0) & (borders < len(inside))]
    borders = borders[inside[borders - 1] & inside[borders]]  # a run ends there and another begins
    edges = np.insert(edges, np.searchsorted(edges, borders).repeat(2), borders.repeat(2))
    edges = np.concatenate([np.zeros(int(inside[0]), np.int64), edges, np.full(int(inside[-1]), len(inside))])
    return edges[::2].copy(), edges[1::2].copy()


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and factors from which the rolling hash of any short span follows."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums, down


def rolling_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a few dozen bytes, for lookups at every place of a text; see ``span_hashes`` for others."""
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SEEDS = mixed(np.arange(_LONG_SPAN + 1, dtype=np.uint64) + np.uint64(_BASE))  # by size


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """One 64-bit hash per span of bytes; ``folded`` takes A-Z as a-z.

    Eight bytes at a time are mixed into the hash, so it has no arithmetic structure: different spans share a hash with a chance
    of 2^-64 a pair. Spans of more than ``_LONG_SPAN`` bytes take a BLAKE2 digest.
    """
    if folded:
        data = data + np.uint8(32) * ((data - np.uint8(ord("A"))) < 26)  # bytes below wrap around
    sizes = ends - starts
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    out = _SEEDS[np.minimum(sizes, _LONG_SPAN)]
    left, at, which = sizes, starts, None
    long = np.flatnonzero(sizes > _LONG_SPAN)
    if len(long):
        which = np.flatnonzero(sizes <= _LONG_SPAN)
        left, at = sizes[which], starts[which]
    while len(at):
        lane = lanes[at]
        lane &= _TAIL[np.minimum(left, 8)]
        if which is None:
            out = mixed((out ^ lane) * np.uint64(_BASE))
        else:
            out[which] = mixed((out[which] ^ lane) * np.uint64(_BASE))
        more = np.flatnonzero(left > 8)
        if which is None and not len(more):
            break
        which = more if which is None else which[more]
        left, at = left[more] - 8, at[more] + 8
    for k in long.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, folded: bool = False):
    """(starts, ends, hashes, first word of each row and the end) of the runs without white space."""
    starts, ends = spans((data != 0x20) & ((data - np.uint8(0x09)) > 4), offsets)  # not SPACE; bytes below wrap around
    return starts, ends, span_hashes(data, starts, ends, folded), np.searchsorted(starts, offsets)


def gram_hashes(hashes: np.ndarray, firsts: np.ndarray, size: int, whole_if_short: bool = True):
    """Hashes of the runs of ``size`` words of each row, and the first gram of each row and the end.

    With ``whole_if_short``, a row of fewer words (but at least one) has all its words as its one gram.
    """
    counts = np.diff(firsts)
    n = len(hashes)
    grams = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        if len(grams):
            grams += hashes[k : n - size + 1 + k] * _STEPS[k]
    grams = mixed(grams)
    full = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size) if whole_if_short else np.zeros(len(counts), bool)
    sizes = full + short
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], np.uint64)
    at = np.repeat(firsts[:-1] - bounds[:-1], full + short) + np.arange(bounds[-1])
    is_short = np.repeat(short, sizes)
    out[~is_short] = grams[at[~is_short]]
    for r in np.flatnonzero(short):
        own = hashes[firsts[r] : firsts[r + 1]]
        total = np.uint64((int((own * _STEPS[: len(own)]).sum(dtype=np.uint64)) + 7919 * len(own)) % (1 << 64))
        out[bounds[r]] = mixed(np.array([total ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]
    return out, bounds


def sort_rows(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort each row's values in place; short rows of one size side by side."""
    sizes = np.diff(bounds)
    some = np.flatnonzero((sizes > 1) & (sizes <= _SIDE_BY_SIDE))
    some = some[np.argsort(sizes[some], kind="stable")]
    for group in np.split(some, np.flatnonzero(np.diff(sizes[some])) + 1):
        if len(group):
            at = bounds[:-1][group][:, None] + np.arange(sizes[group[0]])
            values[at] = np.sort(values[at], axis=1)
    for r in np.flatnonzero(sizes > _SIDE_BY_SIDE).tolist():
        values[bounds[r] : bounds[r + 1]].sort()


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each row's values and keep one of each."""
    values = values.copy()
    sort_rows(values, bounds)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    inner = bounds[:-1][bounds[:-1] < len(values)]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[bounds]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values modulo 2^64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:], dtype=np.uint64)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... (counts[0] of them), then the same for the next row."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
