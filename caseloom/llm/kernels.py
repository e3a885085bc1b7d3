"""Vectorised text kernels shared by the Arrow-batched operators.

Everything works on the UTF-8 bytes of an Arrow string column.  Words are the
maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` and never cross a document
border.  Byte-level work goes through pieces of at most about ``PIECE`` bytes,
so that the temporary arrays stay small however long a document is.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

PIECE = 1 << 20
#: Words above this many bytes are hashed by BLAKE2, shorter ones eight bytes at a time.
LONG_WORD = 64

_U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

#: Window hashes are polynomials over the prime field of this size: no power of two divides their differences.
PRIME = (1 << 61) - 1
_WINDOW_BASE = 0x16E8FEB86659FD93
_LANE = _U(0x9E3779B97F4A7C15)
#: Masks that keep the first 0 to 8 bytes of a little-endian lane.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Values hashed at a time, so that temporary arrays stay in the processor's cache.
_STRIP = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; equal inputs give equal outputs and close ones do not."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray):
    """Borders of pieces that never cut a word (unless a document border lies there too)."""
    at, size = 0, len(data)
    while at < size:
        end = min(at + PIECE, size)
        if end < size:
            spaces = np.flatnonzero(IS_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                while end < size and not IS_SPACE[data[end]]:
                    end += 1
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of every document."""
    starts, ends = [], []
    borders = np.unique(offsets)
    for at, end in _pieces(data):
        space = IS_SPACE[data[at:end]]
        before = np.empty(len(space), bool)
        before[0] = True
        before[1:] = space[:-1]
        after = np.empty(len(space), bool)
        after[-1] = True
        after[:-1] = space[1:]
        inside = borders[np.searchsorted(borders, at, "right") : np.searchsorted(borders, end)] - at
        before[inside] = True
        after[inside - 1] = True
        word = ~space
        starts.append(np.flatnonzero(word & before) + at)
        ends.append(np.flatnonzero(word & after) + at + 1)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, counts


def _word_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool):
    """Words in pieces: (slice of words, bytes with eight zeros after them, starts and ends therein)."""
    done = 0
    while done < len(start):
        base = start[done]
        upto = max(done + 1, int(np.searchsorted(end, base + PIECE, "right")))
        s, e = start[done:upto] - base, end[done:upto] - base
        raw = np.zeros(int(e[-1]) + 8, np.uint8)
        raw[:-8] = LOWER_ASCII[data[base : base + e[-1]]] if lower else data[base : base + e[-1]]
        yield slice(done, upto), raw, s, e
        done = upto


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (a view, not a copy)."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word's bytes, optionally with A-Z lower-cased.

    Lanes of eight bytes go through a bijective mixer in turn, so words of one
    length up to eight bytes never share a hash, and there is no arithmetic
    structure that longer words could exploit.
    """
    out = np.empty(len(start), np.uint64)
    for words, raw, s, e in _word_pieces(data, start, end, lower):
        lanes, n = _lanes(raw), e - s
        h = mix((lanes[s] & _KEEP[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _LANE))
        at, k = np.flatnonzero(n > 8), 8
        while len(at) and k < LONG_WORD:
            h[at] = mix(h[at] ^ ((lanes[s[at] + k] & _KEEP[np.minimum(n[at] - k, 8)]) * _LANE))
            k += 8
            at = at[n[at] > k]
        for i in at.tolist():
            h[i] = _U(int.from_bytes(hashlib.blake2b(raw[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little"))
        out[words] = h
    return out


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and second eight bytes of every word and its length: words of up to 16 bytes are equal if and only if these are."""
    low, high = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for words, raw, s, e in _word_pieces(data, start, end, False):
        lanes, n = _lanes(raw), e - s
        low[words] = lanes[s] & _KEEP[np.minimum(n, 8)]
        high[words] = lanes[np.minimum(s + 8, len(lanes) - 1)] & _KEEP[np.clip(n - 8, 0, 8)]
    return low, high, end - start


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME, for x and c below it, in halves of 31 and 30 bits that never overflow 64."""
    c1, c0 = _U(c >> 31), _U(c & 0x7FFFFFFF)
    x1, x0 = x >> _U(31), x & _U(0x7FFFFFFF)
    middle = x0 * c1 + x1 * c0
    return _reduced(x1 * (c1 + c1) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + x0 * c0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.minimum(x, x - _U(PRIME))  # below PRIME the subtraction wraps to something greater


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values: the mixed sum of v[i+j] * B**(width-1-j) modulo PRIME.

    Windows of doubled length are joined from two halves, so the work is
    logarithmic in the width.
    """
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out = np.empty(len(values) - width + 1, np.uint64)
    for at in range(0, len(out), _STRIP):
        out[at : at + _STRIP] = _rolling(_reduced(values[at : at + _STRIP + width - 1]), width)
    return out


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    total, have, joined = None, 0, 0
    part, length, factor = values, 1, _WINDOW_BASE
    while True:
        if width & length:
            if total is None:
                total, have = part, length
            else:  # the part stands before what there is
                n = len(values) - (length + have) + 1
                total = _reduced(_times(part[:n], pow(_WINDOW_BASE, have, PRIME)) + total[length : length + n])
                have += length
        joined += width & length
        if joined == width:
            return mix(total[: len(values) - width + 1])
        n = len(part) - length
        part = _reduced(_times(part[:n], factor) + part[length : length + n])
        factor = factor * factor % PRIME
        length *= 2


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that start a window lying within one document."""
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - width + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as byte planes of their differences: zero planes cost nothing once compressed."""
    steps = np.diff(keys, prepend=_U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the 64-bit space starts in the ascending keys."""
    step = ((1 << 64) + buckets - 1) // buckets
    edges = np.array([step * i for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def doc_texts(column: pa.Array):
    """The texts of a column as bytes, one at a time; nulls are empty."""
    data, offsets = text_buffers(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def parts(batches, column: int, size: int = 2 << 20):
    """Record batches cut so that the texts of ``column`` stay near ``size`` bytes (or are one text)."""
    for batch in batches:
        lengths = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64) + 64
        group = np.cumsum(lengths) // size
        first = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
