"""Word hashing of Arrow text batches, shared by the operators on words.

Words are ``[^\\x20\\x09-\\x0D]+`` (runs without ASCII white space).  A whole batch is handled
with numpy: word edges from a byte table, and one 64-bit hash per word from the prefix sums
of ``table[byte] * R**position`` (R odd, arithmetic modulo 2**64).  Two equal words have equal
hashes wherever they stand; different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_SLICE = 1 << 16  # bytes hashed at a time: bounds the temporaries, not the input


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), for arrays of uint64."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n:
        t = np.full(max(n, _SLICE + 1), base, dtype=np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if len(t) > 4 * _SLICE:  # a giant word: not kept
            return t
        _tables[name] = t
    return t


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    big = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per text the index of its first word
    (length: texts + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a text's first byte never continues the word before it
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span (spans in order, not overlapping)."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[a:b]] * _powers("r", _R, b - a + 1)[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * _powers("i", _RINV, b - a + 1)[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def word_hashes(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, per text the index of its first word) of a string column.
    ``lower`` folds A-Z only."""
    data, offsets = text_bytes(col)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), first


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (len(h) - n + 1 values)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = _powers("r", _R, len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * _powers("i", _RINV, len(h) + 1)[:m])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .. : the ranges laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.repeat(starts - skip, lengths) + np.arange(total)
