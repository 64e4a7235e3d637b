"""Helpers the training-data operators share: Arrow text buffers, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tessella.functions.lineage import Tables, checkpoint, shared_folder, shuffles_freed  # noqa: F401

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside the terms ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: all of ASCII but letters and digits.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_KEYS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_KEYS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes of neighbouring words that are hashed together, the powers of ``STEP`` over them, and those of its inverse modulo 2^64.
_SPAN = 1 << 15
_POWERS = np.cumprod(np.full(_SPAN, STEP, dtype=np.uint64))
_BACK = np.cumprod(np.append(np.uint64(1), np.full(_SPAN - 1, pow(int(STEP), -1, 1 << 64), dtype=np.uint64)))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def runs(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, as of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts that lie one after another in ``data``, and the number of words of each.

    ``offsets`` are positions in ``data``; equal words have equal hashes in every text, task and run.
    """
    return word_places(data, offsets, lower)[:2]


def word_places(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``words`` gives, and where each word begins in ``data`` and its length in bytes; ``blank`` are the bytes between words."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    block = data[lo:hi]
    ink = np.frombuffer(block.tobytes().translate((~blank).tobytes()), dtype=bool)
    cuts = offsets[1:-1] - lo
    edge = np.empty(len(block) + 1, dtype=bool)
    edge[[0, -1]] = True
    np.not_equal(ink[1:], ink[:-1], out=edge[1:-1])
    edge[cuts] = True  # a word ends with its text
    edges = np.flatnonzero(edge)
    inked = ink[edges[:-1]]
    starts, sizes = edges[:-1][inked], np.diff(edges)[inked]
    counts = np.diff(np.searchsorted(starts, offsets - lo))
    keys = np.where(blank, np.uint64(0), BYTE_KEYS[LOWER] if lower else BYTE_KEYS)
    out = np.empty(len(starts), np.uint64)
    at, ends = 0, starts + sizes
    while at < len(starts):
        # powers rise from the first word of a few on, and what a word has too many of is taken back
        a = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, a + _SPAN, side="right")))
        b = int(ends[to - 1])
        values = keys.take(block[a:b])
        values *= _POWERS[: b - a] if b - a <= _SPAN else np.cumprod(np.full(b - a, STEP, dtype=np.uint64))
        here = starts[at:to] - a
        out[at:to] = np.add.reduceat(values, here) * _BACK[here]
        at = to
    return mix(out + sizes.astype(np.uint64)), counts, starts + lo, sizes


def steps(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run of ``size``, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - first, size)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of one text; with fewer words, of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < size:
        return mix((hashes * SHINGLE_KEYS[:n]).sum(keepdims=True) + np.uint64(n))
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * SHINGLE_KEYS[k]
    return np.unique(mix(total))
