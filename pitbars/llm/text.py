"""Words and word-sequence hashes of whole Arrow columns, computed with numpy.

A word is a run of bytes of ``[0-9a-z]`` and of every non-ASCII character, after A-Z is
lower-cased. UTF-8 keeps non-ASCII characters in bytes of 0x80 and above, so the split can
be made on bytes. Texts are taken in blocks of bounded size; only a single text larger than
a block makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 18
#: An Arrow batch of texts ends at the first of these; one text may be larger.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in small batches, to bound what a task holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit result (a fixed public finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mixed(x ^ _U((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))
        return self.up[:n], self.down[:n]


@dataclass
class Block:
    """Words of the texts ``first`` up to ``first + count`` of a column.

    ``text`` is the index of a word's text within the block, ``hash`` its 64-bit hash, and
    ``bounds[i]:bounds[i + 1]`` are the words of text ``i``.
    """

    first: int
    count: int
    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, powers: _Powers, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks. Null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield _block(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], powers)
        at = stop


def _block(first: int, data: np.ndarray, offsets: np.ndarray, powers: _Powers) -> Block:
    n, count = len(data), len(offsets) - 1
    folded = _LOWER[data]
    word = _IS_WORD[folded]
    before = np.empty(n + 1, dtype=bool)
    before[0] = before[n] = False
    before[1:n] = word[: n - 1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(word & ~before[:n])
    after = np.zeros(n, dtype=bool)
    if n:
        after[: n - 1] = word[1:]
        cut = inner[(inner > 0)] - 1
        after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE_VALUES[folded] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    bounds = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(count, dtype=np.int64), np.diff(bounds))
    return Block(first, count, data, offsets, text, hashes, bounds)


def grams(block: Block, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and which of them lie within one text.

    Position ``i`` stands for the run that starts at word ``i`` of the block.
    """
    n = len(block.hash) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    total = np.zeros(n, dtype=_U)
    for j in range(k):
        total = total * _U(_BASE) + block.hash[j : j + n]
    return salted(total, salt * 64 + k), block.text[:n] == block.text[k - 1 : k - 1 + n]


def grams_at(block: Block, positions: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hashes that :func:`grams` has at the given positions."""
    total = np.zeros(positions.shape, dtype=_U)
    for j in range(k):
        total = total * _U(_BASE) + block.hash[positions + j]
    return salted(total, salt * 64 + k)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as an Arrow list column."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
