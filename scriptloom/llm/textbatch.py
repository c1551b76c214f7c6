"""Arrow text columns as flat byte arrays: numpy sees the bytes of many documents at once.

A *chunk* is a run of rows of one Arrow batch with at most ``CHUNK_BYTES`` of text (one row at
least), so working memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 500
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_table(inside) -> np.ndarray:
    """A lookup table of 256 booleans."""
    table = np.zeros(256, dtype=bool)
    table[list(inside)] = True
    return table


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, for mapInArrow: its session is set to hand over at most ``BATCH_ROWS`` rows at a time.

    Texts may be long, so Spark's 10,000 rows could fill a worker. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


@dataclass
class Chunk:
    """Rows ``first`` to ``first + len(self)`` of a batch; row i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's UTF-8 bytes in chunks; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        lo, hi = int(offsets[at]), int(offsets[end])
        yield Chunk(at, data[lo:hi], offsets[at : end + 1] - lo)
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross rows, and where each row's runs begin."""
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1]
    before[edges[edges < len(inside)]] = False
    edges = offsets[1:] - 1
    after[edges[edges >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int | None = None) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, from one prefix sum over all bytes; ``base`` is odd."""
    n = len(data)
    p, inverse_p = (_P, _P_INVERSE) if base is None else (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
    powers = np.full(n + 1, p, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=prefix[1:])
    inverse = np.full(n + 1, inverse_p, dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + lengths)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i; rows may be empty."""
    total = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        total[full] = np.add.reduceat(values[: bounds[-1]], bounds[full], axis=0, dtype=np.float64)
    return total
