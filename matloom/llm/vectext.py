"""Vectorised text work on Arrow string columns.

A column's bytes are handled as one uint8 array with row offsets, so word
splitting and hashing take a few NumPy passes instead of a Python loop. Work goes
in slices of rows of bounded total bytes; one very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
LONG_RUN = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes with A-Z mapped to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, of one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def rows_in(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each slice of the batch."""
    data, offsets = spelled(batch.column(batch.schema.get_field_index(column)))
    for a, b in sliced(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i up to n at least."""
    if len(_powers[0]) < n + 1:
        size = 1 << (n + 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], not across rows, and the count of runs before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    flag = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, equal for equal runs wherever they stand.

    Sums of powers, which take one pass; modulo 2^64 these collide on some runs of 1,024 bytes and
    more, so long runs are hashed one by one.
    """
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    out = mixed((sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG_RUN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=LONG_RUN)
    return out


def shingled(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of each row, and their counts by row.

    firsts: the count of words before each row. A row of fewer words, but not none,
    has its whole sequence as the one shingle.
    """
    n = len(words)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    made = np.maximum(counts - k + 1, 0)
    h = words[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(h)])
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, firsts[:-1][made > 0], 1)
    np.add.at(keep, (firsts[:-1] + made)[made > 0], -1)
    h = h[np.cumsum(keep)[: len(h)] > 0]
    if not len(short):
        return h, made
    own = []
    for r in short:
        x = words[firsts[r] : firsts[r] + 1].copy()
        for j in range(firsts[r] + 1, firsts[r + 1]):
            x = mixed(x * np.uint64(0xD6E8FEB86659FD93) + words[j : j + 1])
        own.append(mixed(x + np.uint64(counts[r])))
    at = np.concatenate([[0], np.cumsum(made)])[short]
    made = made.copy()
    made[short] = 1
    return np.insert(h, at, np.concatenate(own)), made


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup of bytes: true in the ranges, ends included."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Runs without ASCII white space.
UNSPACED = ~table_of((9, 13), (32, 32))
#: Runs of ASCII letters, digits and all non-ASCII characters.
ALPHANUMERIC = table_of((48, 57), (65, 90), (97, 122), (128, 255))


def record_batch(rows: list[dict], schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))
