"""Column-wise text work inside Spark tasks: whole Arrow string columns as byte arrays.

A batch is walked in slices of about ``SLICE`` bytes, so memory follows the slice
(or one single text, if that is longer), never the batch or the group. Words are
maximal runs of bytes other than space and 0x09-0x0D, in any UTF-8 text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

SLICE = 1 << 19
PART = 2048
WORD = r"[^\x20\x09-\x0D]+"

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


@dataclass
class Texts:
    """Consecutive texts of a batch: text ``i`` is ``data[offsets[i]:offsets[i+1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    _sums: np.ndarray | None = field(default=None, repr=False)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        """The same texts with A-Z in lower case."""
        return Texts(self.first, _LOWER[self.data], self.offsets)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges of bytes have equal hashes."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * _power(_BASE, n), out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _power(_INVERSE, len(self.data) + 1)[start])

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the maximal runs of equal non-zero ``kind`` within a text; kind has one value a byte."""
        n = len(self.data)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        cut[self.offsets[:-1]] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        keep = kind[start] != 0
        start, end = start[keep], end[keep]
        return start, end, np.searchsorted(self.offsets, start, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the words, in order."""
        return self.runs((~_SEP[self.data]).view(np.uint8))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each text."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of a string column in slices of at most ``limit`` bytes or one text; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield Texts(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def shingles(word_hash: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words that lies within one text."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = word_hash[:n].copy()
    for k in range(1, size):
        x = mix(x * np.uint64(_BASE) + word_hash[k : k + n])
    inside = text[:n] == text[size - 1 :]
    return x[inside], text[:n][inside]


def hand_back() -> None:
    """Give freed memory back to the system: a Python worker lives on beside the next stages, and allocators keep what tasks have freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose names an operator is about to give (in any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in taken]) if any(c.lower() in taken for c in df.columns) else df


def keeping(df: DataFrame, names: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(df)`` with the columns of ``df``, also those whose names the step gives or drops: they have other names meanwhile."""
    taken = {n.lower() for n in names}
    held = [f"__own_{k}" if c.lower() in taken else c for k, c in enumerate(df.columns)]
    return step(df.toDF(*held)).select(*held).toDF(*df.columns)


def add_columns(df: DataFrame, new: StructType, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """``df`` with further columns computed from Arrow batches in tasks.

    ``start`` runs once a task and gives the function of a batch of at most ``PART``
    rows, so that what it adds stays small beside the texts. A column of
    ``df`` with the name of a new one is replaced.
    """
    base = without(df, new.fieldNames())

    def run(batches):
        step = start()
        for b in batches:
            for lo in range(0, b.num_rows, PART):
                part = b.slice(lo, PART)
                yield pa.RecordBatch.from_arrays([*part.columns, *step(part)], names=[*part.schema.names, *new.fieldNames()])
            hand_back()

    return base.mapInArrow(run, StructType(base.schema.fields + new.fields))
