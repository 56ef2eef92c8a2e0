"""Bounded-space online packing: a fixed number of open windows a partition.

Documents come in order and are never sorted or gathered. A document's full windows
are sequences at once; its tail goes into the open window with the least room that
holds it, or into a new one while fewer than ``windows`` are open. If none fits, the
fullest takes as much of the tail as it has room for and is emitted full, and the
rest goes on. What is open at the end of a partition, at most ``windows`` windows,
is merged with that of ``FAN`` partitions by the same rule, and so on until one group
is left: its windows are filled one after another, and the last is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from medialake.llm.texts import without
from medialake.llm.tokens import ByteIds
from medialake.operators.ordered import stage

WINDOWS = 16
FAN = 64
END = 0
_ROUND, _TASK = 58, 30  # a sequence's number: round, task or group, count within it
_AT_ONCE = 1 << 20

PIECE = StructType([StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [StructField("ids", BinaryType())])
_PLACE = StructType([StructField("__task", IntegerType()), StructField("__window", IntegerType())])


class Windows:
    """Open windows of one partition or group; pieces are ``(row, start, ids, doc_tokens)``.

    ``closed`` gathers ``(piece, sequence, offset)`` of emitted windows until it is taken.
    """

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.open: list[list] = []  # [room, pieces]
        self.closed: list[tuple] = []

    def put(self, row: int, start: int, ids: bytes, doc_tokens: int) -> None:
        while ids:
            n = len(ids) // 4
            window = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if window is None:
                if len(self.open) < self.most:
                    window = [self.capacity, []]
                    self.open.append(window)
                else:
                    window = min(self.open, key=lambda w: w[0])
            k = min(n, window[0])
            window[1].append((row, start, ids[: 4 * k], doc_tokens))
            window[0] -= k
            start, ids = start + k, ids[4 * k :]
            if not window[0]:
                self.open.remove(window)
                self._emit(window[1])

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.closed.append((p, self.next, at))
            at += len(p[2]) // 4
        self.next += 1

    def finish(self) -> None:
        """Fill what is open one window after another; the last is cut at powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, self.most = [], 1
        for p in rest:
            self.put(*p)
        rest = [p for w in self.open for p in w[1]]
        self.open = []
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = size = 1 << (left.bit_length() - 1)
            some = []
            while room:
                row, start, ids, total = rest.pop(0)
                k = min(room, len(ids) // 4)
                some.append((row, start, ids[: 4 * k], total))
                if k < len(ids) // 4:
                    rest.insert(0, (row, start + k, ids[4 * k :], total))
                room -= k
            self._emit(some)
            left -= size

    def take(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


def _rows(base: pa.Table, names: list[str], placed: list[tuple], keep_ids: bool, task: int | None = None) -> pa.RecordBatch:
    """Rows of placed pieces; with ``task`` they are of windows still open, whose numbers are given as sequences."""
    piece = [p for p, _, _ in placed]
    own = base.take(pa.array([p[0] for p in piece], pa.int64())).combine_chunks()
    sequence = pa.array([s for _, s, _ in placed], pa.int64())
    values = [
        pa.array([p[1] for p in piece], pa.int64()), pa.array([len(p[2]) // 4 for p in piece], pa.int64()), pa.array([zlib.crc32(p[2]) for p in piece], pa.int64()),
        pa.array([p[3] for p in piece], pa.int64()), sequence, pa.array([o for _, _, o in placed], pa.int64()),
        pa.array([p[2] if keep_ids or task is not None else None for p in piece], pa.binary()),
        pa.array([task] * len(piece), pa.int32()), sequence.cast(pa.int32()) if task is not None else pa.nulls(len(piece), pa.int32())]
    return pa.RecordBatch.from_arrays([*(own.column(n).combine_chunks() for n in names), *values], names=[*names, *PIECE.fieldNames(), *_PLACE.fieldNames()])


def _still_open(windows: Windows) -> list[tuple]:
    out = []
    for k, (_, pieces) in enumerate(windows.open):
        out += [(p, k, j) for j, p in enumerate(pieces)]
    return out


def _together(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``_AT_ONCE`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > _AT_ONCE:
            yield lo, i
            lo, total = i, 0
        total += n + 64
    if lo < len(sizes):
        yield lo, len(sizes)


def pack_online(docs: DataFrame, tokenizer: str, capacity: int = 1024, windows: int = WINDOWS, text: str = "text", end: int = END, keep_ids: bool = True, fan: int = FAN) -> DataFrame:
    """The token pieces of every row: its columns but the text, and ``start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A text's ids end with ``end``; null and empty texts are that id alone. Every id
    lies in one piece; a sequence's pieces lie one after another from 0 and make
    ``capacity`` tokens, but for the last few sequences, which are powers of two.
    ``ids`` holds little-endian unsigned 32-bit numbers, null where ``keep_ids`` is
    False (``ids_crc32`` stays). Repeated rows are documents of their own; an empty
    table gives an empty one; columns with the names of new ones are replaced.
    """
    base = without(docs, [*PIECE.fieldNames(), *_PLACE.fieldNames()])
    kept = [f for f in base.schema.fields if f.name != text]
    names = [f.name for f in kept]
    # a name of its own for each column, whatever they are called
    columns = [f"c{k}" for k in range(len(kept))]
    out = StructType([StructField(c, f.dataType) for c, f in zip(columns, kept)] + PIECE.fields + _PLACE.fields)
    last = end.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids, state = ByteIds.of(tokenizer), Windows(capacity, windows, task << _TASK)
        carried: pa.Table | None = None
        for b in batches:
            for lo, hi in _together(b.column(0)):
                part = b.slice(lo, hi - lo)
                rows = pa.Table.from_arrays(part.columns[1:], names=columns) if columns else pa.table({"__n": pa.nulls(hi - lo)})
                n = 0 if carried is None else carried.num_rows
                whole = rows if carried is None else pa.concat_tables([carried, rows])
                for i, body in enumerate(ids(part.column(0).to_pylist())):
                    body += last
                    total = len(body) // 4
                    full = total // capacity * capacity
                    for k in range(0, full, capacity):
                        state.closed.append(((n + i, k, body[4 * k : 4 * (k + capacity)], total), state.next, 0))
                        state.next += 1
                    state.put(n + i, full, body[4 * full :], total)
                placed = state.take()
                if placed:
                    yield _rows(whole, columns, placed, keep_ids)
                held = sorted({p[0] for w in state.open for p in w[1]})
                at = {row: k for k, row in enumerate(held)}
                carried = whole.take(pa.array(held, pa.int64())).combine_chunks()
                for w in state.open:
                    w[1] = [(at[p[0]], *p[1:]) for p in w[1]]
        if state.open:
            yield _rows(carried, columns, _still_open(state), keep_ids, task)

    first = stage(base.select(F.col(f"`{text}`").cast("string"), *[F.col(f"`{n}`") for n in names]).mapInArrow(run, out))
    done, left, turn = [first.where("__task is null")], first.where("__task is not null"), 1
    while True:
        most = left.agg(F.max("__task")).first()[0]
        if most is None:
            break
        single = most < fan
        left = stage(_merged(left, out, columns, capacity, windows, turn, fan, single, keep_ids))
        done.append(left.where("__task is null"))
        if single:
            break
        left, turn = left.where("__task is not null"), turn + 1
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return packed.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], *PIECE.fieldNames())


def _merged(left: DataFrame, out: StructType, columns: list[str], capacity: int, windows: int, turn: int, fan: int, single: bool, keep_ids: bool) -> DataFrame:
    """One round: the open windows of ``fan`` tasks or groups, at most ``windows`` of each, are packed again by one task."""

    def merge(group: pa.Table) -> pa.Table:
        task = group["__task"][0].as_py() // fan
        group = group.sort_by([("__task", "ascending"), ("__window", "ascending"), ("offset", "ascending")])
        state = Windows(capacity, windows, (turn << _ROUND) | (task << _TASK))
        for row, (start, ids, total) in enumerate(zip(*(group[c].to_pylist() for c in ("start", "ids", "doc_tokens")))):
            state.put(row, start, ids, total)
        if single:
            state.finish()
        parts = [_rows(group, columns, state.take(), keep_ids)]
        if state.open:
            parts.append(_rows(group, columns, _still_open(state), keep_ids, task))
        return pa.Table.from_batches(parts)

    return left.groupBy(F.floor(F.col("__task") / fan).alias("__group")).applyInArrow(merge, out)
