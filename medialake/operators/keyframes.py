"""Key-frame flags of elementary video samples, from a scan of their bytes as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from medialake.operators.order import VIDEO_STREAM_TYPES

HEVC = 0x24
KEYFRAME_ROWS = 1024


def key_frames(data: np.ndarray, offsets: np.ndarray, hevc: np.ndarray) -> np.ndarray:
    """Which of the byte ranges ``data[offsets[i]:offsets[i + 1]]`` hold a unit that starts decoding: an IDR slice, in HEVC an IRAP picture.

    A unit follows a start code of three or four bytes; one byte of a unit after a
    code of three at the very end is not looked at, as in the original.
    """
    n = len(data)
    if n < 5:
        return np.zeros(len(offsets) - 1, bool)
    zero = data == 0
    code = np.flatnonzero(zero[:-2] & zero[1:-1] & (data[2:] == 1))  # of three bytes; a fourth zero may lie in front
    owner = np.searchsorted(offsets, code, "right") - 1
    unit, end = code + 3, offsets[owner + 1]
    long = (code > offsets[owner]) & zero[np.maximum(code - 1, 0)]
    there = np.where(long, unit < end, unit + 1 < end)
    unit, owner = unit[there], owner[there]
    head = data[unit]
    kind = head >> 1 & 0x3F
    starts = np.where(hevc[owner], (kind >= 16) & (kind <= 23), (head & 0x1F) == 5)
    return np.bincount(owner[starts], minlength=len(offsets) - 1) > 0


def with_keyframes(samples: DataFrame, types: DataFrame | None = None, on: list[str] | None = None, payload: str = "payload") -> DataFrame:
    """Samples with ``is_video`` and ``keyframe``, from their ``stream_type`` and bytes.

    ``types`` (``on``, stream_type) brings the stream types of the program table; samples
    of unknown type are no video. A video sample is a key frame if it holds an IDR slice,
    or in HEVC an IRAP picture. Works on batches and streams alike: bytes are scanned as
    columns, a bounded number of rows at a time.
    """
    d = samples if types is None else samples.join(types.select(*(on or ["feed_id", "pid"]), "stream_type"), on or ["feed_id", "pid"], "left")
    d = d.withColumn("is_video", F.coalesce(F.col("stream_type").isin(*VIDEO_STREAM_TYPES), F.lit(False)))
    out = StructType([*d.schema.fields, StructField("keyframe", BooleanType())])
    where, kind, video = (d.columns.index(c) for c in (payload, "stream_type", "is_video"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, KEYFRAME_ROWS):
                part = batch.slice(lo, KEYFRAME_ROWS)
                bodies = part.column(where).to_pylist()
                bodies = [b or b"" for b in bodies]
                offsets = np.cumsum([0, *map(len, bodies)])
                found = key_frames(np.frombuffer(b"".join(bodies), np.uint8), offsets, part.column(kind).fill_null(0).to_numpy(zero_copy_only=False) == HEVC)
                found &= part.column(video).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], schema=pa.schema([*part.schema, pa.field("keyframe", pa.bool_())]))

    return d.mapInArrow(run, out)
