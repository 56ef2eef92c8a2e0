"""Transport-stream files as packet tables, split into ranges so one big file is read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.binary import be_uint, slice_bytes
from medialake.functions.timing import idiv
from medialake.sources.mp4 import _Bytes, list_files

TS_PACKET, M2TS_PACKET, SYNC = 188, 192, 0x47
PACKETS_PER_TASK_ROW = 1 << 16
PACKETS_PER_BATCH = 1 << 13
PACKET_SCHEMA = (
    "path string, packet_index bigint, sync_ok boolean, pid int, pusi boolean, afc int, continuity int, payload binary"
)


def detect_packet_size(head: bytes, length: int) -> int | None:
    """192-byte framing before 188; the first two packets must carry the sync byte."""
    for size, sync in ((M2TS_PACKET, M2TS_PACKET - TS_PACKET), (TS_PACKET, 0)):
        if length % size == 0 and len(head) >= size and head[sync] == SYNC and (len(head) < 2 * size or head[size + sync] == SYNC):
            return size
    return None


def packet_columns(raw: np.ndarray) -> dict[str, list]:
    """Header fields and payloads of an (n, 188) byte array."""
    afc = (raw[:, 3] >> 4) & 3
    start = np.where(afc == 3, 5 + raw[:, 4].astype(np.int64), 4)
    usable = ((afc == 1) | (afc == 3)) & (start < TS_PACKET)
    return {
        "sync_ok": raw[:, 0] == SYNC,
        "pid": ((raw[:, 1].astype(np.int32) & 0x1F) << 8) | raw[:, 2],
        "pusi": (raw[:, 1] & 0x40) != 0,
        "afc": afc.astype(np.int32),
        "continuity": (raw[:, 3] & 0x0F).astype(np.int32),
        "payload": [raw[i, start[i]:].tobytes() if usable[i] else None for i in range(len(raw))],
    }


def resync_packets(buffer: bytes) -> tuple[list[bytes], bytes]:
    """188-byte packets of a byte run, skipping to the next sync byte where framing is lost; and the unread tail."""
    out, at = [], 0
    while len(buffer) - at >= TS_PACKET:
        if buffer[at] != SYNC:
            nxt = buffer.find(SYNC, at + 1)
            if nxt < 0:
                return out, b""
            at = nxt
            continue
        out.append(buffer[at:at + TS_PACKET])
        at += TS_PACKET
    return out, buffer[at:]


def _frame(path: str, first: int, packets: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "packet_index": np.arange(first, first + len(packets), dtype=np.int64), **packet_columns(packets)})


def _probe(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for path, length in zip(pdf["path"], pdf["length"]):
                src = _Bytes(path)
                sizes.append(detect_packet_size(src.read(0, min(2 * M2TS_PACKET, src.size)), length))
                src.close()
            yield pdf.assign(packet_size=pd.array(sizes, dtype="Int64"))

    return files.mapInPandas(run, "path string, length bigint, packet_size bigint")


def _read_ranges(ranges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                src = _Bytes(row.path)
                last = min(row.first_packet + PACKETS_PER_TASK_ROW, row.length // row.packet_size)
                for first in range(row.first_packet, last, PACKETS_PER_BATCH):
                    n = min(PACKETS_PER_BATCH, last - first)
                    raw = np.frombuffer(src.read(first * row.packet_size, n * row.packet_size), dtype=np.uint8)
                    yield _frame(row.path, first, raw.reshape(n, row.packet_size)[:, row.packet_size - TS_PACKET:])
                src.close()

    return ranges.mapInPandas(run, PACKET_SCHEMA)


def _read_resync(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length in zip(pdf["path"], pdf["length"]):
                src, tail, index = _Bytes(path), b"", 0
                for at in range(0, length, 1 << 20):
                    packets, tail = resync_packets(tail + src.read(at, min(1 << 20, length - at)))
                    if packets:
                        yield _frame(path, index, np.frombuffer(b"".join(packets), dtype=np.uint8).reshape(-1, TS_PACKET))
                        index += len(packets)
                src.close()

    return files.mapInPandas(run, PACKET_SCHEMA)


def scan_ts_packets(spark: SparkSession, path: str, glob: str | None = None, resync: bool = False) -> tuple[DataFrame, DataFrame]:
    """(packets, rejects) of transport-stream files.

    A file whose size or sync bytes do not fit either framing is rejected whole;
    ``resync=True`` reads 188-byte framing and skips to the next sync byte instead.
    """
    files = list_files(spark, path, glob)
    tasks = spark.sparkContext.defaultParallelism * 4
    if resync:
        packets = _read_resync(files.repartition(tasks, "path"))
        return packets.drop("sync_ok"), files.limit(0).select("path", F.lit("").alias("reason"))
    probed = _probe(files.repartition(tasks, "path"))
    ranges = probed.where("packet_size IS NOT NULL").withColumn(
        "first_packet", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(idiv("length", F.col("packet_size")) - 1, F.lit(0)),
                                             F.lit(PACKETS_PER_TASK_ROW).cast("bigint"))))
    packets = _read_ranges(ranges.repartition(tasks, "path", "first_packet"))
    lost = packets.where("NOT sync_ok").select("path").distinct().withColumn("reason", F.lit("packet without sync byte"))
    misfit = probed.where("packet_size IS NULL").select("path", F.lit("partial or invalid packet alignment").alias("reason"))
    rejects = misfit.unionByName(lost)
    return packets.join(lost, ["path"], "left_anti").drop("sync_ok"), rejects


def explode_psi(packets: DataFrame, file: str = "path") -> tuple[DataFrame, DataFrame]:
    """(PAT rows, PMT rows) of the table packets, all in Catalyst expressions.

    A table must start and end in its packet; malformed ones drop out. PMT rows
    need ``pid`` to pick the program's table later.
    """
    p = packets.where("pusi AND payload IS NOT NULL").withColumn("__sec", 1 + be_uint("payload", 0, 1))
    p = p.withColumns({"table_id": be_uint("payload", F.col("__sec"), 1),
                       "__len": be_uint("payload", F.col("__sec") + 1, 2).bitwiseAND(F.lit(0x0FFF).cast("bigint"))})
    p = p.where((F.col("__sec") + 3 + F.col("__len") <= F.length("payload")) & (F.col("__len") >= 9))
    p = p.withColumn("__s", slice_bytes("payload", F.col("__sec"), 3 + F.col("__len") - 4))
    pat = p.where("table_id = 0 AND pid = 0")
    entries = idiv(F.length("__s") - 8, 4)
    pat = pat.where(entries > 0).select(file, "packet_index", "pid", "__s", F.explode(F.sequence(F.lit(0), (entries - 1).cast("int"))).alias("position"))
    low13 = F.lit(0x1FFF).cast("bigint")
    pat = pat.select(file, "packet_index", "position", be_uint("__s", 8 + F.col("position") * 4, 2).alias("program"),
                     be_uint("__s", 10 + F.col("position") * 4, 2).bitwiseAND(low13).alias("pmt_pid"))
    pmt = p.where("table_id = 2 AND __len >= 13")
    info = be_uint("__s", 10, 2).bitwiseAND(F.lit(0x0FFF).cast("bigint"))
    # Entries have variable length: walk them over the (bounded) section, keeping each entry's offset.
    size = F.length("__s").cast("bigint")

    def advance(acc, _i):
        at = acc["at"]
        fits = at + 5 <= size
        nxt = at + 5 + F.coalesce(be_uint("__s", at + 3, 2).bitwiseAND(F.lit(0x0FFF).cast("bigint")), F.lit(0).cast("bigint"))
        return F.struct(F.when(fits, nxt).otherwise(at).alias("at"), F.when(fits, F.concat(acc["found"], F.array(at))).otherwise(acc["found"]).alias("found"))

    seed = F.struct((12 + info).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))
    found = F.aggregate(F.sequence(F.lit(0), idiv(size, 5).cast("int")), seed, advance, lambda a: a["found"])
    pmt = pmt.select(file, "packet_index", "pid", be_uint("__s", 3, 2).alias("program"), be_uint("__s", 8, 2).bitwiseAND(low13).alias("pcr_pid"),
                     "__s", F.posexplode(found).alias("position", "__at"))
    pmt = pmt.select(file, "packet_index", F.col("pid").alias("pmt_pid"), "program", "pcr_pid", "position",
                     be_uint("__s", F.col("__at"), 1).alias("stream_type"),
                     be_uint("__s", F.col("__at") + 1, 2).bitwiseAND(low13).alias("elementary_pid"))
    return pat, pmt
