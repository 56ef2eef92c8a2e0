"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The circle is cut into ``cells``. Every shard has ``vnodes`` virtual nodes, each
in a cell; a row lies in the cell of its key's hash and belongs to the first
virtual node clockwise. No shard takes more than its bound of rows: the rows a
full shard cannot take go on to the next shard clockwise that has room.

Placement works on whole cells: one aggregated pass counts rows per cell, the
overflow is settled over these counts (``cells`` numbers, whatever the input
size), and each cell gets a short list of (rank from, rank to, shard, first slot).
Rows then find their shard and slot by their rank within the cell. One shuffle of
rows, keyed by cell; a cell holds rows / cells of the rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.texts import without

CELLS = 4096


def ring(shards: int, vnodes: int = 64, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise. A further shard adds nodes and moves none."""
    nodes = []
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big")
            nodes.append((h % cells, h, s))
    return [(c, s) for c, _, s in sorted(nodes)]


def walk(nodes: list[tuple[int, int]], shards: int, cells: int) -> list[list[int]]:
    """For each cell all shards in the order in which a row of that cell meets them clockwise."""
    orders, start = [], 0
    for c in range(cells):
        while start < len(nodes) and nodes[start][0] < c:
            start += 1
        seen = dict.fromkeys(nodes[(start + k) % len(nodes)][1] for k in range(len(nodes)))
        orders.append(list(seen))
    return orders


def settle(counts: dict[int, int], shards: int, vnodes: int, cells: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, rank from, rank to, shard, first slot): every shard's bound holds and every row has a place.

    With no slack the bounds are n / shards rounded up for the first n mod shards
    shards and down for the others. Rows meet their first shard, then those left
    over meet their second, and so on; a shard takes cells in clockwise order.
    """
    n = sum(counts.values())
    room = [int((1 + slack) * n / shards) + 1 if slack else n // shards + (s < n % shards) for s in range(shards)]
    orders = walk(ring(shards, vnodes, cells), shards, cells)
    left, placed, used, out = dict(sorted(counts.items())), dict.fromkeys(counts, 0), [0] * shards, []
    for hop in range(shards):
        for c in [c for c, k in left.items() if k]:
            s = orders[c][hop]
            take = min(left[c], room[s])
            if take:
                out.append((c, placed[c], placed[c] + take, s, used[s]))
                placed[c], left[c], room[s], used[s] = placed[c] + take, left[c] - take, room[s] - take, used[s] + take
    return out


def cell_of(key: Column, spare: Column, cells: int = CELLS) -> Column:
    """Cell of the key's hash; rows without a key are spread by ``spare``."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("?"), F.coalesce(spare.cast("string"), F.lit(""))))), F.lit(cells)).cast("int")


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, cells: int = CELLS, slack: float = 0.0, key: str = "doc_id", spare: str = "doc_id") -> DataFrame:
    """Every row with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    With ``slack`` 0 the shards' row counts differ by one at most. Rows are ranked
    in their cell by key hash, key and ``spare``; equal rows are interchangeable.
    Rows without a key are placed by ``spare``. An empty table gives an empty one.
    Input columns called ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    rows = without(docs, ["shard", "slot"]).withColumn("__cell", cell_of(F.col(key), F.col(spare), cells))
    counts = {r[0]: r[1] for r in rows.groupBy("__cell").count().collect()}  # at most ``cells`` rows
    runs = json.dumps([list(r) for r in settle(counts, shards, vnodes, cells, slack)])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(runs), "array<array<bigint>>")).alias("r")).select(
        F.col("r")[0].cast("int").alias("__c"), F.col("r")[1].alias("__from"), F.col("r")[2].alias("__to"), F.col("r")[3].cast("int").alias("shard"), F.col("r")[4].alias("__slot"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy(F.xxhash64(key), key, spare)).cast("long") - 1)
    inside = (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    placed = ranked.join(F.broadcast(table), inside)  # at most cells x shards rows, mostly one a cell
    return placed.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__from")).drop("__cell", "__c", "__from", "__to", "__slot", "__rank")
