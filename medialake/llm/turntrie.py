"""Prefix trie of conversations in double arrays.

Conversations are reduced to sequences of turn digests, equal sequences are counted
together, and a range partitioning puts them in lexicographic order, so a partition
holds whole subtrees but for the prefixes of its first and its last sequence. Every
shard of a partition numbers its turns densely, packs its trie into BASE and CHECK
arrays (the child of slot ``s`` by turn ``t`` is ``BASE[s] + t``, and ``CHECK`` there
says ``s``), and walks all sequences through them at once to sum up its nodes.

Nodes that only one shard can hold are finished there. The others, at most two paths
a shard, are merged over neighbouring tasks, ``FAN`` at a time, until one group is
left; whatever comes to lie inside a group is finished with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from medialake.llm.mixing import n_words
from medialake.operators.ordered import stage

FAN = 64
SHARD_TURNS = 1 << 18
SPAN = 4096  # conversation ids that one part of a list of ids covers

NODE = StructType(
    [StructField(c, LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [StructField("ends_sha256", StringType())])
_PART = StructType(NODE.fields + [StructField("__words", LongType()), StructField("__key", BinaryType()), StructField("__up", BinaryType()),
                                  StructField("__left", BooleanType()), StructField("__right", BooleanType()), StructField("__task", IntegerType()), StructField("__shard", LongType())])
_NOBODY = hashlib.sha256(b"").hexdigest()
_ROOT = b""


def digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; null is the empty text."""
    role = F.coalesce(role, F.lit(""))
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.coalesce(text, F.lit("")))))


def sequences(turns: DataFrame, family: int = 20) -> DataFrame:
    """``head, conv_id, turns`` from ``conv_id, turn, role, text``: its turns in order as (digest, words). Rows without an id are left out.

    Turns go by number, null first; equal numbers go by digest. ``head`` is the id less
    its remainder by ``family``; the conversations of a family lie in one partition.
    """
    named = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest(F.col("role"), F.col("text")).alias("d"), n_words(F.col("text")).alias("w"))
    named = named.withColumn("head", F.col("conv_id") - F.col("conv_id") % family).repartition("head")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "d", "w")))
    return named.groupBy("head", "conv_id").agg(ordered.alias("t")).select("head", "conv_id", F.transform("t", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("turns"))


def shared_openings(convs: DataFrame, most: int = 3) -> DataFrame:
    """Every conversation of :func:`sequences` with its first h turns taken from the head of its family, h = crc32(id) mod ``most + 1``.

    A head that is not there has no turns.
    """
    opening = F.max(F.when(F.col("conv_id") == F.col("head"), F.slice("turns", 1, most))).over(Window.partitionBy("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    none = F.expr("cast(array() as array<struct<d: binary, w: bigint>>)")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return convs.withColumn("opening", opening).select("conv_id", F.concat(F.slice(F.coalesce("opening", none), F.lit(1), h), own).alias("turns"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``turns, n_convs, conv_id, ends_sha256``: each distinct sequence with its number of conversations, the smallest id and the hash of all ids.

    Ids are first joined in parts that cover ``SPAN`` ids; the parts of a sequence are
    then read in order by one task, which keeps no more than the hash.
    """
    keyed = convs.select(F.md5(F.concat_ws("", F.transform("turns", lambda x: F.hex(x["d"])))).alias("key"), F.shiftright("conv_id", SPAN.bit_length() - 1).alias("part"), "conv_id", "turns")
    ids = F.sort_array(F.collect_list("conv_id"))
    parts = keyed.groupBy("key", "part").agg(ids.alias("ids"), F.first("turns").alias("turns"))
    parts = parts.select("key", "part", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"), "turns")
    parts = parts.repartition("key").sortWithinPartitions("key", "part")
    turns = convs.schema["turns"].dataType
    out = StructType([StructField("turns", turns), StructField("n_convs", LongType()), StructField("conv_id", LongType()), StructField("ends_sha256", StringType())])

    def run(batches):
        now = None  # key, hash, count, least, turns
        for b in batches:
            rows = []
            key, n, least, text = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "least", "text"))
            sequence = b.column(b.schema.get_field_index("turns"))
            for i in range(b.num_rows):
                if now is not None and now[0] == key[i]:
                    now[1].update(b"," + text[i].encode())
                    now[2] += n[i]
                else:
                    rows += [now] if now is not None else []
                    now = [key[i], hashlib.sha256(text[i].encode()), n[i], least[i], sequence.slice(i, 1)]
            if now is not None:
                now[4] = pa.concat_arrays([now[4]])
            if rows:
                yield pack(rows)
        if now is not None:
            yield pack([now])

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.concat_arrays([r[4] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                                           pa.array([r[1].hexdigest() for r in rows])], names=out.fieldNames())

    return parts.mapInArrow(run, out)


class DoubleArray:
    """BASE and CHECK arrays of a trie over dense codes, built from sorted distinct sequences.

    ``codes`` holds the sequences one after another, sequence ``i`` from ``first[i]``
    on with ``size[i]`` codes. Slot 0 is the root.
    """

    TRIES = 16

    def __init__(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -2, np.int64)
        self.check[0] = -1
        self.top, self.free = 1, np.zeros(0, np.int64)  # slots from ``top`` on are untouched; free ones below it
        at = np.zeros(len(size), np.int64)
        for d in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > d)
            parent, code = at[on], codes[first[on] + d]
            new = np.ones(len(on), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])
            heads = np.flatnonzero(new)
            self._children(parent[heads], code[heads])
            at[on] = self.base[parent] + code

    def _grow(self, top: int) -> None:
        while top > len(self.check):
            self.base = np.concatenate((self.base, np.zeros(len(self.base), np.int64)))
            self.check = np.concatenate((self.check, np.full(len(self.check), -2, np.int64)))

    def _children(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Slots for the children of a level; those of one parent are neighbours."""
        cut = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        many = np.diff(np.concatenate((cut, [len(parent)])))
        for k in np.flatnonzero(many > 1).tolist():
            own = np.sort(code[cut[k] : cut[k] + many[k]])
            s = parent[cut[k]]
            self.base[s] = base = self._place(own)
            self.check[base + own] = s
        single = cut[many == 1]
        if len(single):
            self.free = self.free[self.check[self.free] == -2]
            slots = self.free[: len(single)]
            self.free = self.free[len(slots) :]
            if len(slots) < len(single):
                fresh = np.arange(self.top, self.top + len(single) - len(slots))
                self._grow(self.top + len(fresh))
                self.top += len(fresh)
                slots = np.concatenate((slots, fresh))
            self.base[parent[single]] = slots - code[single]
            self.check[slots] = parent[single]

    def _place(self, own: np.ndarray) -> int:
        """A base whose slots for these codes are all free: at one of the first free slots, else past all that are used."""
        for f in self.free[: self.TRIES].tolist():
            at = f - own[0] + own
            if at[-1] < self.top and (self.check[at] == -2).all():
                return int(f - own[0])
        base = self.top - int(own[0])
        self._grow(base + int(own[-1]) + 1)
        self.free = np.concatenate((self.free[self.check[self.free] == -2], np.setdiff1d(np.arange(self.top, base + int(own[-1]) + 1), base + own, True)))
        self.top = base + int(own[-1]) + 1
        return base

    def walk(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray):
        """For every depth from 0: the sequences that reach it, and their slots there."""
        at = np.zeros(len(size), np.int64)
        yield np.arange(len(size)), at.copy()
        for d in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > d)
            to = self.base[at[on]] + codes[first[on] + d]
            if not (self.check[to] == at[on]).all():
                raise AssertionError("a sequence left the trie")
            at[on] = to
            yield on, to.copy()


def dense(digests: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes from 0 by first appearance, so that turns which come together have near codes."""
    _, first, code = np.unique(digests, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[code.ravel()], len(first)


def _chain(up: bytes, turn: bytes) -> bytes:
    return hashlib.md5(up + turn).digest()


def shard_nodes(digests: np.ndarray, words: np.ndarray, first: np.ndarray, size: np.ndarray, count: np.ndarray, least: np.ndarray, ends: list[str], task: int, shard: int) -> pa.RecordBatch:
    """The nodes of a shard's sequences: finished rows, and parts of the nodes on the paths of the first and the last sequence."""
    code, _ = dense(digests)
    trie = DoubleArray(code, first, size)
    n = trie.top
    convs, low, depth, weight = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    end_of, left, right = np.full(n, -1, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    levels = []
    final = len(size) - 1
    keys: dict[int, tuple[bytes, bytes | None]] = {0: (_ROOT, None)}
    for d, (on, at) in enumerate(trie.walk(code, first, size)):
        np.add.at(convs, at, count[on])
        np.minimum.at(low, at, least[on])
        depth[at] = d
        if d:
            weight[at] = words[first[on] + d - 1]
        over = size[on] == d
        end_of[at[over]] = on[over]
        for flag, i in ((left, 0), (right, final)):
            k = np.searchsorted(on, i)
            if k < len(on) and on[k] == i:
                flag[at[k]] = True
                if d:
                    up = keys[int(trie.check[at[k]])][0]
                    keys[int(at[k])] = (_chain(up, digests[first[i] + d - 1].tobytes()), up)
        levels.append(np.unique(at))
    shared = left | right
    parent = np.maximum(trie.check[:n], 0)
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in reversed(levels[1:]):
        done = at[~shared[at]]
        leaves[done] = np.where(children[done] == 0, 1, leaves[done])
        saved[done] += (convs[done] - 1) * weight[done]
        np.add.at(children, parent[done], 1)
        np.add.at(leaves, parent[done], leaves[done])
        np.add.at(saved, parent[done], saved[done])
    slots = np.concatenate(levels)
    own = shared[slots]
    up = parent[slots]
    shared_up = shared[up] & ~own
    pick = end_of[slots]
    where = slots.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(low[slots]), pa.array(depth[slots]), pa.array(low[up], mask=own | shared_up), pa.array(convs[slots]), pa.array(children[slots]), pa.array(leaves[slots]), pa.array(saved[slots]),
         pa.array([ends[i] if i >= 0 else _NOBODY for i in pick.tolist()]), pa.array(weight[slots]), pa.array([keys[s][0] if o else None for s, o in zip(where, own.tolist())], pa.binary()),
         pa.array([keys[s][1] if o else keys[u][0] if x else None for s, o, u, x in zip(where, own.tolist(), up.tolist(), shared_up.tolist())], pa.binary()),
         pa.array(left[slots], mask=~own), pa.array(right[slots], mask=~own), pa.array(np.full(len(slots), task, np.int32)), pa.array(np.full(len(slots), shard))],
        names=_PART.fieldNames())


def _shards(sequences_: DataFrame, most: int) -> DataFrame:
    """The parts of :func:`shard_nodes` of all shards; a shard is a run of ordered sequences with ``most`` turns or one sequence."""

    def run(batches):
        from pyspark import TaskContext

        task, shard, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def build(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            lists = t["turns"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            raw = flat.field("d").to_pylist()
            digests = np.frombuffer(b"".join(raw), "V16") if raw else np.zeros(0, "V16")
            words = flat.field("w").to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            return shard_nodes(digests, words, first, size, *(t[c].to_numpy() for c in ("n_convs", "conv_id")), t["ends_sha256"].to_pylist(), task, shard)

        for b in batches:
            lo = 0
            ends = np.cumsum(pc.list_value_length(b.column(b.schema.get_field_index("turns"))).to_numpy(zero_copy_only=False))
            while lo < b.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + most - turns, "right")))
                held.append(b.slice(lo, hi - lo))
                turns += int(ends[min(hi, b.num_rows) - 1] - before)
                if hi < b.num_rows or turns >= most:
                    yield build(held)
                    shard, held, turns = shard + 1, [], 0
                lo = hi
        if held:
            yield build(held)

    by = F.transform("turns", lambda x: x["d"]).alias("by")
    ordered = sequences_.select("*", by).repartitionByRange("by").sortWithinPartitions("by").drop("by")
    return ordered.mapInArrow(run, _PART)


def _join_paths(group: pa.Table, task: int, single: bool) -> pa.Table:
    """Merges the shared nodes of neighbouring shards; those that no shard outside the group can hold are finished, in a ``single`` group all."""
    shards = sorted({(t, s) for t, s in zip(group["__task"].to_pylist(), group["__shard"].to_pylist())})
    nodes: dict[bytes, dict] = {}
    for r in group.to_pylist():
        leftmost = bool(r["__left"]) and (r["__task"], r["__shard"]) == shards[0]
        rightmost = bool(r["__right"]) and (r["__task"], r["__shard"]) == shards[-1]
        n = nodes.get(r["__key"])
        if n is None:
            nodes[r["__key"]] = r | {"__left": leftmost, "__right": rightmost}
            continue
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            n[c] += r[c]
        n["conv_id"] = min(n["conv_id"], r["conv_id"])
        n["ends_sha256"] = r["ends_sha256"] if n["ends_sha256"] == _NOBODY else n["ends_sha256"]
        n["__left"] |= leftmost
        n["__right"] |= rightmost
    for n in sorted(nodes.values(), key=lambda r: -r["depth"]):
        n["__task"], n["__shard"] = task, 0
        if not single and (n["__left"] or n["__right"]):
            continue
        n["__left"] = n["__right"] = None
        n["n_leaves"] = n["n_leaves"] if n["n_children"] else 1
        n["saved_tokens"] += (n["n_convs"] - 1) * n["__words"]
        if n["__up"] is not None:
            up = nodes[n["__up"]]
            up["n_children"] += 1
            up["n_leaves"] += n["n_leaves"]
            up["saved_tokens"] += n["saved_tokens"]
    return pa.Table.from_pylist(list(nodes.values()), schema=group.schema)


def _merged(left: DataFrame, fan: int, single: bool) -> DataFrame:
    def merge(group: pa.Table) -> pa.Table:
        return _join_paths(group, group["__task"][0].as_py() // fan, single)

    return left.groupBy(F.floor(F.col("__task") / fan).alias("__group")).applyInArrow(merge, _PART)


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """The prefix trie of ``conv_id, turns``: a row a node, as in :data:`NODE`.

    ``conv_id`` is the smallest conversation that starts with the node's turns,
    ``saved_tokens`` sums (conversations - 1) * words of the last turn over the
    node's subtree, ``ends_sha256`` hashes the comma-joined ids of the conversations
    that end there. A conversation without turns belongs to the root alone; without
    conversations there is no root. One conversation's digests are held in one task.
    """
    parts = stage(_shards(distinct_sequences(convs), shard_turns))
    shared = parts.where("__left is not null")
    finished, left = [], shared
    while True:
        most = left.agg(F.max("__task")).first()[0]
        if most is None:
            break
        single = most < fan

        merged = stage(_merged(left, fan, single))
        finished.append(merged.where("__left is null"))
        left = merged.where("__left is not null")
        if single:
            break
    rows = parts.where("__left is null")
    if not finished:
        return rows.select(*NODE.fieldNames())
    upper = finished[0]
    for f in finished[1:]:
        upper = upper.unionByName(f)
    names = upper.select(F.col("__key").alias("__up"), F.col("conv_id").alias("__parent"))
    # few nodes are shared: Spark broadcasts their names while small, and splits the root's children beyond that
    lower = rows.where("__up is not null").unionByName(upper).join(names, "__up", "left").withColumn("parent_conv_id", F.col("__parent"))
    return rows.where("__up is null").select(*NODE.fieldNames()).unionByName(lower.select(*NODE.fieldNames()))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of whole conversations as they are, from ``conv_id, turn, role, text``; null roles and texts are empty, other columns are ignored."""
    return trie(sequences(turns))
