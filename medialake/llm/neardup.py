"""Near-duplicate documents by MinHash bands and odd sketches.

One pass over the texts gives for each document the size and a digest of its set
of word shingles, the keys of its MinHash bands, and an odd sketch: every
MinHash sample toggles one bit of a bitmap, so the population count of two
bitmaps' XOR estimates how many samples differ, most precisely for high
similarities. Documents with equal sets are one class from then on.

Classes that share a band are compared with one member of that band, not with
each other: the sketches sort out most pairs, the full sets decide the others.
Bands whose members are still in different components are compared with several
other members, and what is then left meets in blocks that carry the full sets, so that a
task gives the links which join components and no row for a pair it has tested. No link
between components is lost but by the hashes (at the threshold itself, rates in the
README), and a large group of near copies costs its size, not its square, in rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from medialake.llm.tables import components, hinted, if_small, tight
from medialake.llm.texts import Texts, add_columns, hand_back, mix, shingles, slices
from medialake.operators.ordered import stage

BANDS, ROWS = 32, 6
SAMPLES, BITS = 1024, 2048
MARGIN = 0.07
BLOCK, BLOCK_BYTES = 2048, 1 << 23
RUN = 128  # texts whose samples are worked on at once
TILE = 64, 512  # members whose sketches and bands are compared at once
CENTRES = (1, 8)  # members of a band that the others are compared with, turn by turn

_K = SAMPLES
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, _K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, _K, dtype=np.uint32)
_SALT = np.random.default_rng(6).integers(0, 1 << 63, _K, dtype=np.uint64)
_DOC = np.uint64(0xD1342543DE82EF95)


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text), distinct and ordered by text: the word shingles of lower-cased texts; fewer words are one shingle."""
    t = t.lowered()
    start, end, owner = t.words()
    h = t.hashes(start, end)
    run, text = shingles(h, owner, size)
    words = np.bincount(owner, minlength=len(t))
    for k in range(1, size):
        few = np.flatnonzero(words == k)
        if len(few):
            first = np.searchsorted(owner, few)
            x = h[first]
            for j in range(1, k):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[first + j])
            run, text = np.concatenate((run, x)), np.concatenate((text, few))
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return run[new], text[new]


def signatures(t: Texts, size: int):
    """Per text: set size, two digests of the set, band keys (text, band) and sketch (text, words of 64 bits)."""
    n = len(t)
    h, text = shingle_sets(t, size)
    count = np.bincount(text, minlength=n)
    keys, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, BITS // 64), np.int64)
    digests = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return count, digests.view(np.int64), keys, sketch
    at = np.searchsorted(text, full)
    for k, salt in enumerate((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))):
        digests[k, full] = np.add.reduceat(mix(h ^ salt), at)
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((_K, len(full)), np.uint32)
    for k in range(_K):  # one permutation of the 32-bit hashes at a time keeps the work in cache
        np.minimum.reduceat(x * _A[k] + _B[k], at, out=least[k])
    for lo in range(0, len(full), RUN):  # samples take 8 KB a text, so short texts go by runs
        some = full[lo : lo + RUN]
        sample = mix(least[:, lo : lo + RUN].astype(np.uint64) ^ _SALT[:, None])
        band = np.zeros((BANDS, len(some)), np.uint64)
        for r in range(ROWS):
            band = mix(band * _DOC + sample[r : BANDS * ROWS : ROWS])
        keys[some] = np.ascontiguousarray(band.T).view(np.int64)
        bit = (sample >> np.uint64(20)).astype(np.int64) % BITS + np.arange(len(some)) * BITS
        odd = (np.bincount(bit.ravel(), minlength=len(some) * BITS) & 1).astype(np.uint8)
        sketch[some] = np.packbits(odd.reshape(len(some), BITS), axis=1).view(np.int64)
    return count, digests.view(np.int64), keys, sketch


_SIG = StructType([StructField(c, LongType()) for c in ("n_shingles", "__k1", "__k2")] + [StructField("__bands", ArrayType(LongType())), StructField("__sketch", ArrayType(LongType()))])


def _sign(docs: DataFrame, size: int) -> DataFrame:
    def start():
        def step(batch):
            out = [signatures(t, size) for t in slices(batch.column(batch.schema.get_field_index("text")))]
            n = np.concatenate([o[0] for o in out])
            d = np.concatenate([o[1] for o in out], 1)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([o[k] for o in out]).ravel()), w).cast(pa.list_(pa.int64())) for k, w in ((2, BANDS), (3, BITS // 64))]
            return [pa.array(n.astype(np.int64)), pa.array(d[0]), pa.array(d[1]), *lists]

        return step

    return add_columns(docs, _SIG, start).drop("text")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``node, set`` of the documents: the distinct shingle hashes."""

    def start():
        def step(batch):
            out = []
            for t in slices(batch.column(batch.schema.get_field_index("text"))):
                h, text = shingle_sets(t, size)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(t)))))
                out.append(pa.LargeListArray.from_arrays(ends, pa.array(h.view(np.int64))))
            return [pa.chunked_array(out).combine_chunks().cast(pa.list_(pa.int64()))]

        return step

    return add_columns(docs, StructType([StructField("set", ArrayType(LongType()))]), start).select(F.col("doc_id").alias("node"), "set")


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64)])


def most_differing(percent: int) -> int:
    """Bits that may differ for a pair of the wanted similarity; with ideal hashes, fewer than 1 in 100,000 pairs exactly at 80 % or more differ in more bits."""
    return math.floor(BITS / 2 * (1 - math.exp(4 * _K / BITS * (percent / 100 - MARGIN - 1))))


def _alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and sketches allow the similarity."""
    for s in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("__sketch").alias(f"s{s}")), s)
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing(F.col("sa"), F.col("sb")) <= most_differing(percent))
    return pairs.where(fits).select("a", "b").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    nodes = if_small(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = sets.join(nodes, "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("setb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("seta")), "a")
    common = F.size(F.array_intersect("seta", "setb"))
    return both.where(100 * common >= percent * (F.size("seta") + F.size("setb") - common)).select("a", "b").distinct()


def _star(members: DataFrame, centres: int) -> DataFrame:
    """``a, b``: in every band the members outside the component with the smallest label, each with some members inside it."""
    chosen = [F.min(F.struct(F.col("label"), F.xxhash64("node", F.lit(k)).alias("rank"), F.col("node"))).alias(f"c{k}") for k in range(centres)]
    centre = members.groupBy("key").agg(*chosen).select("key", F.col("c0.label").alias("other"), F.explode(F.array_distinct(F.array(*[F.col(f"c{k}.node") for k in range(centres)]))).alias("centre"))
    met = members.join(if_small(centre), "key").where("label <> other")
    return met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _open(members: DataFrame, reached: DataFrame) -> DataFrame:
    """The members with their labels, in bands that still hold several components and more pairs than the one that was compared first."""
    named = tight(members.select("key", "band", "node").join(hinted(reached), "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label")))
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi and m > 2")
    return tight(named.join(if_small(mixed.select("key")), "key"))


class _Groups:
    """Links between the components of a band's members, found within tasks: a union-find over the labels that a group of members has."""

    def __init__(self, label: np.ndarray):
        self.of = np.unique(label, return_inverse=True)[1].tolist()
        self.up = list(range(max(self.of, default=-1) + 1))

    def root(self, i: int) -> int:
        k = self.of[i]
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.of))])

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def links_within(group: pa.Table, percent: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``a, b`` of links that join all components of the group which its members' full sets link; at most one less than there are.

    Sketches sort out pairs, most alike first; a pair whose components have been
    joined is not looked at again. Of the bands that a pair shares the first one
    (``own`` is the band of the group) looks at it.
    """
    node, label, n = (group[c].to_numpy() for c in ("node", "label", "n_shingles"))
    sketch = np.stack(group["__sketch"].to_numpy()).astype(np.int64).view(np.uint64)
    bands, sets = np.stack(group["__bands"].to_numpy()), group["set"].to_numpy()
    most, joined, out = most_differing(percent), _Groups(label), []
    for at in range(0, len(node), TILE[0]):
        s = slice(at, at + TILE[0])
        root, found = joined.roots(), []
        for lo in range(0, len(node), TILE[1]):
            o = slice(lo, lo + TILE[1])
            differ = np.bitwise_count(sketch[s, None, :] ^ sketch[None, o, :]).sum(-1, dtype=np.int64)
            small, large = np.minimum(n[s, None], n[None, o]), np.maximum(n[s, None], n[None, o])
            x, y = np.nonzero((differ <= most) & (root[s, None] != root[None, o]) & (node[s, None] < node[None, o]) & (100 * small >= percent * large))
            first = (bands[x + at] == bands[y + lo]).argmax(1) == own if own is not None else np.ones(len(x), bool)
            found.append((x[first], y[first] + lo, differ[x[first], y[first]]))
        x, y, differ = (np.concatenate(c) for c in zip(*found))
        for k in np.lexsort((y, x, differ)):
            i, j = int(x[k]) + at, int(y[k])
            if joined.root(i) == joined.root(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                joined.join(i, j)
                out.append((node[i], node[j]))
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _blocks(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: confirmed links that join the components which members of one band belong to.

    A band is cut into blocks of about ``BLOCK`` members and ``BLOCK_BYTES``, and every
    two blocks meet in a task, which compares them and gives fewer links than they
    have members, whatever the number of pairs.
    """
    sized = members.join(marks.select("node", "n_shingles"), "node")
    size = sized.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.col("n_shingles") * 8 + BITS) / BLOCK_BYTES)).cast("int").alias("parts"))
    held = members.join(if_small(size), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    held = held.join(marks.select("node", "n_shingles", "__sketch", "__bands"), "node").join(sets, "node")
    held = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "band", "node", "label", "n_shingles", "__sketch", "__bands", "set")
    held = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            yield from walk(t, False)
            rest, t = walk.rest, None
            hand_back()
        if rest is not None:
            yield from walk(rest, True)
        rest = walk.rest = None
        hand_back()

    def walk(t: pa.Table, last: bool):
        columns = [t[c].to_numpy() for c in ("key", "i", "j")]
        head = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))))
        ends = [*head[1:].tolist(), t.num_rows]
        stop = len(head) if last else len(head) - 1
        walk.rest = t.slice(int(head[stop])) if stop < len(head) else None
        for k in range(stop):
            if ends[k] - head[k] > 1:
                group = t.slice(int(head[k]), int(ends[k] - head[k]))
                a, b = links_within(group, percent, group["band"][0].as_py())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return held.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are taken in lower case (A-Z); a set holds the distinct runs of ``size``
    words, or the whole sequence if that is shorter. Two documents are linked when
    100 * common >= ``percent`` * union. ``component_id`` is the smallest id that links
    reach, ``kept`` says that it is the row's own. Null and empty texts have no
    shingles and no links. Ids should be unique: a row that repeats an id is judged by
    its own text. Rows without an id are linked with nothing (``component_id`` null, kept).
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(_sign(docs, size))
    whose = ["__k1", "__k2", "n_shingles"]
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # documents of equal sets have equal bands and sketches, so any of them will do
    classes = tight(linked.groupBy(*whose).agg(F.min("doc_id").alias("node"), F.first("__bands").alias("__bands"), F.first("__sketch").alias("__sketch")))
    marks = classes.select("node", "n_shingles", "__sketch", "__bands")
    spread = classes.select("node", F.posexplode("__bands").alias("band", "k")).select(F.xxhash64("k", "band").alias("key"), "band", "node").distinct()
    spread = tight(spread)
    shared = tight(spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    members = tight(spread.join(shared, "key").withColumn("label", F.col("node")))
    nodes = if_small(members.select(F.col("node").alias("doc_id")).distinct())
    sets = stage(_sets(docs.join(nodes, "doc_id", "left_semi"), size))
    links, tested, left = None, None, members
    for centres in (*CENTRES, None):
        if centres:
            pairs = _star(left, centres)
            pairs = pairs if tested is None else pairs.join(hinted(tested), ["a", "b"], "left_anti")
            pairs = tight(_alike(pairs, marks, percent))
            tested = pairs if tested is None else tested.union(pairs)
            if pairs.isEmpty():
                continue
            sure = tight(_confirm(pairs, sets, percent))
        else:
            sure = tight(_blocks(left, marks, sets, percent))
            if sure.isEmpty():
                continue
        links = sure if links is None else links.union(sure)
        reached = components(links)
        if centres:
            left = _open(left, reached)
    own = classes.select(*whose, "node")
    if links is not None:
        own = own.join(reached, "node", "left").select(*whose, F.coalesce("label", "node").alias("component_id"))
    else:
        own = own.withColumnRenamed("node", "component_id")
    out = signed.select("doc_id", *whose).join(tight(own), whose, "left")
    out = out.withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less every document that is not the first of its group."""
    gone = near_duplicates(docs, size, percent, key, text).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(if_small(gone), key, "left_anti")
