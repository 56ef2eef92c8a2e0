"""Ranked lexical search of all documents for a set of items, by branch and bound over document FP-trees.

One pass over the texts counts their terms and keeps, of each, the vector of the
terms that some item has. Corpus counts come from these vectors. A task then takes
its vectors in shards: the terms of a vector are put in the order of their document
frequency, most frequent first, and the vectors sorted by these paths, so a subtree
of the trie is a run of vectors. A node keeps the largest frequency of each term and
the smallest length norm of its subtree, which bound the score of everything below
it. Every item walks the tree depth first, the most promising child first, and
leaves out what cannot reach its ten best so far; these are carried from shard to
shard of a task. A task gives each item's best, and the best of all tasks follow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from medialake.llm.texts import Texts, mix, slices
from medialake.operators.ordered import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
AT_ONCE = 1 << 17  # (item, term) pairs that one pass over the corpus serves
BLOCK = 1 << 13  # of these, pairs that one walk serves
SHARD, LEAF = 2048, 32

_PART_OF_TERM = np.zeros(256, np.uint8)
_PART_OF_TERM[48:58] = _PART_OF_TERM[65:91] = _PART_OF_TERM[97:123] = 1
_PART_OF_TERM[128:] = 1
_SIZE = np.uint64(0x9FB21C651E98DF25)


def term_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges, eight bytes a step."""
    size = end - start
    key = size.astype(np.uint64) * _SIZE
    if not len(size):
        return key
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    on = np.arange(len(size))
    for k in range(0, int(size.max()), 8):
        on = on[size[on] > k]
        word = eight[start[on] + k].view("<u8").ravel()
        word = word & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size[on] - k, 8)).astype(np.uint64)))
        key[on] = mix(key[on] ^ word)
    return key


@dataclass
class Vocabulary:
    """Terms by ascending key; term ``i`` is ``body[at[i]:at[i + 1]]``."""

    keys: np.ndarray
    body: np.ndarray
    at: np.ndarray
    longest: int

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Vocabulary, list[str]]:
        raw = [t.encode() for t in terms]
        at = np.cumsum([0, *map(len, raw)])
        keys = term_keys(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two terms have one key")
        raw = [raw[i] for i in order]
        at = np.cumsum([0, *map(len, raw)])
        return cls(keys[order], np.frombuffer(b"".join(raw), np.uint8), at, int(np.diff(at).max(initial=0))), [terms[i] for i in order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The term that each byte range is, -1 for none. Keys propose, bytes decide."""
        found = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(end - start <= self.longest)
        if not len(short) or not len(self.keys):
            return found
        keys = term_keys(data, start[short], end[short])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[place] == keys
        short, place = short[hit], place[hit]
        size = end[short] - start[short]
        same = size == self.at[place + 1] - self.at[place]
        short, place, size = short[same], place[same], size[same]
        if len(short):
            head = np.concatenate(([0], np.cumsum(size)[:-1]))
            step = np.arange(int(size.sum())) - np.repeat(head, size)
            equal = data[np.repeat(start[short], size) + step] == self.body[np.repeat(self.at[place], size) + step]
            sure = np.logical_and.reduceat(equal, head)
            found[short[sure]] = place[sure]
        return found


def count_terms(t: Texts, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats, and (text, term, times) of the terms in the vocabulary, by text and term."""
    low = t.lowered()
    start, end, owner = low.runs(_PART_OF_TERM[low.data])
    n = np.bincount(owner, minlength=len(t))
    term = vocabulary.find(low.data, start, end)
    on = term >= 0
    pair, times = np.unique(owner[on] * max(len(vocabulary.keys), 1) + term[on], return_counts=True)
    return n, pair // max(len(vocabulary.keys), 1), pair % max(len(vocabulary.keys), 1), times


VECTOR = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("times", ArrayType(LongType()))])


def vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, times`` of every text with a term: its number of terms, and those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of at most ``AT_ONCE`` pairs and one item

    def run(batches):
        words = shared.value
        for b in batches:
            ids = b.column(0)
            for t in slices(b.column(1)):
                n, text, term, times = count_terms(t, words)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(t))))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (term.astype(np.int32), times.astype(np.int64))]
                rows = pa.RecordBatch.from_arrays([ids.slice(t.first, len(t)), pa.array(n.astype(np.int64)), *lists], names=VECTOR.fieldNames())
                yield rows.filter(pa.array(n > 0))

    return docs.mapInArrow(run, VECTOR)


def part_of_score(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by, in whole numbers; grows with ``times`` and falls with ``m``."""
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Tree:
    """FP-tree of a shard. ``table[i, t]`` is how often vector ``i`` has term ``t``; terms are numbered by descending document frequency.

    Vectors are in path order. Node ``k`` covers the vectors ``lo[k]`` to ``hi[k]``; its
    children are the nodes ``child[k]`` to ``child[k] + many[k]``. A node without children
    is a leaf: at most ``LEAF`` vectors of neighbouring paths, or equal paths.
    """

    def __init__(self, paths: list[np.ndarray], times: list[np.ndarray], ids: np.ndarray, m: np.ndarray, n_terms: int):
        n = len(paths)
        size = np.array([len(p) for p in paths])
        width = int(size.max(initial=0)) + 1
        table = np.zeros((n, n_terms), np.int64 if max((int(t.max(initial=0)) for t in times), default=0) > 1 << 30 else np.int32)
        steps = np.full((n, width), -1, np.int32)
        row, flat = np.repeat(np.arange(n), size), np.concatenate(paths) if n else np.zeros(0, np.int64)
        table[row, flat] = np.concatenate(times) if n else 0
        steps[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        body = [r.tobytes() for r in (steps + 1).astype(">u4")]  # as bytes they sort like the paths; the end of a path comes first
        order = np.array(sorted(range(n), key=body.__getitem__), np.int64)
        self.table, self.steps, self.ids, self.m = table[order], steps[order], ids[order], m[order]
        self.lo, self.hi, self.child, self.many = [0], [n], [0], [0]
        self._split()
        self.lo, self.hi, self.child, self.many = (np.array(x) for x in (self.lo, self.hi, self.child, self.many))
        self.most = np.zeros((len(self.lo), n_terms), table.dtype)
        self.least = np.zeros(len(self.lo), np.int64)
        for k in range(len(self.lo) - 1, -1, -1):  # children come after their parent
            if self.many[k]:
                own = slice(self.child[k], self.child[k] + self.many[k])
                self.most[k], self.least[k] = self.most[own].max(0), self.least[own].min()
            elif self.hi[k] > self.lo[k]:
                self.most[k], self.least[k] = self.table[self.lo[k] : self.hi[k]].max(0), self.m[self.lo[k] : self.hi[k]].min()

    def _split(self) -> None:
        todo = [(0, 0)]
        while todo:
            k, depth = todo.pop()
            lo, hi = self.lo[k], self.hi[k]
            if hi - lo <= LEAF:
                continue
            differ = np.flatnonzero(self.steps[lo, depth:] != self.steps[hi - 1, depth:])
            if not len(differ):
                continue  # equal paths
            depth += int(differ[0])  # paths without a branch are one node
            step = self.steps[lo:hi, depth]
            cuts = [lo, *(np.flatnonzero(step[1:] != step[:-1]) + 1 + lo).tolist(), hi]
            # small neighbouring subtrees share a leaf
            runs, a = [], cuts[0]
            for b, c in zip(cuts[1:], [*cuts[2:], None]):
                if c is None or c - a > LEAF:
                    runs.append((a, b))
                    a = b
            self.child[k], self.many[k] = len(self.lo), len(runs)
            for a, b in runs:
                todo.append((len(self.lo), depth))
                self.lo.append(a), self.hi.append(b), self.child.append(0), self.many.append(0)


class Best:
    """The ``k`` best of one item: highest score, then smallest id, ids that are missing last."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = 1  # what a score must reach to count

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        on = score >= self.bar
        if not on.any():
            return
        score, ids = np.concatenate((self.score, score[on])), np.concatenate((self.id, ids[on]))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]
        if len(order) == self.k:
            self.bar = int(self.score[-1])


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offer ``best`` every vector that may belong to it; gives the number of vectors that were scored."""
    scored = 0

    def bounds(lo: int, hi: int) -> np.ndarray:
        return (weights * part_of_score(tree.most[lo:hi, terms].astype(np.int64), tree.least[lo:hi, None])).sum(1)

    todo = [(int(bounds(0, 1)[0]), 0)]
    while todo:
        bound, k = todo.pop()
        if bound < best.bar:
            continue
        if tree.many[k]:
            first = int(tree.child[k])
            found = bounds(first, first + int(tree.many[k]))
            order = np.argsort(found, kind="stable")  # the most promising child is taken next
            order = order[found[order] >= best.bar]
            todo += [(int(found[i]), first + int(i)) for i in order]
            continue
        lo, hi = int(tree.lo[k]), int(tree.hi[k])
        scored += hi - lo
        for a in range(lo, hi, SHARD):
            part = slice(a, min(hi, a + SHARD))
            best.offer((weights * part_of_score(tree.table[part][:, terms].astype(np.int64), tree.m[part, None])).sum(1), tree.ids[part])
    return scored


@dataclass
class Items:
    """Query items over a vocabulary: of item ``i``, terms and weights from ``at[i]`` to ``at[i + 1]``; ``rank`` of each term by document frequency."""

    ids: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    rank: np.ndarray
    block: int = BLOCK

    def blocks(self) -> list[tuple[int, int]]:
        """Runs of items with at most ``block`` terms in all, or one item."""
        out, a = [], 0
        for b in range(1, len(self.ids) + 1):
            if b == len(self.ids) or self.at[b + 1] - self.at[a] > self.block:
                out.append((a, b))
                a = b
        return out


_MISSING = np.iinfo(np.int64).max
FOUND = StructType([StructField("item_id", LongType()), StructField("doc_id", LongType()), StructField("score", LongType())])


def _top(vectors_: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = vectors_.sparkSession.sparkContext.broadcast(items)  # ``AT_ONCE`` numbers and one item

    def run(batches):
        q = shared.value
        best = [Best(k) for _ in q.ids]
        blocks = []
        for a, b in q.blocks():
            used = np.unique(q.terms[q.at[a] : q.at[b]])
            used = used[np.argsort(q.rank[used], kind="stable")]  # the most frequent term is 0
            number = np.full(len(q.rank), -1, np.int64)
            number[used] = np.arange(len(used))
            blocks.append((a, b, number, len(used)))

        def walk(ids: list[np.ndarray], m: list[np.ndarray], size: list[np.ndarray], terms: list[np.ndarray], times: list[np.ndarray]) -> None:
            ids, m, size, terms, times = (np.concatenate(x) for x in (ids, m, size, terms, times))
            owner = np.repeat(np.arange(len(ids)), size)
            for a, b, number, width in blocks:
                step = number[terms]
                on = step >= 0
                o, s, t = owner[on], step[on], times[on]
                order = np.lexsort((s, o))
                cuts = np.cumsum(np.bincount(o, minlength=len(ids)))[:-1]
                tree = Tree(np.split(s[order], cuts), np.split(t[order], cuts), ids, m, width)
                for i in range(a, b):
                    own = slice(q.at[i], q.at[i + 1])
                    if q.at[i + 1] > q.at[i]:
                        search(tree, number[q.terms[own]], q.weights[own], best[i])

        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD):
                part = batch.slice(lo, SHARD)
                ids = part.column(0).fill_null(_MISSING).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                m = 10 + 90 * n * n_docs // n_terms if 90 * n_docs * int(n.max()) < 1 << 63 else np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()])
                terms, times = part.column(2), part.column(3)
                size = terms.value_lengths().to_numpy(zero_copy_only=False)
                held.append((ids, m, size, terms.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)))
                waiting += len(ids)
                if waiting >= SHARD:
                    walk(*zip(*held))
                    held, waiting = [], 0
        if held:
            walk(*zip(*held))
        for item, b in zip(q.ids, best):
            if len(b.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), item)), pa.array(b.id, mask=b.id == _MISSING), pa.array(b.score)], names=FOUND.fieldNames())

    return vectors_.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, at_once: int = AT_ONCE, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each row of ``items``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are ignored.
    Terms are runs of letters, digits and signs beyond ASCII, A-Z in lower case. Null and
    empty texts have none: such items find nothing, such documents are not counted.
    Equal scores go by id, missing ids last; rows with one id are ranked each. Items of
    one id are one item with the terms of all; items without an id find nothing.
    """
    spark = docs.sparkSession
    letters = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(letters, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    pairs = stage(pairs)
    passes = math.ceil(pairs.count() / at_once)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for turn in range(passes):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).orderBy("item_id", "term").toPandas()  # about ``at_once`` short rows
        if not len(mine):
            continue
        vocabulary, terms = Vocabulary.of(sorted(set(mine["term"])))
        held = stage(vectors(texts, vocabulary))
        sums = held.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not sums["docs"]:
            break
        df = np.zeros(len(terms), np.int64)
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toPandas()  # a row a term of the vocabulary
        df[counted["term"].to_numpy()] = counted["df"]
        weight = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        by_frequency = np.empty(len(df), np.int64)
        by_frequency[np.argsort(-df, kind="stable")] = np.arange(len(df))
        number = {t: i for i, t in enumerate(terms)}
        ids, first = np.unique(mine["item_id"].to_numpy(), return_index=True)
        term = np.array([number[t] for t in mine["term"]])
        queries = Items(ids, np.concatenate((first, [len(mine)])), term, weight[term], by_frequency, block)
        found = _top(held, queries, int(sums["docs"]), int(sums["terms"]), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
