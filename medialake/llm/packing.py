"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths meets in one place (``capacity`` numbers,
whatever the input size). Near lengths form a class that counts as its longest,
and the configuration linear program over classes is solved by multiplicative
weights: every round a knapsack dynamic program prices classes by their current
weights and gives the most valuable bin, and the weights of the classes it holds
fall. Rounding the multiples down gives whole bins; what they leave over is put,
longest first, where it fits best. Pieces shorter than a ``FINE``-th of a bin
stay out of the program: they fill the gaps. The plan is a list of runs (length, from
rank, first bin, bins, items a bin, place), and every piece finds its bin and
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from medialake.llm.tables import if_small
from medialake.llm.texts import WORD, Texts, add_columns, hand_back, slices, without
from medialake.llm.tokens import BYTE_OF, Store
from medialake.operators.ordered import stage

END = 1
ROUNDS = 600
CLASSES = 256
FINE = 16
STEP = 0.3
KNOWN = 200_000

_MARKS = string.punctuation
_WORDS = re.compile(WORD).findall
_LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch  # letters that are their own lower case and composed form


class WordIds:
    """Token ids of texts by the tokenizer in ``path``, as little-endian unsigned 32-bit numbers.

    Each distinct word that a task meets is encoded once, while the store holds it. That
    needs a tokenizer of words with word ends, which joins nothing across white space,
    as the one this is used with. Most words are letters and then, maybe, punctuation,
    two pre-tokens. Letters of Latin script are merged by ``tiktoken`` over the same
    vocabulary, many words at a time, with a zero byte for the end of a word; the ids
    are those of ``tokenizers`` (tests compare them), which encodes all other words.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                over = token.endswith("</w>")
                ranks[bytes(map(BYTE_OF.__getitem__, token.removesuffix("</w>"))) + b"\0" * over] = i
        self.ranks = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known, self.stems = Store(KNOWN), Store(KNOWN)

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Add words of letters alone to the stems."""
        other = [w for w in words if not _LATIN(w)]
        self.stems.young.update(zip(other, self._encode(other)))
        words = [w for w in words if _LATIN(w)]
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            ids = self.ranks.encode_to_numpy("\0".join(part) + "\0", disallowed_special=()).astype("<u4", copy=False)
            raw, at = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            self.stems.young.update(zip(part, [raw[a:b] for a, b in zip([0, *at], at)]))

    def _learn(self, words: list[str]) -> None:
        split, other = [], []
        for w in words:
            stem = w.rstrip(_MARKS)
            low = stem.lower()
            if low.isalpha():
                split.append((w, low if _LATIN(low) else stem, w[len(stem) :]))
            else:
                other.append(w)
        new = self.stems.missing({s for _, s, _ in split} | {m for _, _, m in split if m})
        self._letters([s for s in new if s[0] not in _MARKS])
        marks = [m for m in new if m[0] in _MARKS]
        stems, known = self.stems.young, self.known.young
        stems.update(zip(marks, self._encode(marks)))
        for w, stem, mark in split:
            known[w] = stems[stem] + stems[mark] if mark else stems[stem]
        known.update(zip(other, self._encode(other)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # split() also cuts at 0x1C-0x1F, which are symbols to a tokenizer
        cut = [[] if not t else _WORDS(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        self._learn(self.known.missing(set().union(*cut)))
        known = self.known.young
        return [b"".join(map(known.__getitem__, x)) for x in cut]


_KIND = np.full(256, 3, np.uint8)  # of a byte: 0 white space, 1 letter, 2 digit, 3 other sign
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def latin(t: Texts) -> np.ndarray:
    """Which texts are of ASCII and the letters from U+00C0 to U+00FF alone, without a zero byte and without what may begin a special token."""
    d = t.data
    odd = (d == 0) | (d == 0xC2) | (d >= 0xC4)
    odd[1:] |= ((d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))) | ((d[:-1] == 0x3C) & (d[1:] == 0x7C))
    return t.per_text(odd) == 0


def cut_words(t: Texts) -> tuple[bytes, np.ndarray]:
    """The pre-tokens of :func:`latin` texts in lower case, each with a zero byte behind, and their number in each text.

    Pre-tokens are runs of letters, single digits, runs of other signs, and an
    apostrophe with the ending behind it where it is not in a run of signs.
    """
    d = t.lowered().data
    n = len(d)
    accented = np.zeros(n, bool)
    accented[1:] = (d[:-1] == 0xC3) & (d[1:] <= 0x9E)
    d = np.where(accented, d + np.uint8(32), d)
    kind = _KIND[d]
    first = np.zeros(n + 3, bool)
    first[t.offsets[:-1]] = True
    begin = first[:n].copy()
    begin[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quote = np.flatnonzero(d == 0x27)
    quote = quote[first[quote] | (kind[quote - 1] != 3)]
    behind = np.concatenate((d, np.zeros(3, np.uint8)))
    x, y = np.where(first[quote + 1], 0, behind[quote + 1]), np.where(first[quote + 1] | first[quote + 2], 0, behind[quote + 2])
    size = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 2, np.where(((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C), 3, 0))
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    after = quote + size
    begin[after[after < n]] = True
    word = kind > 0
    end = np.ones(n, bool)
    end[:-1] = begin[1:]
    end &= word
    d, end = d[word], end[word]
    times = 1 + end.astype(np.int64)
    out = np.repeat(d, times)
    out[(np.cumsum(times) - 1)[end]] = 0
    return out.tobytes(), t.per_text(begin & word)


class TextIds:
    """Ids of the texts of string columns: :func:`latin` texts as a whole, merged by ranks, any other text word by word."""

    def __init__(self, path: str):
        self.words = WordIds(path)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, ids of consecutive texts)."""
        for t in slices(column):
            plain = latin(t)
            if plain.all():
                yield t.first, self._plain(t)
                continue
            raw = t.data.tobytes()
            bodies = [raw[a:b] for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())]
            out: list[bytes] = [b""] * len(bodies)
            at = np.flatnonzero(~plain).tolist()
            for i, ids in zip(at, self.words([bodies[i].decode() for i in at])):
                out[i] = ids
            at = np.flatnonzero(plain).tolist()
            kept = [bodies[i] for i in at]
            ends = np.concatenate(([0], np.cumsum([len(b) for b in kept]))).astype(np.int64)
            for i, ids in zip(at, self._plain(Texts(0, np.frombuffer(b"".join(kept), np.uint8), ends))):
                out[i] = ids
            yield t.first, out

    def _plain(self, t: Texts) -> list[bytes]:
        body, count = cut_words(t)
        if not body:
            return [b""] * len(t)
        ids = self.words.ranks.encode_to_numpy(body.decode(), disallowed_special=()).astype("<u4", copy=False)
        over = np.concatenate(([0], np.flatnonzero(self.words.ends[ids]) + 1))  # ids up to each word's end
        at = (over[np.concatenate(([0], np.cumsum(count)))] * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:])]


RANK = StructType([StructField("__task", IntegerType()), StructField("__nth", LongType())])


class Ranks:
    """Columns ``RANK`` of a task's rows: the task, and a row's number among the rows of its length that the task has met."""

    def __init__(self, capacity: int):
        from pyspark import TaskContext

        self.task, self.seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

    def __call__(self, length: np.ndarray) -> list[pa.Array]:
        order = np.argsort(length, kind="stable")
        s = length[order]
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        run = np.diff(np.concatenate((head, [len(s)])))
        nth = np.empty(len(s), np.int64)
        nth[order] = np.arange(len(s)) - np.repeat(head, run) + np.repeat(self.seen[s[head]], run)
        self.seen[s[head]] += run
        return [pa.array(np.full(len(s), self.task, np.int32)), pa.array(nth)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, text: str = "text", end: int = END, keep_ids: bool = True) -> DataFrame:
    """The token pieces of every row: its columns but the text, and ``piece, start, length, ids``.

    ``ids`` holds the ids as little-endian unsigned 32-bit numbers, or with
    ``keep_ids=False`` there is their ``ids_crc32`` instead. A text's ids end
    with ``end``; null and empty texts give that id alone. Longer sequences are cut
    at multiples of ``capacity``. Repeated rows are rows of their own; an empty table
    gives an empty one; columns with the names of new ones are replaced.
    """
    return _pieces(docs, tokenizer, capacity, text, end, keep_ids, False)


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, text: str, end: int, keep_ids: bool, ranked: bool) -> DataFrame:
    """:func:`pieces`, with the columns of :class:`Ranks` if ``ranked``."""
    last_field = StructField("ids", BinaryType()) if keep_ids else StructField("ids_crc32", LongType())
    new = StructType([StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), last_field, *(RANK.fields if ranked else [])])
    base = without(docs, new.fieldNames())
    kept = [f for f in base.schema.fields if f.name != text]
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        ids, ranks = TextIds(tokenizer), Ranks(capacity) if ranked else None
        for b in batches:
            for lo, bodies in ids(b.column(b.schema.get_field_index(text))):
                part = b.slice(lo, len(bodies))
                row, piece, start, size, out = [], [], [], [], []
                for i, body in enumerate(bodies):
                    body += last
                    for k in range(0, len(body), 4 * capacity):
                        cut = body[k : k + 4 * capacity]
                        row.append(i), piece.append(k // (4 * capacity)), start.append(k // 4), size.append(len(cut) // 4), out.append(cut if keep_ids else zlib.crc32(cut))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(f.name)).take(take) for f in kept] + [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary() if keep_ids else pa.int64())]
                    + (ranks(np.array(size, np.int64)) if ranks else []),
                    names=[f.name for f in kept] + new.fieldNames())
            hand_back()
        del ids
        hand_back()  # the tokenizer too

    return base.mapInArrow(run, StructType(kept + new.fields))


def best_bin(sizes: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size the most valuable bin holds: a knapsack dynamic program over the capacities.

    Counts are split into powers of two.
    """
    best = np.zeros(capacity + 1)
    took: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-value / sizes, kind="stable"):
        left, many = int(min(most[i], capacity // sizes[i])), 1
        while left > 0:
            k = min(many, left)
            w = int(k * sizes[i])
            other = best[: capacity + 1 - w] + k * value[i]
            better = other > best[w:]
            np.maximum(best[w:], other, out=best[w:])
            took.append((int(i), k, better))
            left, many = left - k, many * 2
    held, at = np.zeros(len(sizes), np.int64), capacity
    for i, k, better in reversed(took):
        w = int(k * sizes[i])
        if at >= w and better[at - w]:
            held[i] += k
            at -= w
    return held


def classes(sizes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The class of each of the ascending sizes: one each if they are few, else about ``most`` classes of equal tokens."""
    if len(sizes) <= most:
        return np.arange(len(sizes))
    mass = np.cumsum(sizes * counts)
    return np.unique((mass - 1) * most // mass[-1], return_inverse=True)[1]


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float = STEP) -> list[tuple[np.ndarray, float]]:
    """(bin, multiple) of a nearly optimal fractional cover of ``counts``, by multiplicative weights.

    A size's price is its part of a bin times a weight that falls exponentially
    with the times the rounds have covered its count. Every round uses the bin of
    the highest price until that covers one of its sizes once. At the end all
    multiples are divided by the mean cover.
    """
    cover, used = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        held = best_bin(sizes, sizes / capacity * np.exp(-step * (cover - cover.min())), counts, capacity)
        on = held > 0
        times = float((counts[on] / held[on]).min())
        cover += held * times / counts
        key = held.tobytes()
        used[key] = used.get(key, 0.0) + times
    mean = float((cover * sizes * counts).sum() / (sizes * counts).sum())
    return sorted(((np.frombuffer(k, np.int64), x / mean) for k, x in used.items()), key=lambda c: -c[1])


class Plan:
    """Runs of a packing, built over counts: which ranks of a length go to which bins and places."""

    def __init__(self, counts: dict[int, int], capacity: int, rounds: int = ROUNDS):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.left = {k: v for k, v in counts.items() if v}
        self.placed = dict.fromkeys(self.left, 0)
        self.room: dict[int, list[tuple[int, int]]] = {}  # space left in a bin -> (first bin, bins)
        self.spaces: list[int] = []
        self._whole_bins()
        self._fractional(rounds)
        self._best_fit()

    def _put(self, length: int, first: int, bins: int, each: int, place: int) -> None:
        self.runs.append((length, self.placed[length], first, bins, each, place))
        self.placed[length] += bins * each
        self.left[length] -= bins * each

    def _open(self, space: int, first: int, bins: int) -> None:
        if space and bins:
            if space not in self.room:
                self.room[space] = []
                bisect.insort(self.spaces, space)
            self.room[space].append((first, bins))

    def _whole_bins(self) -> None:
        n = self.left.get(self.capacity, 0)
        if n:
            self._put(self.capacity, 0, n, 1, 0)
            self.bins = n

    def _fractional(self, rounds: int) -> None:
        """Whole multiples of the program's bins; a slot takes pieces of its class, longest first. The last slot of a bin stays open for the best fit."""
        sizes = np.array(sorted(k for k, v in self.left.items() if v and k > self.capacity // FINE), np.int64)
        if not len(sizes) or not rounds:
            return
        counts = np.array([self.left[int(s)] for s in sizes], np.int64)
        of = classes(sizes, counts, CLASSES)
        members = [[int(s) for s in sizes[of == c][::-1]] for c in range(of[-1] + 1)]
        tops, totals = np.array([m[0] for m in members]), np.bincount(of, counts).astype(np.int64)
        for held, times in configurations(tops, totals, self.capacity, rounds):
            slots = [int(c) for c in np.flatnonzero(held)[::-1] for _ in range(held[c])]
            bins = min([int(times), *(int(totals[c] // held[c]) for c in np.flatnonzero(held))])
            if bins < 1:
                continue
            filled = [(self.bins, bins, 0)]  # first bin, bins, tokens in each
            for c in slots[:-1] or slots:
                filled = [x for run in filled for x in self._slot(members[c], *run)]
                totals[c] -= bins
            for first, n, place in filled:
                self._open(self.capacity - place, first, n)
            self.bins += bins

    def _slot(self, lengths: list[int], first: int, bins: int, place: int):
        """One piece of the class in each of these bins; gives the runs of bins with equal content."""
        while bins:
            while not self.left[lengths[0]]:
                lengths.pop(0)
            s = lengths[0]
            n = min(bins, self.left[s])
            self._put(s, first, n, 1, place)
            yield first, n, place + s
            first, bins = first + n, bins - n

    def _best_fit(self) -> None:
        """Every piece left, longest first, into the bin with the least room that holds it, else into new bins."""
        for s in sorted((k for k, v in self.left.items() if v), reverse=True):
            while self.left[s]:
                at = bisect.bisect_left(self.spaces, s)
                if at == len(self.spaces):
                    each = self.capacity // s
                    bins = max(1, self.left[s] // each)
                    self._fill(s, self.capacity, self.bins, bins)
                    self.bins += bins
                    continue
                space = self.spaces[at]
                first, bins = self.room[space].pop()
                if not self.room[space]:
                    del self.room[space]
                    self.spaces.pop(at)
                self._fill(s, space, first, bins)

    def _fill(self, s: int, space: int, first: int, bins: int) -> None:
        """Put pieces of length ``s`` into these bins with ``space`` left, as many in each as fit, until none are left."""
        each, place = space // s, self.capacity - space
        full = min(bins, self.left[s] // each)
        if full:
            self._put(s, first, full, each, place)
            self._open(space - each * s, first, full)
        if full < bins and self.left[s]:
            some = self.left[s]
            self._put(s, first + full, 1, some, place)
            self._open(space - some * s, first + full, 1)
            full += 1
        self._open(space, first + full, bins - full)

    def lookup(self) -> dict[int, np.ndarray]:
        """Per length its runs by rank: columns from rank, first bin, items a bin, place."""
        out: dict[int, list] = {}
        for length, rank, first, _, each, place in self.runs:
            out.setdefault(length, []).append((rank, first, each, place))
        return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = 4096, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``parts`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    The rows of a sequence lie one after another from 0 without gaps and never
    exceed ``capacity``. The input is written once, with each row's number among the
    rows of its length in its task; summed over tasks these give the rank of a row
    without ordering rows, so one length may hold all of them. An empty table gives
    an empty one; equal rows get places of their own.
    """

    def start():
        ranks = Ranks(capacity)
        return lambda batch: ranks(batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False))

    return _place(stage(add_columns(without(parts, ["sequence_id", "offset"]), RANK, start)), capacity, rounds)


def pack_texts(docs: DataFrame, tokenizer: str, capacity: int = 4096, text: str = "text", end: int = END, keep_ids: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """:func:`pack` of the :func:`pieces` of ``docs``, which get their numbers where they are cut: ids pass one Python step before they are written, not two side by side in an executor's memory."""
    return _place(stage(_pieces(without(docs, ["sequence_id", "offset"]), tokenizer, capacity, text, end, keep_ids, True)), capacity, rounds)


def _place(rows: DataFrame, capacity: int, rounds: int) -> DataFrame:
    """Staged rows with ``length`` and the columns of :class:`Ranks`, these replaced by ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    held = rows.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("__n"))
    plan = Plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("__n").alias("n")).collect()}, capacity, rounds)  # at most ``capacity`` rows
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("length", "__task", F.coalesce(before, F.lit(0)).alias("__base"))
    runs = spark.sparkContext.broadcast(plan.lookup())  # runs over lengths and bin shapes, whatever the number of rows
    place = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def find():
        table = runs.value

        def step(batch):
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False)
            seq, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            s = length[order]
            heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else []
            for a, b in zip(heads, [*heads[1:], len(s)]):
                own, size = order[a:b], int(s[a])
                t = table[size][np.searchsorted(table[size][:, 0], rank[own], "right") - 1]
                k = rank[own] - t[:, 0]
                seq[own] = t[:, 1] + k // t[:, 2]
                at[own] = t[:, 3] + k % t[:, 2] * size
            return [pa.array(seq), pa.array(at)]

        return step

    # rows may carry their token ids: they stay where they are while the bases are few
    ranked = rows.join(if_small(base), ["length", "__task"]).withColumn("__rank", F.col("__base") + F.col("__nth")).drop("__base", "__nth", "__task")
    names = [c for c in rows.columns if c not in RANK.fieldNames()]
    return add_columns(ranked, place, find).select(*names, "sequence_id", "offset")
