"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM.

The kernel of two words sums, over letter triples that both hold in order, the
decay of the gaps between the letters; signs and spaces inserted between letters
do not count and digits that stand for letters are read as those, so
``m.o.r-o-n``, ``m o r o n`` and ``moxron`` stay close to ``moron``. A word is also
read in parts: between its inner signs, every second letter, and, where it is
longer than any landmark or spaced out, in windows as long as landmarks. Landmarks
are words that labelled toxic documents hold far more often than clean ones. A
sentence's kernel values with the landmarks (the highest of its words), mapped
by the inverse root of the landmarks' own kernel, are the SVM's features; it is
trained on sentences of labelled documents, and a document is scored by its
sentences.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from medialake.llm.tables import labelled
from medialake.llm.texts import Texts, add_columns, slices

FIT_ROWS = 12_000
LANDMARKS = 128
LEAST_GAIN = 12.0  # of a landmark: log-likelihood ratio of its documents' split
DECAY = 0.6
POWER = 3  # of the kernel in the SVM
APART = 0.8  # kernel value from which two landmarks are one
REACH = 5  # most letters from the first to the last of a triple
NEAR = 0.45  # kernel value from which a word is looked at
WHOLE = 4  # fewest letters of a window, and of a reading of every second letter
RANGES = 20_000  # compared at once
GROUPS = 32  # of landmarks; what is far from all landmarks of a group is found by one sum
SHORT = 24  # most letters of a range that is compared with groups first
KNOWN = 4_000_000  # words, and readings of words, far from all landmarks that a Python worker keeps
KEPT = 200_000  # words near a landmark whose kernel values a Python worker keeps
SENTENCES = 4  # of a labelled document, the nearest to landmarks

_GAPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH) if a + b <= REACH]
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[0x80:0xC0] = np.arange(27, 91)
#: Digits and signs read as letters (fixed values).
for _sign, _letter in zip("013457@$", "oieastas"):
    _CODE[ord(_sign)] = ord(_letter) - 96
_BASE, _HEAD, _TAIL = 96, 91, 92
_TERMINAL = np.zeros(256, bool)
_TERMINAL[list(b".!?")] = True


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sentence, text of each sentence) of the words of lower-cased texts; single characters in a row are one word."""
    start, end, text = t.words()
    if not len(start):
        return start, end, text, text
    breaks = np.ones(len(start), bool)
    breaks[1:] = (text[1:] != text[:-1]) | (_TERMINAL[t.data[end[:-1] - 1]] & (end - start > 1)[:-1])
    sentence = np.cumsum(breaks) - 1
    single = end - start == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    last = np.concatenate((head[1:] - 1, [len(start) - 1]))
    return start[head], end[last], sentence[head], text[breaks]


def triples(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(triple, word, weight) of the letter triples within ``REACH`` of each byte range, and the ranges' norms."""
    size = end - start + 2  # and a mark at either end
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    owner = np.repeat(np.arange(len(start)), size)
    inner = np.arange(len(owner)) - first[owner] - 1
    code = np.full(len(owner), _HEAD)
    body = (inner >= 0) & (inner < size[owner] - 2)
    code[body] = _CODE[data[start[owner[body]] + inner[body]]]
    code[inner == size[owner] - 2] = _TAIL
    letter = code > 0
    code, owner = code[letter], owner[letter]
    out, square = [], np.zeros(len(start))
    for a, b in _GAPS:
        m = len(code) - a - b
        if m <= 0:
            continue
        inside = np.flatnonzero(owner[:m] == owner[a + b :])
        key = (code[inside] * _BASE + code[inside + a]) * _BASE + code[inside + a + b]
        weight = DECAY ** (a + b - 2)
        square += np.bincount(owner[inside], minlength=len(start)) * weight**2
        out.append((key, owner[inside], np.full(len(key), weight, np.float32)))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)), np.ones(len(start))
    return tuple(np.concatenate(x) for x in zip(*out)), np.sqrt(np.maximum(square, 1e-9))


def readings(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: list[int]):
    """(bytes, start, end, word) of all that is compared for each byte range: its letters, its parts between signs, every second letter, and windows of ``sizes`` letters."""
    n, size = len(start), end - start
    owner = np.repeat(np.arange(n), size)
    body = data[start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)]
    letter = _CODE[body] > 0
    part = np.cumsum(~letter & (body < 0x80))[letter]
    own, text = owner[letter], body[letter]
    count = np.bincount(own, minlength=n)
    first = np.cumsum(count) - count
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head, len(own))[1:]
    parts = np.bincount(own[head], minlength=n)
    inner = (tail - head >= 3) & (parts[own[head]] > 1)
    # every second letter, from the first and from the second on, behind the letters themselves
    place = np.arange(len(own)) - first[own]
    half = np.flatnonzero(count[own] >= 2 * WHOLE - 1)
    half = half[np.argsort(2 * own[half] + place[half] % 2, kind="stable")]
    turn = np.ones(len(half), bool)
    turn[1:] = np.diff(2 * own[half] + place[half] % 2) != 0
    other = np.flatnonzero(turn)
    stop = np.append(other, len(half))[1:]
    of = np.concatenate((np.arange(n), own[half[other]]))
    a, b = np.concatenate((first, len(own) + other)), np.concatenate((first + count, len(own) + stop))
    out = [(a, b, of), (head[inner], tail[inner], own[head[inner]])]
    spaced = (2 * parts >= count)[of]
    for w in sizes:
        cut = np.flatnonzero((b - a > w) & (spaced | (b - a > max(sizes))))
        m = (b - a)[cut] - w + 1
        at = np.repeat(a[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
        out.append((at, at + w, np.repeat(of[cut], m)))
    return np.concatenate((text, text[half])), *(np.concatenate(x).astype(np.int64) for x in zip(*out))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, a place of each, and the number of each hash among them; ``np.unique`` sorts more slowly where it is asked for the first places."""
    distinct, kind = np.unique(hashes, return_inverse=True)
    place = np.empty(len(distinct), np.int64)
    place[kind] = np.arange(len(hashes))
    return distinct, place, kind


def _places(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


class Far:
    """Sorted hashes of what is far from all landmarks; beyond ``KNOWN`` only what came last. New ones lie apart until they are many, so that few of them do not move all others."""

    def __init__(self):
        self.hash = self.late = np.zeros(0, np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return (_places(self.hash, hashes) >= 0) | (_places(self.late, hashes) >= 0)

    def add(self, hashes: np.ndarray) -> None:
        """``hashes`` are sorted, distinct and new."""
        if len(self.hash) + len(self.late) + len(hashes) > KNOWN:
            self.hash, self.late = hashes, hashes[:0]
            return
        self.late = np.insert(self.late, np.searchsorted(self.late, hashes), hashes)
        if len(self.late) > len(self.hash) // 8:
            self.hash, self.late = np.insert(self.hash, np.searchsorted(self.hash, self.late), self.late), self.late[:0]


class Near:
    """Kernel values of words near a landmark, by the words' sorted hashes; beyond ``KEPT`` only what came last."""

    def __init__(self, landmarks: int):
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values = np.empty((KEPT, landmarks), np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of ``values`` of each word, or -1."""
        at = _places(self.hash, hashes)
        return np.append(self.row, -1)[at]

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """``hashes`` are sorted, distinct and new."""
        hashes, values = hashes[:KEPT], values[:KEPT]
        if len(self.hash) + len(hashes) > KEPT:
            self.hash, self.row = self.hash[:0], self.row[:0]
        row, at = len(self.hash) + np.arange(len(hashes)), np.searchsorted(self.hash, hashes)
        self.values[row] = values
        self.hash, self.row = np.insert(self.hash, at, hashes), np.insert(self.row, at, row)


def highest(values: np.ndarray, row: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The highest of ``values[row]``, column by column, in each run of ``row``; runs begin at ``head``, and those of one length are taken together."""
    out, count = np.empty((len(head), values.shape[1]), values.dtype), np.diff(head, append=len(row))
    for n in np.unique(count).tolist():
        at = np.flatnonzero(count == n)
        out[at] = values[row[head[at][:, None] + np.arange(n)]].max(1)
    return out


class Landmarks:
    """The landmarks' triples, for kernel values of many words at once."""

    def __init__(self, names: list[bytes]):
        self.names = names
        body = b"".join(names)
        ends = np.cumsum([len(x) for x in names]).astype(np.int64)
        start = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        letters = [int((_CODE[np.frombuffer(x, np.uint8)] > 0).sum()) for x in names]
        self.sizes = sorted({x for x in letters if x >= WHOLE})
        (key, owner, weight), norm = triples(np.frombuffer(body, np.uint8), start, ends)
        self.row = np.full(_BASE**3, -1, np.int32)
        distinct, at = np.unique(key, return_inverse=True)
        self.row[distinct] = np.arange(len(distinct))
        weights = np.zeros((len(distinct), len(names)), np.float32)
        np.add.at(weights, (at, owner), weight / norm[owner])
        # landmarks go to the nearest of some that are far apart; the last row is that of triples in no landmark
        alike, seeds = weights.T @ weights, [0]
        while len(seeds) < min(GROUPS, len(names)):
            seeds.append(int(alike[:, seeds].max(1).argmin()))
        group = alike[:, seeds].argmax(1) if names else np.zeros(0, np.int64)
        self.most = np.stack([np.append(weights[:, group == g].max(1, initial=0), np.float32(0)) for g in range(len(seeds))], 1)
        # a triple lies in few landmarks: their numbers and weights, triple after triple
        row, self.column = np.nonzero(weights)
        self.value = weights[row, self.column]
        self.count = np.bincount(row, minlength=len(distinct))
        self.first = np.cumsum(self.count) - self.count

    @cached_property
    def reader(self) -> Reader:
        """A reader that lives as long as the landmarks do in a Python worker, so that a task knows the words of earlier tasks."""
        return Reader(self)

    def __getstate__(self):
        return self.names

    def __setstate__(self, names):
        self.__init__(names)

    def reach(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A value that no kernel value of a byte range exceeds; 1 for ranges of more than ``SHORT`` letters.

        A triple adds no more than its highest weight in a group of landmarks, so a
        sum of these bounds the whole group. Ranges of one length have their triples,
        and so their norm, in common.
        """
        out, code = np.ones(len(start)), _CODE[data]
        place = np.concatenate(([0], np.cumsum(code > 0)))
        code, first, letters = code[code > 0], place[start], place[end] - place[start]
        for n in np.unique(letters[(letters > 0) & (letters <= SHORT)]).tolist():
            gaps = [(a, b, n + 2 - a - b) for a, b in _GAPS if a + b < n + 2]
            weight = np.repeat([DECAY ** (a + b - 2) for a, b, _ in gaps], [m for _, _, m in gaps])
            same = np.flatnonzero(letters == n)
            for at in np.split(same, range(500, len(same), 500)):
                word = np.full((len(at), n + 2), _HEAD)
                word[:, 1:-1] = code[first[at][:, None] + np.arange(n)]
                word[:, -1] = _TAIL
                key = np.hstack([(word[:, :m] * _BASE + word[:, a : a + m]) * _BASE + word[:, a + b :] for a, b, m in gaps])
                out[at] = (weight.astype(np.float32) @ self.most.take(self.row.take(key), 0)).max(1) / np.sqrt((weight**2).sum())
        return out * (1 + 1e-4)  # sums are rounded

    def kernel(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, least: float = 0.0) -> np.ndarray:
        """Normalised kernel of each byte range with each landmark; 0 for those that cannot reach ``least`` with any."""
        out = np.zeros((len(start), len(self.names)), np.float32)
        able = np.flatnonzero(self.reach(data, start, end) >= least) if least else np.arange(len(start))
        for lo in range(0, len(able), 1000):
            at = able[lo : lo + 1000]
            (key, owner, weight), norm = triples(data, start[at], end[at])
            row = self.row.take(key)
            hit = row >= 0
            row, owner, weight = row[hit], owner[hit], weight[hit]
            if not len(row):
                continue
            n = self.count[row]
            place = np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
            k = len(self.names)
            sums = np.bincount(np.repeat(owner * k, n) + self.column[place], np.repeat(weight, n) * self.value[place], len(at) * k)
            out[at] = sums.reshape(len(at), k) / norm[:, None]
        return np.minimum(out, 1.0)  # norms count a triple that a word holds twice as two

    def near(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, far: Far) -> np.ndarray:
        """The highest kernel value of all readings of each byte range with each landmark, of the readings that reach ``NEAR``; ``far`` has readings that do not, and gets those that are found."""
        out = np.zeros((len(start), len(self.names)), np.float32)
        body, a, b, owner = readings(data, start, end, self.sizes)
        distinct, first, kind = _distinct(Texts(0, body, np.array([0, len(body)])).hashes(a, b))
        new = np.flatnonzero(~far.holds(distinct))
        a, b, place, found = a[first[new]], b[first[new]], np.full(len(distinct), -1), []
        for lo in range(0, len(new), RANGES):
            values = self.kernel(body, a[lo : lo + RANGES], b[lo : lo + RANGES], NEAR)
            hit = np.flatnonzero(values.max(1) >= NEAR)
            place[new[lo + hit]] = sum(map(len, found)) + np.arange(len(hit))
            found.append(values[hit])
        far.add(distinct[new[place[new] < 0]])
        at = np.flatnonzero(place[kind] >= 0)
        if len(at):
            at = at[np.argsort(owner[at], kind="stable")]
            head = np.flatnonzero(np.concatenate(([True], owner[at[1:]] != owner[at[:-1]])))
            out[owner[at[head]]] = highest(np.concatenate(found), place[kind[at]], head)
        return out


class Reader:
    """Finds the words near a landmark; their kernel values are kept, up to ``KEPT``, as are the hashes of other words and of their readings, up to ``KNOWN``, and not computed again."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.far, self.readings, self.known = Far(), Far(), Near(len(landmarks.names))

    def sentences(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kernel values, text) of every sentence with a word near a landmark, the highest value of its words with each; and the words of each text."""
        low = t.lowered()
        start, end, sentence, text = words(low)
        count = np.bincount(text[sentence], minlength=len(t)) if len(start) else np.zeros(len(t), np.int64)
        none = np.zeros((0, len(self.landmarks.names)), np.float32), np.zeros(0, np.int64), count
        if not len(start) or not self.landmarks.names:
            return none
        distinct, first, kind = _distinct(low.hashes(start, end))
        row = self.known.rows(distinct)
        old, new = np.flatnonzero(row >= 0), np.flatnonzero((row < 0) & ~self.far.holds(distinct))
        values = self.landmarks.near(low.data, start[first[new]], end[first[new]], self.readings)
        close = values.max(1) >= NEAR
        self.far.add(distinct[new[~close]])
        values, near = np.concatenate((self.known.values[row[old]], values[close])), np.concatenate((old, new[close]))
        self.known.add(distinct[near[len(old) :]], values[len(old) :])
        place = np.full(len(distinct), -1)
        place[near] = np.arange(len(near))
        hit = np.flatnonzero(place[kind] >= 0)
        if not len(hit):
            return none
        s = sentence[hit]
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return highest(values, place[kind[hit]], head), text[s[head]], count


@dataclass
class Model:
    landmarks: Landmarks
    root: np.ndarray  # inverse root of the landmarks' kernel
    weight: np.ndarray
    bias: float
    doc: np.ndarray  # weights of the document's features, bias last

    def margins(self, values: np.ndarray) -> np.ndarray:
        return values**POWER @ (self.root @ self.weight) + self.bias

    def probability(self, margins: np.ndarray, text: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = _document(margins, text, words) @ self.doc[:-1] + self.doc[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _document(margins: np.ndarray, text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text: its highest margin (-2 if no sentence comes near a landmark), and the logs of the numbers of sentences above 0 and of words."""
    n = len(words)
    top = np.full(n, -2.0)
    np.maximum.at(top, text, margins)
    return np.stack([np.clip(top, -2, 3), np.log1p(np.bincount(text[margins > 0], minlength=n)), np.log1p(words)], 1)


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, balanced classes) by Newton steps over the rows inside the margin; ``y`` is 1 or -1."""
    side = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    d = x.shape[1] + 1
    w, inside, keep = np.zeros(d), np.ones(len(x), bool), np.append(np.full(d - 1, ridge), 1e-9)

    def parts(rows):
        for at in range(0, len(rows), 4096):
            i = rows[at : at + 4096]
            yield i, np.hstack([x[i].astype(np.float64), np.ones((len(i), 1))])

    for _ in range(steps):
        h, g = np.diag(keep), np.zeros(d)
        for i, z in parts(np.flatnonzero(inside)):
            a = z * side[i, None]
            h, g = h + a.T @ z, g + a.T @ y[i]
        w = np.linalg.solve(h, g)
        now = np.concatenate([y[i] * (z @ w) < 1 for i, z in parts(np.arange(len(x)))])
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights and bias by Newton steps on the log loss, lightly regularised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w), -2, 2)
    return w


def find_landmarks(sample: DataFrame, most: int = LANDMARKS) -> list[bytes]:
    """The words that separate toxic from clean documents of the sample best, by documents that hold them."""

    def count(batches):
        for b in batches:
            label = b.column(b.schema.get_field_index("label")).to_numpy()
            for t in slices(b.column(b.schema.get_field_index("text"))):
                low = t.lowered()
                start, end, text = low.words()
                if not len(start):
                    continue
                h = low.hashes(start, end)
                order = np.lexsort((text, h))
                h, text, start, end = h[order], text[order], start[order], end[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
                h, text, start, end = h[once], text[once], start[once], end[once]
                head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                toxic = np.add.reduceat((label[t.first + text] == 1).astype(np.int64), head)
                total = np.diff(np.concatenate((head, [len(h)])))
                raw = low.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:e].strip(b"\"'.,;:!?()[]{}") for a, e in zip(start[head].tolist(), end[head].tolist())], pa.binary()), pa.array(toxic), pa.array(total - toxic)], names=["word", "toxic", "clean"])

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    p, q = n.get(1, 0), sum(n.values()) - n.get(1, 0)
    seen = sample.select("text", "label").mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # log-likelihood ratio of the split a word's documents have to the split of all
    share, a, c = max(p, 1) / max(p + q, 2), F.col("toxic"), F.col("clean")
    gain = 2 * (a * F.log(a / ((a + c) * share)) + F.when(c > 0, c * F.log(c / ((a + c) * (1 - share)))).otherwise(0.0)) if 0 < share < 1 else F.lit(0.0)
    ranked = seen.where((F.octet_length("word") >= 3) & (a >= 3) & (a > 2 * share * (a + c))).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    words = [bytes(r["word"]) for r in ranked.orderBy(F.col("gain").desc(), "word").limit(4 * most).collect()]
    if not words:
        return []
    ends = np.cumsum([len(w) for w in words])
    alike = Landmarks(words).kernel(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    chosen: list[int] = []
    for i in range(len(words)):  # words near a better one add nothing
        if len(chosen) < most and (not chosen or alike[i, chosen].max() < APART):
            chosen.append(i)
    return [words[i] for i in chosen]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most ``fit_rows`` labelled documents. Without labels of both kinds every document gets their share."""
    sample = labelled(docs, labels, label, fit_rows)
    landmarks = Landmarks(find_landmarks(sample))
    k = len(landmarks.names)
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def read(batches):
        reader = shared.value.reader
        for b in batches:
            ids, y = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "label"))
            for t in slices(b.column(b.schema.get_field_index("text"))):
                x, text, count = reader.sentences(t)
                order = np.lexsort((-x.max(1), text)) if len(x) else np.zeros(0, np.int64)
                x, text = x[order], text[order]
                x, text = x[_first(text, SENTENCES)], text[_first(text, SENTENCES)]
                row = np.concatenate((text, np.setdiff1d(np.arange(len(t)), text)))  # a document without such a sentence counts too
                raw = [v.tobytes() for v in x] + [None] * (len(row) - len(text))
                yield pa.RecordBatch.from_arrays([pa.array(ids[t.first + row]), pa.array(y[t.first + row].astype(np.int32)), pa.array(count[row]), pa.array(raw, pa.binary())], names=["doc_id", "label", "words", "x"])

    got = sample.mapInArrow(read, "doc_id long, label int, words long, x binary").toPandas()  # fit_rows x SENTENCES rows at most
    words_of = got.groupby("doc_id")["words"].first().to_numpy()
    known = got.groupby("doc_id")["label"].first()
    share = (known.sum() + 0.5) / (len(known) + 1)
    blank = Model(landmarks, np.zeros((k, k)), np.zeros(k), -1.0, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    has = got["x"].notna().to_numpy()
    if not has.any() or known.nunique() < 2:
        return blank
    x = np.frombuffer(b"".join(got["x"][has]), np.float32).reshape(-1, k)
    y = got["label"].to_numpy()[has]
    doc = np.unique(got["doc_id"].to_numpy()[has], return_inverse=True)[1]
    body = b"".join(landmarks.names)
    ends = np.cumsum([len(n) for n in landmarks.names])
    own = landmarks.kernel(np.frombuffer(body, np.uint8), np.concatenate(([0], ends[:-1])), ends).astype(np.float64)
    value, vector = np.linalg.eigh(((own + own.T) / 2) ** POWER)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    z = x**POWER @ root.astype(np.float32)
    # every sentence of a clean document is clean; of a toxic one, first the sentence nearest a landmark is toxic, then the one the SVM finds worst
    worst = x.max(1)
    for _ in range(3):
        toxic = np.zeros(len(x), bool)
        toxic[_top(doc, worst)] = True
        use = toxic | (y == 0)
        w, b = svm(z[use], np.where(y[use] == 1, 1.0, -1.0))
        worst = z @ w + b
    model = Model(landmarks, root, w, b, blank.doc)
    ids = known.index.to_numpy()
    features = _document(worst, np.searchsorted(ids, got["doc_id"].to_numpy()[has]), words_of)
    model.doc = logistic(features, known.to_numpy().astype(np.float64))
    return model


def _first(group: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` positions of each run of ``group``."""
    if not len(group):
        return np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.flatnonzero(np.arange(len(group)) - np.repeat(head, np.diff(np.concatenate((head, [len(group)])))) < most)


def _top(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The position of the highest value of each group."""
    order = np.lexsort((-value, group))
    return order[np.concatenate(([True], group[order][1:] != group[order][:-1]))]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score``, the probability of label 1, over the whole text. Null and empty texts have no sentence near a landmark and get the score of that. Repeated rows are scored alike; an empty table gives an empty one. A column ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        reader = m.landmarks.reader

        def step(batch):
            parts = []
            for t in slices(batch.column(batch.schema.get_field_index(text))):
                x, owner, count = reader.sentences(t)
                parts.append(m.probability(m.margins(x), owner, count))
            return [pa.array(np.concatenate(parts).astype(np.float64))]

        return step

    return add_columns(docs, StructType([StructField("score", DoubleType())]), start)
