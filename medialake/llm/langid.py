"""Language identification of mixed-language texts.

A word (a run of letters) is scored under every language by its hashed character
n-grams; the script of its letters narrows the languages first. Viterbi over the
words of a text, with a fixed penalty for a switch of language, labels spans; the
language of the text is that of most of its words.

Learning is one pass: tasks count n-grams per language into a table of fixed size,
and the sums (``BUCKETS`` numbers a language) are the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from medialake.llm.texts import Texts, add_columns, hand_back, mix, slices

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
SWITCH = 6.0
FLOOR = -8.0
DEPTH = 3.0  # log probability by which the n-grams of a word of a language may be rarer than that language's n-grams on average
CHUNK = 1 << 20  # bytes of text that are worked on at once
UNKNOWN = "und"

#: First code points of script ranges; 0 stands for letters of the Latin script and for code points without a script.
SCRIPTS = [(0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 6), (0x0900, 7), (0x0980, 8), (0x0E00, 9), (0x0F00, 10), (0x10A0, 11),
           (0x1100, 12), (0x1200, 13), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 14), (0x3400, 15), (0xA000, 16), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0),
           (0xFB13, 3), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0xFE70, 5), (0xFF00, 0), (0xFF66, 14), (0xFFA0, 12), (0xFFE0, 0), (0x10000, 16), (0x1D400, 0), (0x1D800, 16), (0x1F000, 0), (0x20000, 15)]
N_SCRIPTS = 17
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([s for _, s in SCRIPTS])

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1


@dataclass
class Words:
    """The letter runs of some texts, and the distinct ones among them."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    kind: np.ndarray  # of each word, its number among the distinct ones
    grams: np.ndarray  # bucket of each n-gram of the distinct words
    gram_of: np.ndarray  # the distinct word it belongs to
    script: np.ndarray  # of each distinct word


def words(t: Texts) -> Words:
    low = t.lowered()
    after = np.zeros(len(low.data), bool)
    after[1:] = low.data[:-1] == 0xC3
    capital = after & (low.data >= 0x80) & (low.data <= 0x9E) & (low.data != 0x97)
    data = np.where(capital, low.data + np.uint8(32), low.data).astype(np.uint8)
    low = Texts(t.first, data, t.offsets)
    start, end, text = low.runs(_LETTER[data])
    _, first, kind = np.unique(low.hashes(start, end), return_index=True, return_inverse=True)
    a, size = start[first], (end - start)[first]
    # the distinct words, each between two zero bytes
    ends = np.cumsum(size + 2)
    begin = ends - size - 2
    body = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    owner = np.repeat(np.arange(len(a)), size + 2)
    inner = np.arange(len(body)) - begin[owner] - 1
    real = (inner >= 0) & (inner < size[owner])
    body[real] = data[a[owner[real]] + inner[real]]
    buckets, of = [low.hashes(a, a + size) >> np.uint64(48)], [np.arange(len(a))]
    for n in GRAMS:
        m = len(body) - n + 1
        if m <= 0:
            continue
        x = np.full(m, n, np.uint64)
        for k in range(n):
            x = x * np.uint64(257) + body[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        buckets.append(mix(x[inside]) >> np.uint64(48))
        of.append(owner[:m][inside])
    return Words(start, end, text, kind, np.concatenate(buckets).astype(np.int64), np.concatenate(of), _scripts(data, a, size))


def _scripts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The script of the first character beyond ASCII of each word, Latin for the others."""
    out = np.zeros(len(start), np.int64)
    high = np.concatenate(([0], np.cumsum(data >= 0xC0)))
    for i in np.flatnonzero(high[start + size] > high[start]):
        for c in data[start[i] : start[i] + size[i]].tobytes().decode("utf-8", "ignore"):
            if ord(c) >= 0x80 and c.isalpha():
                out[i] = _SCRIPT[np.searchsorted(_FROM, ord(c), "right") - 1]
                if out[i]:
                    break
    return out


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # bucket x language: log probability
    allowed: np.ndarray  # script x language
    usual: np.ndarray  # of each language, the mean score of its n-grams

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score of each distinct word in each language, 0 for the best and ``FLOOR`` at least; and which words are credibly of some language, by script and by the mean score of their n-grams."""
        n = len(w.script)
        sums = np.stack([np.bincount(w.gram_of, self.score[w.grams, j], n) for j in range(len(self.languages))], 1)
        total = sums / len(GRAMS)
        fits = self.allowed[w.script]
        known = fits.any(1)
        mean = sums / np.maximum(np.bincount(w.gram_of, minlength=n), 1)[:, None]
        credible = (fits & (mean >= self.usual - DEPTH)).any(1)
        total = np.where(fits | ~known[:, None], total, -np.inf)
        total = np.maximum(total - total.max(1, keepdims=True), FLOOR)
        total[~known] = 0.0
        return total, credible


def learn(docs: DataFrame) -> Model:
    """A model from ``text, lang`` of every row in which neither is null; languages are the values of ``lang``."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(b.schema.get_field_index("lang"))
            for lang in langs.unique().to_pylist():
                table = tables.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for t in slices(b.column(b.schema.get_field_index("text")).filter(pa.compute.equal(langs, lang))):
                    w = words(t)
                    times = np.bincount(w.kind, minlength=len(w.script))
                    table[:BUCKETS] += np.bincount(w.grams, times[w.gram_of], BUCKETS).astype(np.int64)
                    table[BUCKETS:] += np.bincount(w.script, times, N_SCRIPTS).astype(np.int64)
            hand_back()
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "bucket", "n"])

    import pyarrow.compute  # noqa: F401

    known = docs.select("text", "lang").where("text is not null and lang is not null")
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    languages = sorted(sums["lang"].unique())
    table = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    table[sums["bucket"], np.searchsorted(languages, sums["lang"])] = sums["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    score = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    usual = (grams * score).sum(0) / np.maximum(grams.sum(0), 1)
    return Model(languages, score, scripts > 0.002 * scripts.sum(0), usual)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; text ``i`` has the ``count[i]`` words from ``first[i]`` on.

    All texts advance together, longest first, so a step costs one pass over those
    that still have words. Ties stay in the language, then go to the first.
    """
    path = np.zeros(len(scores), np.int64)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return path
    at, size = first[order], count[order]
    open_ = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    v = scores[at].copy()
    kind = np.min_scalar_type(-scores.shape[1])  # signed, and as wide as the number of languages needs
    came = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    for t in range(1, int(size[0])):
        n = open_[t]
        u = v[:n]
        top = u.argmax(1)
        jump = u[np.arange(n), top] - switch
        stay = u >= jump[:, None]
        word = at[:n] + t
        came[word] = np.where(stay, own, top[:, None].astype(kind))
        np.maximum(u, jump[:, None], out=u)
        u += scores[word]
    state = v.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = open_[t]
        word = at[:n] + t
        path[word] = state[:n]
        if t:
            state[:n] = came[word, state[:n]]
    return path


SPAN = StructType([StructField("lang", StringType()), StructField("start", LongType()), StructField("end", LongType())])
OUT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_spans", ArrayType(SPAN)), StructField("learned", DoubleType())])


def _identify(t: Texts, model: Model, switch: float):
    n = len(t)
    w = words(t)
    known = model.allowed[w.script].any(1)[w.kind]
    count = np.bincount(w.text, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    scores, credible = model.words(w)
    path = viterbi(scores[w.kind].astype(np.float32), first, count, switch)
    k = len(model.languages)
    votes = np.bincount((w.text * k + path)[known], minlength=n * k).reshape(n, k)
    best = votes.argmax(1)
    share = votes[np.arange(n), best] / np.maximum(count, 1)
    ascii_letters = t.per_text(_LETTER[t.data] * (t.data < 128)) > 0
    found = [bool(x) or any(c.isalpha() for c in t.data[a:b].tobytes().decode()) for x, a, b in zip(ascii_letters, t.offsets[:-1], t.offsets[1:])]
    names = [model.languages[b] if f else UNKNOWN for b, f in zip(best, found)]
    score = np.where(found, np.where(count > 0, share, 0.0), 0.0)
    learned = np.where(found, np.bincount(w.text, credible[w.kind], n) / np.maximum(count, 1), 0.0)

    points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
    turn = np.ones(len(path), bool)
    turn[1:] = (path[1:] != path[:-1]) | (w.text[1:] != w.text[:-1])
    head = np.flatnonzero(turn)
    last = np.concatenate((head[1:] - 1, [len(path) - 1])) if len(head) else head
    base = points[t.offsets[w.text[head]]]
    spans = pa.StructArray.from_arrays([pa.array(np.array(model.languages, object)[path[head]], pa.string()), pa.array(points[w.start[head]] - base), pa.array(points[w.end[last]] - base)], names=["lang", "start", "end"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(w.text[head], minlength=n)))).astype(np.int32)
    return names, score, pa.ListArray.from_arrays(ends, spans), learned


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (share of its words in that language, by script too), ``lang_spans`` and ``learned`` (share of its words that are credibly in any learned language).

    A span (language, start, end in code points) runs from the first to the last of
    consecutive words with one label. ``und`` with shares of 0 for null and empty texts
    and texts without a letter, and for every text if nothing could be learned. A text
    whose letters fit no learned language gets the first of equal best ones, with
    score 0: words in a script of no learned language count for none. Columns with
    these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def start():
        m = shared.value

        def step(batch):
            column = batch.column(batch.schema.get_field_index(text))
            if not m.languages:
                return [pa.array([UNKNOWN] * len(column)), pa.array([0.0] * len(column)), pa.array([[]] * len(column), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), pa.array([0.0] * len(column))]
            parts = [_identify(t, m, switch) for t in slices(column, chunk)]
            return [pa.array([x for p in parts for x in p[0]], pa.string()), pa.array(np.concatenate([p[1] for p in parts])), pa.chunked_array([p[2] for p in parts]).combine_chunks(), pa.array(np.concatenate([p[3] for p in parts]))]

        return step

    return add_columns(docs, OUT, start)
