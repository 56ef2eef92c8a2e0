"""Quality rules by repetition coverage.

Rolling hashes of runs of several lengths of words, computed column-wise over
whole Arrow batches, mark the runs that a text holds more than once; the rule
measures which part of the text's characters lies inside such runs, and inside
lines that repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from medialake.llm.texts import Texts, add_columns, mix, shingles, slices

#: n-gram length in words -> highest share of word characters inside n-grams that occur twice or more
LIMITS = {4: 0.40, 6: 0.30, 9: 0.25}
#: highest share of word characters on lines that occur twice or more
LINE_LIMIT = 0.35
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LINE = np.ones(256, np.uint8)
_LINE[0x0A] = 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the entries whose value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    np.equal(s[1:], s[:-1], out=same[1:-1])
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _covered(word_hash: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Marks the words inside a run of ``size`` words that its text holds more than once."""
    n = len(word_hash)
    out = np.zeros(n, bool)
    if n < size:
        return out
    run, owner = shingles(word_hash, text, size)
    at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    hit = at[repeated(mix(run + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))]
    for k in range(size):
        out[hit + k] = True
    return out


def _measure(t: Texts, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the five counts, and the share of word characters in repeated runs of each length and in repeated lines."""
    n = len(t)
    start, end, owner = t.words()
    sums = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=sums[1:])
    chars = sums[end] - sums[start]
    total = np.bincount(owner, chars, n).astype(np.int64)
    h = t.hashes(start, end)
    counts = np.zeros((5, n), np.int64)
    counts[0] = np.bincount(owner, minlength=n)
    counts[1] = total
    counts[2] = t.per_text(_SYMBOL[t.data])
    whole = np.maximum(total, 1)
    shares = np.zeros((len(grams) + 1, n))
    for g, size in enumerate(grams):
        cover = _covered(h, owner, size)
        shares[g] = np.bincount(owner[cover], chars[cover], n) / whole
    counts[4] = np.bincount(owner[_covered(h, owner, 3)], minlength=n)

    ls, le, lo = t.runs(_LINE[t.data])
    first = np.searchsorted(start, ls)
    last = np.searchsorted(start, le)
    held = last > first  # lines with a word
    ls, le, lo, first, last = ls[held], le[held], lo[held], first[held], last[held]
    key = mix(t.hashes(ls, le) + lo.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    again = repeated(key)
    through = np.concatenate(([0], np.cumsum(chars)))
    shares[-1] = np.bincount(lo[again], (through[last] - through[first])[again], n) / whole
    distinct = np.bincount(lo[np.unique(key, return_index=True)[1]], minlength=n)
    counts[3] = np.bincount(lo, minlength=n) - distinct
    return counts, shares


def rules(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, text: str = "text") -> DataFrame:
    """Every row with the counts of its text, ``dup_share_<n>`` and ``dup_share_lines`` (0 to 1), ``base_failed`` and ``kept``.

    Null and empty texts have no words: counts and shares are 0, ``base_failed`` is
    true. Words are compared as they are written. A line is a run of characters
    between line feeds and counts if it has a word. Repeated rows are judged alike; an
    empty table gives an empty one. Input columns with these names are replaced.
    """
    limits = dict(limits or LIMITS)
    grams = tuple(limits)
    names = [f"dup_share_{g}" for g in grams] + ["dup_share_lines"]
    schema = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField(c, DoubleType()) for c in names]
                        + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    top = np.array([*limits.values(), line_limit])[:, None]

    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = [_measure(t, grams) for t in slices(batch.column(batch.schema.get_field_index(text)))]
            counts = np.concatenate([p[0] for p in parts], 1) if parts else np.zeros((5, 0), np.int64)
            shares = np.concatenate([p[1] for p in parts], 1) if parts else np.zeros((len(names), 0))
            failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
            kept = ~failed & (shares <= top).all(0)
            return [pa.array(c) for c in (*counts, *shares, failed, kept)]

        return step

    return add_columns(docs, schema, start)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    return rules(docs, **options).where(F.col("kept")).select(*docs.columns)
