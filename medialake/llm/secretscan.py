"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand.

The cost of a value is the least number of guesses, in bits, over all ways to cut
it into common words, dates, repeats, keyboard walks and spans that have to be
tried out; a dynamic program over its positions finds the cheapest cut. A value
in a credential context is a secret when even that cut costs ``min_bits``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from medialake.llm.texts import add_columns, slices

KINDS = ("assign", "access", "hex", "guess")
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("bits", DoubleType())])
MIN_BITS = 38.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
#: Where credentials stand: a name of one, at the start of a word or of a part in camel case, then a colon, an equals sign or "is", then the value; after "bearer" white space is enough.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_\x20-]?key|(?:access|private|secret)[_\x20-]?key|bearer)["']?\x20{0,8}(?:[:=]|\x20is\x20)\x20{0,8}["']?(?:bearer\s{1,8})?|bearer\s{1,8}["']?)([^\s"'<>,;]{6,})""",
    re.I | re.A)
STEMS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer")

#: Common words of guessed passwords and placeholders (fixed values), in order of rank.
COMMON = (
    "password 123456 qwerty letmein welcome admin login monkey dragon football baseball master sunshine princess shadow "
    "superman batman trustno1 hello freedom whatever michael jennifer jordan hunter charlie thomas george andrew daniel "
    "summer winter spring autumn secret token key apikey user username root guest test testing demo example sample changeme "
    "change me placeholder insert your here default temp temporary dummy none null undefined redacted removed hidden empty "
    "value string abc xxx foo bar baz server client database access private public company love iloveyou monday friday january "
    "february march april june july august september october november december the and for you not with from pass word"
).split()
RANK = {w: math.log2(i + 2) for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
DATE_BITS = {4: 7.0}

_NEXT: dict[str, set[str]] = {}
for _row in ROWS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)
_HEX = np.zeros(256, np.uint8)
_HEX[list(b"0123456789abcdef")] = 1


def _alphabet(c: str) -> float:
    return 3.33 if c in "0123456789" else 4.71 if "a" <= c <= "z" else 5.71 if "A" <= c <= "Z" else 6.57


def segments(v: str):
    """(from, to, bits) of every word, date, repeat and keyboard walk of ``v``; positions that must be tried out are left to :func:`guess_bits`."""
    low, n = v.lower(), len(v)
    for i in range(n):
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            bits = RANK.get(low[i:j])
            if bits is not None:
                yield i, j, bits + (0.0 if low[i:j] == v[i:j] else 1.0 if v[i + 1 : j] == low[i + 1 : j] else 2.0 + j - i)
        m = DATE.match(v, i)
        if m:
            yield i, m.end(), DATE_BITS.get(m.end() - i, 15.5)
            if m.end() - i > 4 and v[i : i + 2] in ("19", "20"):
                yield i, i + 4, DATE_BITS[4]
    for unit in (1, 2, 3, 4):  # a block and its repeats cost the block and their number
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j + unit <= n and v[j : j + unit] == v[i : i + unit]:
                j += unit
            if j - i >= max(3, 2 * unit):
                yield i, j, sum(map(_alphabet, v[i : i + unit])) + math.log2((j - i) // unit)
                i = j
            else:
                i += 1
    i = 0
    while i < n:  # the longest walks, and all their beginnings and ends from three keys on
        j = i + 1
        while j < n and low[j] in _NEXT.get(low[j - 1], ()):
            j += 1
        for a in range(i, j - 2):
            yield a, j, 5.6 + 1.6 * (j - a) / 2
            yield i, i + (j - a), 5.6 + 1.6 * (j - a) / 2
        i = j


def guess_bits(v: str) -> float:
    """Bits of the cheapest cut of ``v``; each segment after the first adds one bit for the choice of its kind."""
    n = len(v)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, bits in segments(v):
        into[j].append((i, bits))
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + _alphabet(v[j - 1])
        for i, bits in into[j]:
            best[j] = min(best[j], best[i] + bits + (1.0 if i else 0.0))
    return best[n]


def _is_secret(v: str, min_bits: float) -> float | None:
    """Its bits, if ``v`` is one: letters alone of one case, or with one capital in front, are taken for prose, and a secret must cost ``min_bits``."""
    if v.isalpha() and (v[1:] == v[1:].lower() or v == v.upper()):
        return None
    bits = guess_bits(v)
    return bits if bits >= min_bits else None


def scan_text(body: bytes, hexes: list[tuple[int, int]], min_bits: float = MIN_BITS) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, bits) in code points, by start and then kind; ``hexes`` has the byte ranges of the long hex runs."""
    found: list[tuple[str, int, int, float | None]] = []
    low = body.lower()
    if hexes or b"AKIA" in body:
        for kind, spans in (("hex", hexes), ("access", [m.span() for m in ACCESS.finditer(body)])):
            for a, b in spans:
                at = len(body[:a].decode())
                found.append((kind, at, at + b - a, None))  # both patterns are ASCII
    if any(s in low for s in STEMS):
        text = body.decode()
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append(("assign", m.start(), m.end(), None))
        for m in CONTEXT.finditer(text):
            v = m[1].rstrip(".,;:!?)]}")
            bits = _is_secret(v, min_bits) if len(v) >= 6 else None
            if bits is not None:
                found.append(("guess", m.start(1), m.start(1) + len(v), round(bits, 3)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan_batch(column: pa.Array, min_bits: float):
    """The bytes and the spans of each text of a batch."""
    for t in slices(column):
        raw = t.data.tobytes()
        start, end, owner = t.runs(_HEX[t.data])
        long = end - start >= 16
        hexes: dict[int, list[tuple[int, int]]] = {}
        for a, b, i in zip(start[long].tolist(), end[long].tolist(), owner[long].tolist()):
            hexes.setdefault(i, []).append((a - int(t.offsets[i]), b - int(t.offsets[i])))
        ends = t.offsets.tolist()
        for i in range(len(t)):
            body = raw[ends[i] : ends[i + 1]]
            yield body, scan_text(body, hexes.get(i, []), min_bits)


def scan(docs: DataFrame, min_bits: float = MIN_BITS, text: str = "text") -> DataFrame:
    """Every row with ``spans``: array of (kind, start, end, bits) over the whole text, in code points, end exclusive.

    Kinds: ``assign``, ``access`` and ``hex`` by pattern, ``guess`` by the cost of a
    value in a credential context. Null and empty texts have no spans, repeated rows
    have equal ones, an empty table gives an empty one. A column ``spans`` of the input
    is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def start():
        def step(batch):
            column = batch.column(batch.schema.get_field_index(text))
            return [pa.array([[dict(zip(("kind", "start", "end", "bits"), s)) for s in spans] for _, spans in _scan_batch(column, min_bits)], kind)]

        return step

    return add_columns(docs, StructType([StructField("spans", ArrayType(SPAN))]), start)


def redact(docs: DataFrame, mark: str = "[SECRET]", min_bits: float = MIN_BITS, text: str = "text") -> DataFrame:
    """The rows with every found span replaced by ``mark``, overlapping spans by one; null texts stay null, repeated rows stay equal, an empty table gives an empty one."""
    others = [c for c in docs.columns if c != text]

    def start():
        def step(batch):
            column, out = batch.column(batch.schema.get_field_index("__text")), []
            for body, spans in _scan_batch(column, min_bits):
                whole = body.decode()
                if not spans:
                    out.append(whole)
                    continue
                parts, at = [], 0
                for _, a, b, _ in spans:
                    if a >= at:
                        parts += [whole[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, whole[at:]]))
            return [pa.array([None if n else x for n, x in zip(column.is_null().to_pylist(), out)], pa.string())]

        return step

    done = add_columns(docs.withColumnRenamed(text, "__text"), StructType([StructField(text, StringType())]), start)
    return done.select(*[F.col(c) for c in docs.columns]) if others else done.select(text)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
