"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a fixed sparse ternary index vector (by its hash and its shape); a
word's context vector is the sum of the index vectors around it over the whole
corpus, counted in tasks into a table of fixed size and summed by Spark. The
vectors of a document's words are pooled to their mean and spread, and a
two-layer network with a temperature fitted on documents it did not learn from
gives the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from medialake.llm.tables import labelled
from medialake.llm.texts import Texts, add_columns, slices

BUCKETS, DIM, NONZERO = 1 << 13, 32, 4
SHAPES = 256
WINDOW = 2
FIT_ROWS = 20_000
HIDDEN = 32

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _index(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: ``NONZERO`` entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.int32)
    at = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int32), (n, NONZERO)), 1)
    return out


_WORD_INDEX, _SHAPE_INDEX = _index(BUCKETS, 11), _index(SHAPES, 12)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, index vector, text) of the runs of letters, digits and other signs; shape is kind, capitals, first sign and length."""
    kind = _KIND[t.data]
    start, end, owner = t.runs(kind)
    bucket = (t.hashes(start, end) >> np.uint64(51)).astype(np.int64)
    size = end - start
    capitals = np.concatenate(([0], np.cumsum((t.data >= 65) & (t.data <= 90))))
    upper = capitals[end] - capitals[start]
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 2, 1))
    k = kind[start].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    shape = np.where(k == 3, (t.data[start] % 32 if len(start) else k) + 32 * np.minimum(size, 3), 128 + 32 * (k - 1) + 8 * case + np.minimum(size // 2, 7))
    return bucket, _WORD_INDEX[bucket] + _SHAPE_INDEX[shape % SHAPES], owner


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of the word buckets, over all rows of ``docs`` (``text``)."""

    def count(batches):
        table = np.zeros((BUCKETS, DIM), np.int64)
        for b in batches:
            for t in slices(b.column(b.schema.get_field_index("text"))):
                bucket, index, owner = tokens(t)
                if not len(bucket):
                    continue
                near = np.zeros_like(index)
                for d in range(1, WINDOW + 1):
                    same = (owner[d:] == owner[:-d])[:, None]
                    near[d:] += index[:-d] * same
                    near[:-d] += index[d:] * same
                order = np.argsort(bucket, kind="stable")
                s = bucket[order]
                head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                table[s[head]] += np.add.reduceat(near[order], head, axis=0)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(table[at, k]) for k in range(DIM)]], names=["bucket", *[f"d{k}" for k in range(DIM)]])

    schema = "bucket int, " + ", ".join(f"d{k} long" for k in range(DIM))
    sums = docs.select("text").mapInArrow(count, schema).groupBy("bucket").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)]).toPandas()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM), np.float32)
    out[sums["bucket"]] = sums[[f"d{k}" for k in range(DIM)]].to_numpy(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(t: Texts, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its words' vectors, mean index vector and its length, agreement of neighbours, log of the number of words."""
    n = len(t)
    bucket, index, owner = tokens(t)
    out = np.zeros((n, 3 * DIM + 4), np.float32)
    count = np.bincount(owner, minlength=n)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    head = np.searchsorted(owner, full)
    c = count[full][:, None]
    v = vectors[bucket]
    mean = np.add.reduceat(v, head, axis=0) / c
    out[full, :DIM] = mean
    out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, head, axis=0) / c - mean**2, 0))
    own = np.add.reduceat(index, head, axis=0) / c
    out[full, 2 * DIM : 3 * DIM] = own
    out[full, -4] = np.linalg.norm(own, axis=1)
    same = owner[1:] == owner[:-1]
    pairs = np.maximum(np.bincount(owner[1:][same], minlength=n), 1)
    out[:, -3] = np.bincount(owner[1:][same], (v[1:] * v[:-1]).sum(1)[same], n) / pairs
    again = (bucket[1:] == bucket[:-1]) & same
    out[:, -2] = np.bincount(owner[1:][again], minlength=n) / pairs
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = _logit(self.layers, (x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(layers, x):
    w1, b1, w2, b2 = layers
    return (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]


def train(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 40) -> tuple:
    """Two layers by Adam on the log loss with weight decay."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at : at + 128]
            a = x[i] @ w[0] + w[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            g = (p - y[i, None]) / len(i)
            back = (g @ w[2].T) * (a > 0)
            step += 1
            for k, d in enumerate((x[i].T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the lowest log loss."""
    options = np.exp(np.linspace(-1.5, 2.0, 71))
    sign = np.where(y > 0, -logit, logit)
    return float(options[np.argmin([np.logaddexp(0, sign / t).mean() for t in options])]) if len(y) else 1.0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """A model from all texts of ``docs`` (vectors) and at most ``fit_rows`` rows of ``labels`` (network and temperature).

    With no labels the probability is 0.5; a fifth of the sample, by hash, is kept for the temperature.
    """
    vectors = context_vectors(docs)
    sample = labelled(docs, labels, label, fit_rows)
    got = _featured(sample, vectors).select("label", "__x", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part")).toPandas()  # fit_rows rows at most
    width = 3 * DIM + 4
    if not len(got):
        return Model(vectors, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)), 1.0)
    x, y = np.stack(got["__x"].to_numpy()).astype(np.float64), got["label"].to_numpy(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = (x - mean) / scale
    apart = got["part"].to_numpy() == 0
    layers = train(x[~apart], y[~apart]) if (~apart).any() else train(x, y)
    return Model(vectors, mean, scale, layers, temperature(_logit(layers, x[apart]), y[apart]))


def _featured(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM

    def start():
        def step(batch):
            parts = [pooled(t, shared.value) for t in slices(batch.column(batch.schema.get_field_index("text")))]
            x = np.concatenate(parts)
            return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))]

        return step

    return add_columns(docs, StructType([StructField("__x", ArrayType(FloatType()))]), start)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score``, the probability of label 1. Null and empty texts are scored as texts without words. Repeated rows are scored alike; an empty table gives an empty one. A column ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def step(batch):
            parts = [shared.value.probability(pooled(t, shared.value.vectors)) for t in slices(batch.column(batch.schema.get_field_index(text)))]
            return [pa.array(np.concatenate(parts).astype(np.float64))]

        return step

    return add_columns(docs, StructType([StructField("score", DoubleType())]), start)
