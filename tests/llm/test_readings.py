"""Readings of words in the toxicity operator are computed once a task, with the same values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from medialake.llm import toxicity
from medialake.llm.texts import slices


def _sentences(reader, texts):
    (t,) = slices(pa.array(texts))
    return reader.sentences(t)


def test_far_readings_are_compared_once(monkeypatch):
    seen, kernel = [], toxicity.Landmarks.kernel

    def counted(self, data, start, end, least=0.0):
        seen.extend(data[a:e].tobytes() for a, e in zip(start.tolist(), end.tolist()))
        return kernel(self, data, start, end, least)

    monkeypatch.setattr(toxicity.Landmarks, "kernel", counted)
    reader = toxicity.Reader(toxicity.Landmarks([b"moron", b"scoundrel"]))
    texts = ["gardens, gardens; gardens! (gardens) gardens", "m.o.r.o.n, moron! you mo-ron gardens?"]
    first = _sentences(reader, texts)
    assert len(seen) == len(set(seen)) and b"gardens" in seen
    seen.clear()
    again = _sentences(reader, ['"gardens" gardens:', *texts])
    assert b"gardens" not in seen  # in another slice too
    for got in (first, again):
        assert got[0].max(0)[0] == 1.0
    assert np.array_equal(first[0], again[0]) and np.array_equal(first[1] + 1, again[1])
    alone = [_sentences(toxicity.Reader(reader.landmarks), [w]) for w in ("m.o.r.o.n, moron! you mo-ron gardens?",)]
    assert np.array_equal(alone[0][0], first[0])
