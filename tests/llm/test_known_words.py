"""The toxicity operator compares a word once a worker, and exactly only where a bound lets it be near a landmark."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from edges import docs

from medialake.llm import toxicity
from medialake.llm.texts import slices

MARKS = [b"moron", b"scoundrel", b"dimwit", b"blockhead", b"moronic", b"m0ron"]


def _ranges(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])), ends


def _words():
    rng = random.Random(3)
    near = ["".join(c + rng.choice(["", "", "", "x", "."]) for c in w.decode()) for w in MARKS for _ in range(30)]
    far = ["".join(rng.choice("abcdeghiklmnorstuw-é5") for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    return sorted({w.encode() for w in [*near, *far, "x" * 3000]})


def _compared(monkeypatch, name="kernel"):
    """All ranges that a method of ``Landmarks`` gets from now on."""
    seen, method = [], getattr(toxicity.Landmarks, name)

    def counted(self, data, start, end, *least):
        seen.extend(data[a:e].tobytes() for a, e in zip(start.tolist(), end.tolist()))
        return method(self, data, start, end, *least)

    monkeypatch.setattr(toxicity.Landmarks, name, counted)
    return seen


@pytest.mark.parametrize("groups", [1, 3, 32])
def test_only_ranges_that_a_bound_lets_through_are_computed(monkeypatch, groups):
    monkeypatch.setattr(toxicity, "GROUPS", groups)
    words, triples, computed = _words(), toxicity.triples, []
    marks = toxicity.Landmarks(MARKS)
    whole = marks.kernel(*_ranges(words))
    assert (marks.reach(*_ranges(words)) >= whole.max(1)).all()
    monkeypatch.setattr(toxicity, "triples", lambda data, start, end: computed.append(len(start)) or triples(data, start, end))
    some = marks.kernel(*_ranges(words), toxicity.NEAR)
    near = whole.max(1) >= toxicity.NEAR
    assert np.array_equal(some[near], whole[near]) and (some[~near].max(1) < toxicity.NEAR).all()
    assert near.sum() <= sum(computed) < len(words) // 2


def test_highest_of_runs():
    rng = np.random.default_rng(5)
    values, count = rng.random((50, 4), dtype=np.float32), np.array([1, 3, 1, 40, 2, 3])
    row = rng.integers(0, 50, count.sum())
    head = np.cumsum(count) - count
    assert np.array_equal(toxicity.highest(values, row, head), np.maximum.reduceat(values[row], head, axis=0))


def test_near_words_are_compared_once(monkeypatch):
    reader, seen = toxicity.Reader(toxicity.Landmarks(MARKS)), _compared(monkeypatch)
    (t,) = slices(pa.array(["you mo-ron, scoundrel! dimwit gardens?", "moron"]))
    first = reader.sentences(t)
    assert b"scoundrel" in seen
    seen.clear()
    again = reader.sentences(t)
    assert not seen and all(np.array_equal(a, b) for a, b in zip(first, again))


@pytest.mark.parametrize("kept", [1, 2, 7, 10_000])
def test_words_kept_do_not_change_values(monkeypatch, kept):
    monkeypatch.setattr(toxicity, "KEPT", kept)
    monkeypatch.setattr(toxicity, "KNOWN", kept)
    rng, words = random.Random(8), [w.decode("latin-1") for w in _words()]
    reader = toxicity.Reader(toxicity.Landmarks(MARKS))
    for _ in range(6):
        (t,) = slices(pa.array([" ".join(rng.sample(words, 60)) + "." for _ in range(4)]))
        got, alone = reader.sentences(t), toxicity.Reader(reader.landmarks).sentences(t)
        assert all(np.array_equal(a, b) for a, b in zip(got, alone))


def test_tasks_of_a_worker_share_known_words(spark, monkeypatch):
    started = []
    monkeypatch.setattr(toxicity, "add_columns", lambda df, new, start: started.append(start) or df)
    marks = toxicity.Landmarks(MARKS)
    k = len(MARKS)
    toxicity.score(docs(spark, []), toxicity.Model(marks, np.eye(k), np.ones(k), -1.0, np.array([1.0, 0.0, 0.0, 0.0])))
    batch = pa.RecordBatch.from_pydict({"text": ["you mo-ron in the gardens", "a river", None]})
    seen = _compared(monkeypatch)
    (one,) = started[0]()(batch)
    assert b"gardens" in seen
    seen.clear()
    (two,) = started[0]()(batch)  # another task
    assert not seen and one.equals(two)
