"""What the pipeline's Python steps hold at once."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest import SF
from edges import docs, with_repeats

import corpus_pipeline
from medialake.llm import packing, queries
from medialake.llm.texts import PART

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def own_rows(spark):
    """The session's rows a batch, as they are without the pipeline, and again afterwards."""
    before = spark.conf.get(ROWS)
    spark.conf.unset(ROWS)
    yield
    spark.conf.set(ROWS, before)


def _largest_batch(spark) -> int:
    sizes = spark.range(0, 3 * PART, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    return max(r["n"] for r in sizes.collect())


def test_steps_get_small_batches(spark, own_rows):
    assert _largest_batch(spark) == 3 * PART
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        if name != "mixing":  # no Python step
            spark.conf.unset(ROWS)
            step(spark, frame, SF)
            assert _largest_batch(spark) <= PART, name
    spark.conf.set(ROWS, "100")
    corpus_pipeline.small_batches(spark)
    assert spark.conf.get(ROWS) == "100"


def test_ids_pass_one_python_step_before_they_are_written(spark, own_rows, monkeypatch):
    plans, write = [], packing.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(packing, "stage", seen)
    corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert [p.count("MapInArrow") for p in plans] == [1]


@pytest.mark.parametrize("keep_ids", [True, False])
def test_texts_are_packed_as_their_pieces(spark, keep_ids):
    frame, path = with_repeats(spark).repartition(5), queries.tokenizer_path()
    got = packing.pack_texts(frame, path, capacity=300, keep_ids=keep_ids)
    parts = packing.pieces(frame, path, capacity=300, keep_ids=keep_ids)
    assert got.columns == [*parts.columns, "sequence_id", "offset"] == packing.pack(parts, capacity=300).columns
    rows, columns = got.collect(), parts.columns
    assert Counter(tuple(str(r[c]) for c in columns) for r in rows) == Counter(tuple(str(r[c]) for c in columns) for r in parts.collect())
    per = defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
        assert not keep_ids or len(r["ids"]) == 4 * r["length"]
    for v in per.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 300
    assert len(per) == len({r["sequence_id"] for r in packing.pack(parts, capacity=300).collect()})
    assert packing.pack_texts(docs(spark, []), path, keep_ids=keep_ids).count() == 0
