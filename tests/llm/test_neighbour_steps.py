"""The neighbour search looks for a query's last step where others ended, and its groups are dealt out evenly."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import neighbours


def _block(n=600, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    return np.arange(n), rng.normal(0, 1, (n, dim))


def _widened(index, query, enough):
    """The vectors that collide, by one window after the other on values."""
    unit = query / np.abs(query).max()
    at = np.append(unit / np.linalg.norm(unit), 0) @ index.axes
    values = np.take_along_axis(index.sorted, index.place.astype(np.int64), 1)
    half, step = neighbours.WIDTH, 0
    while True:
        inside = (values >= (at - half)[:, None]) & (values <= (at + half)[:, None])
        near = np.flatnonzero(inside.sum(0) >= round(neighbours.THRESHOLD * neighbours.PROJECTIONS))
        if len(near) >= enough or inside.all():
            return near, step
        half, step = half * neighbours.WIDER, step + 1


@pytest.mark.parametrize("enough", [1, 93, 600])
def test_the_first_step_does_not_change_what_collides(enough):
    ids, x = _block()
    index = neighbours.Index(ids, x)
    want = [_widened(index, q, enough) for q in x[:40]]
    for start in (0, 1, 3, 30):
        near, step = index.collided(x[:40], enough, start)
        assert step.tolist() == [s for _, s in want] and all(np.array_equal(a, b) for a, (b, _) in zip(near, want))


def test_queries_begin_where_others_ended(monkeypatch):
    ids, x = _block(2000)
    starts, collided = [], neighbours.Index.collided

    def seen(self, queries, enough, start):
        near, step = collided(self, queries, enough, start)
        starts.append((start, np.median(step)))
        return near, step

    monkeypatch.setattr(neighbours.Index, "collided", seen)
    monkeypatch.setattr(neighbours, "TILE", 50)
    found = neighbours.Index(ids, x).search(ids[:200], x[:200], 5)
    assert len(found) == 200 and [s for s, _ in starts[1:]] == [max(m - 1, 0) for _, m in starts[:-1]] and starts[1][0] > 0


@pytest.mark.parametrize("size", [1.0, 1e-160, 1e-310, 1e160])
def test_rounding_of_the_matrix_product_leaves_none_out(size):
    ids, x = _block()
    x[100:300] = x[0] * (1 + np.arange(200) % 7 * 2.0**-52)[:, None]  # equal but for the last bits
    index, x = neighbours.Index(ids, x * size), x * size
    near = [np.arange(0, 600, 1 + i % 3) for i in range(20)]
    with np.errstate(over="ignore", invalid="ignore"):
        for (got, score), at, key, query in zip(index.best(ids[:20], x[:20], near, 9), near, ids, x):
            at = np.union1d(at, index.long)
            at = at[at != key]
            exact = neighbours.exact(x[at], query)
            order = np.lexsort((at, -exact))[:9]
            assert np.array_equal(got, at[order]) and np.array_equal(score, exact[order], equal_nan=True)


def _table(spark, kind="double"):
    ids, x = _block(400, 8, 2)
    x = x.astype(np.float32).astype(float)
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_strips_and_floats_do_not_change_results(spark, monkeypatch):
    df, got = _table(spark), []
    for strip, kind in ((1, "double"), (3, "double"), (3, "float")):
        monkeypatch.setattr(neighbours, "STRIP", strip)
        monkeypatch.setattr(neighbours, "GROUPS", 1)
        part = _table(spark, kind)
        got.append(_rows(neighbours.nearest(part, part.where("vec_id % 20 = 0"), k=9, block=20)))
    assert got[0] == got[1] == got[2] and len(got[0]) == 180
    assert neighbours.usable(_table(spark, "float"), "vec_id", "embedding").schema["v"].dataType.simpleString() == "array<float>"
    assert neighbours.usable(df, "vec_id", "embedding").schema["v"].dataType.simpleString() == "array<double>"


def test_groups_are_dealt_out_by_number(spark):
    df = _table(spark)
    plan = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=9, block=20)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(dim" in line]
    # 20 blocks of vectors and one of queries; Spark neither shuffles them again nor merges partitions by their bytes
    assert len(dealt) == 2 and all(", 80)" in line and "REPARTITION_BY_NUM" in line for line in dealt)
