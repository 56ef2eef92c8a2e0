"""Running values over ordered keys that stay parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(seq)`` is the best plan while every
key is small: one shuffle, shared by all windows on the same key. But it puts a
key into one task, so the size of the keys is checked first (``find_hot``):

* keys up to ``span`` rows use the plain window;
* a hot key is cut along its leading order column into *chunks* of ``span``.
  The window runs per (key, chunk); what a chunk needs from the chunks before it
  is one row per (key, chunk), built by a map-side combined aggregation and
  joined back on the clustering the window already has.

With a unique integer order (arrival number, plan index, sample index) a chunk
holds at most ``span`` rows of a key. The hot rows are written as a table in the
shared checkpoint folder before they are read for both purposes, so a chain of
running values costs one pass each and does not multiply its lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialake.functions.timing import idiv
from medialake.session import checkpoint_dir

CHUNK = "__chunk"
SEQ_SPAN = 1 << 20
SPAN_CONF = "spark.medialake.sequence.span"


def seq_span(spark: SparkSession) -> int:
    """Rows of one key that one task orders; ``spark.medialake.sequence.span`` overrides it."""
    return int(spark.conf.get(SPAN_CONF, str(SEQ_SPAN)))


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should order.

    ``rows`` lists them and is None when there are none; ``every`` says that all
    keys of the input are hot, as in the part :func:`by_heat` splits off.
    """

    keys: tuple[str, ...]
    rows: DataFrame | None = None
    every: bool = False

    def renamed(self, **names: str) -> HotKeys:
        """The same keys under other column names: ``hot.renamed(feed_id="broadcast_id")``."""
        keys = tuple(names.get(k, k) for k in self.keys)
        return HotKeys(keys, None if self.rows is None else self.rows.toDF(*keys), self.every)


def bounded(*keys: str) -> HotKeys:
    """States that the keys are known to be small, for instance one row per catalog version."""
    return HotKeys(keys)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Several readers then do not recompute it, each reads only its columns, and a
    lost executor costs nothing.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_hot(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys:
    """One aggregated pass over the key columns: the keys with more than ``limit`` rows.

    There are at most rows / limit of them, so the list stays small. Call it once
    on the source and pass the result to every operator keyed by those columns
    (and more): a finer key is never larger.
    """
    limit = limit or seq_span(df.sparkSession)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > limit).select(*keys)
    return HotKeys(tuple(keys), None if rows.isEmpty() else stage(rows))


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys); None where there are none."""
    if hot.every:
        return None, df
    if hot.rows is None:
        return df, None
    return df.join(hot.rows, list(hot.keys), "left_anti"), df.join(hot.rows, list(hot.keys), "left_semi")


def by_heat(df: DataFrame, hot: HotKeys, step: Callable[[DataFrame, HotKeys], DataFrame]) -> DataFrame:
    """Run a chain of ordered operators on the ordinary and on the hot rows apart, split once at its start."""
    cold, heavy = split_hot(df, hot)
    if heavy is None:
        return step(cold, bounded(*hot.keys))
    done = step(heavy, HotKeys(hot.keys, every=True))
    return done if cold is None else step(cold, bounded(*hot.keys)).unionByName(done)


@dataclass(frozen=True)
class Run:
    """One running value: ``kind`` is sum, max, min, last (non-null) or prev (row before)."""

    name: str
    kind: str
    value: Column
    exclusive: bool = False


def run_sum(name: str, value: Column, exclusive: bool = False) -> Run:
    return Run(name, "sum", value, exclusive)


def run_count(name: str, exclusive: bool = False) -> Run:
    return Run(name, "sum", F.lit(1).cast("bigint"), exclusive)


def run_max(name: str, value: Column, exclusive: bool = False) -> Run:
    return Run(name, "max", value, exclusive)


def run_min(name: str, value: Column, exclusive: bool = False) -> Run:
    return Run(name, "min", value, exclusive)


def run_last(name: str, value: Column, exclusive: bool = False) -> Run:
    return Run(name, "last", value, exclusive)


def prev_row(name: str, value: Column) -> Run:
    """The value of the row before, NULL on the first row of the key."""
    return Run(name, "prev", F.struct(value.alias("v")), True)


def _combine(kind: str, first: Column, second: Column) -> Column:
    if kind == "sum":
        return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))
    if kind == "max":
        return F.greatest(first, second)
    if kind == "min":
        return F.least(first, second)
    return F.coalesce(second, first)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _local(runs: list[Run], w, names: str) -> list[Column]:
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for i, r in enumerate(runs):
        if r.kind == "prev":
            c = F.lag(r.value).over(w)
        else:
            agg = _AGG[r.kind](r.value) if r.kind in _AGG else F.last(r.value, ignorenulls=True)
            c = agg.over(before if r.exclusive else upto)
        out.append(c.alias(f"{names}{i}"))
    return out


def _named(df: DataFrame, runs: list[Run], value) -> list[Column]:
    out = [F.col(c) for c in df.columns if c not in {r.name for r in runs}]
    for i, r in enumerate(runs):
        v = value(i, r)
        out.append((v["v"] if r.kind == "prev" else v).alias(r.name))
    return out


def _plain(df: DataFrame, keys: list[str], sort: list[Column], runs: list[Run]) -> DataFrame:
    d = df.select("*", *_local(runs, Window.partitionBy(*keys).orderBy(*sort), "__loc"))

    def value(i: int, r: Run) -> Column:
        c = F.col(f"__loc{i}")
        return F.coalesce(c, F.lit(0)) if r.kind == "sum" else c

    return d.select(*_named(df, runs, value))


def _chunked(df: DataFrame, keys: list[str], order: list[str], sort: list[Column], runs: list[Run],
             chunk: Column, reverse: bool) -> DataFrame:
    d = df.withColumn(CHUNK, chunk)
    by = [*keys, CHUNK]
    rows = d.select("*", *_local(runs, Window.partitionBy(*by).orderBy(*sort), "__loc"))
    where = F.struct(*order) if len(order) > 1 else F.col(order[0])
    pick = F.min_by if reverse else F.max_by
    totals = [
        (_AGG[r.kind](r.value) if r.kind in _AGG else pick(r.value, F.when(r.value.isNotNull(), where))).alias(f"__tot{i}")
        for i, r in enumerate(runs)
    ]
    kw = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc())
    prior = kw.rowsBetween(Window.unboundedPreceding, -1)
    carried = [
        (_AGG[r.kind](F.col(f"__tot{i}")) if r.kind in _AGG else F.last(f"__tot{i}", ignorenulls=True)).over(prior).alias(f"__car{i}")
        for i, r in enumerate(runs)
    ]
    carry = d.groupBy(*by).agg(*totals).select(*by, *carried)
    joined = rows.join(carry, by)
    return joined.select(*_named(df, runs, lambda i, r: _combine(r.kind, F.col(f"__car{i}"), F.col(f"__loc{i}"))))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    runs: list[Run],
    *,
    span: int | None = None,
    chunk: Column | None = None,
    reverse: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the running values of ``runs`` per ``keys`` in ``order``.

    ``order`` must identify a row within its key; its first column is BIGINT and
    is cut into chunks of ``span``, or pass ``chunk`` as any expression that never
    decreases along the order. ``reverse`` runs from the end. Key columns must
    not be NULL. ``hot`` is a :func:`find_hot` result on a subset of ``keys``;
    without it the keys of ``df`` are checked here.
    """
    if hot is None:
        hot = find_hot(df, keys)
    if not set(hot.keys) <= set(keys):
        raise ValueError(f"hot keys {hot.keys} are not among {keys}")
    sort = [F.col(o).desc() if reverse else F.col(o).asc() for o in order]
    cut = chunk if chunk is not None else idiv(order[0], span or seq_span(df.sparkSession))

    def run(part: DataFrame, heat: HotKeys) -> DataFrame:
        if heat.every:
            return _chunked(stage(part), keys, order, sort, runs, cut, reverse)
        return _plain(part, keys, sort, runs)

    return by_heat(df, hot, run)


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str, **kw) -> DataFrame:
    """0-based position of each row within its key."""
    return running(df, keys, order, [run_count(name, exclusive=True)], **kw)


def with_key_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column], hot: HotKeys | None = None) -> DataFrame:
    """Attach per-key aggregates: a window for ordinary keys, aggregation and join for hot ones."""
    if hot is None:
        hot = find_hot(df, keys)

    def run(part: DataFrame, heat: HotKeys) -> DataFrame:
        if heat.every:
            part = stage(part)
            return part.join(part.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys).select(*part.columns, *aggs)
        w = Window.partitionBy(*keys)
        return part.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])

    return by_heat(df, hot, run)


def ordered_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    *,
    name: str = "items",
    max_items: int = 10000,
    **kw,
) -> DataFrame:
    """Lists of ``item`` in order, per key and part.

    A part holds at most ``max_items`` items, so a hot key becomes many rows
    (``part_index`` 0, 1, ...) and no task gathers a whole key.
    """
    numbered = row_index(df, keys, order, "__pos", **kw)
    return (
        numbered.select(
            *keys,
            idiv("__pos", max_items).alias("part_index"),
            F.struct(F.col("__pos"), item.alias("__item")).alias("__e"),
        )
        .groupBy(*keys, "part_index")
        .agg(F.sort_array(F.collect_list("__e")).alias("__list"))
        .select(*keys, "part_index", F.transform("__list", lambda e: e["__item"]).alias(name))
    )

