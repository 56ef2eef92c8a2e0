"""Row expansion: run lengths, chunk maps, loop replay, sync marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators.ordered import run_last, run_sum, running
from medialake.operators.rollup import loop_span, track_group_span

PIECE = 10000  # rows one array of an expansion may hold


def _zero():
    return F.lit(0).cast("bigint")


def explode_count(df: DataFrame, count: str, name: str) -> DataFrame:
    """Rows 0..count-1 of each row, in two steps so that no array grows with ``count``."""
    d = df.where(F.col(count) > 0).withColumn(
        "__piece", F.explode(F.sequence(_zero(), F.col(count) - 1, F.lit(PIECE).cast("bigint"))))
    last = F.least(F.col("__piece") + (PIECE - 1), F.col(count) - 1)
    return d.withColumn(name, F.explode(F.sequence(F.col("__piece"), last))).drop("__piece")


def expand_runs(runs: DataFrame, keys: list[str] | None = None, sample_counts: DataFrame | None = None,
                order: str = "run_index", **kw) -> DataFrame:
    """(run_count, value) rows to one row per sample with its index.

    With ``sample_counts`` (keys, sample_count) samples past the count are cut
    and missing ones get value 0.
    """
    keys = keys or ["asset_id"]
    placed = running(runs, keys, [order], [run_sum("__first", F.col("run_count"), exclusive=True)], **kw)
    rows = explode_count(placed.select(*keys, "__first", "run_count", "value"), "run_count", "__i").select(
        *keys, (F.col("__first") + F.col("__i")).alias("sample_index"), "value")
    if sample_counts is None:
        return rows
    total = runs.groupBy(*keys).agg(F.sum("run_count").alias("__have"))
    short = (
        sample_counts.join(total, keys, "left")
        .withColumns({"__have": F.coalesce("__have", _zero())})
        .withColumn("__missing", F.col("sample_count") - F.col("__have"))
    )
    fill = explode_count(short, "__missing", "__i").select(
        *keys, (F.col("__have") + F.col("__i")).alias("sample_index"), _zero().alias("value"))
    kept = rows.join(sample_counts.select(*keys, "sample_count"), keys).where("sample_index < sample_count").drop("sample_count")
    return kept.unionByName(fill)


def sample_offsets(chunks: DataFrame, chunk_map: DataFrame, sizes: DataFrame, asset: str = "asset_id", **kw) -> tuple[DataFrame, DataFrame]:
    """File offset of each sample, and per asset whether the chunks cover its samples exactly.

    ``chunks``: asset, chunk_index (from 1), chunk_offset. ``chunk_map``: asset,
    first_chunk, samples_per_chunk. ``sizes``: asset, sample_index, size.
    """
    key = [asset]
    points = chunks.select(asset, F.col("chunk_index").alias("__at"), "chunk_offset", F.lit(1).alias("__side")).unionByName(
        chunk_map.select(asset, F.col("first_chunk").alias("__at"), "samples_per_chunk", F.lit(0).alias("__side")),
        allowMissingColumns=True)
    d = running(points, key, ["__at", "__side"], [run_last("__per", F.col("samples_per_chunk"))], **kw)
    d = d.where("__side = 1").withColumn("__per", F.coalesce("__per", _zero()))
    d = running(d, key, ["__at"], [run_sum("__first", F.col("__per"), exclusive=True)], **kw)
    placed = explode_count(d.select(asset, F.col("__at").alias("chunk_index"), "chunk_offset", "__first", "__per"), "__per", "__i")
    placed = placed.select(asset, "chunk_index", "chunk_offset", (F.col("__first") + F.col("__i")).alias("sample_index"))
    sized = placed.join(sizes.select(asset, "sample_index", "size"), [asset, "sample_index"])
    rows = running(sized, [asset, "chunk_index"], ["sample_index"], [run_sum("__before", F.col("size"), exclusive=True)], **kw)
    offsets = rows.select(asset, "chunk_index", "sample_index", "size", (F.col("chunk_offset") + F.col("__before")).alias("sample_offset"))
    need = d.groupBy(asset).agg(F.sum("__per").alias("mapped_samples"))
    have = sizes.groupBy(asset).agg(F.count(F.lit(1)).alias("sample_count"))
    cover = have.join(need, key, "left").select(
        asset, "sample_count", F.coalesce("mapped_samples", _zero()).alias("mapped_samples"),
        (F.coalesce("mapped_samples", _zero()) >= F.col("sample_count")).alias("covered"))
    return offsets, cover


def replay(objects: DataFrame, cycles: int, broadcast: str = "broadcast_id") -> DataFrame:
    """Repeat a plan: later cycles shift groups by the track's span and times by the cycle length."""
    spans = track_group_span(objects, broadcast).select(broadcast, "track_name", "group_span")
    plan = loop_span(objects, broadcast).select(broadcast, "cycle_us")
    d = objects.join(spans, [broadcast, "track_name"]).join(plan, [broadcast])
    d = d.withColumn("cycle", F.explode(F.sequence(_zero(), F.lit(cycles - 1).cast("bigint"))))
    d = d.where((F.col("kind") != "initialization") | (F.col("cycle") == 0))
    return d.withColumns({
        "group_id": F.col("group_id") + F.col("group_span") * F.col("cycle"),
        "media_time_us": F.col("media_time_us") + F.col("cycle_us") * F.col("cycle"),
    }).drop("group_span", "cycle_us")


def mark_sync(samples: DataFrame, sync_list: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sync flag from 1-based sync numbers; tracks without a list are sync unless video."""
    keys = keys or ["asset_id"]
    listed = sync_list.select(*keys, (F.col("sync_number") - 1).alias("sample_index")).distinct().withColumn("__hit", F.lit(True))
    has = sync_list.select(*keys).distinct().withColumn("__listed", F.lit(True))
    d = samples.join(has, keys, "left").join(listed, [*keys, "sample_index"], "left")
    flag = F.when(F.col("__listed"), F.coalesce("__hit", F.lit(False))).otherwise(F.col("handler_type") != "vide")
    return d.withColumn("sync", flag).drop("__hit", "__listed")

