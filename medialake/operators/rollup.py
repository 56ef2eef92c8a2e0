"""Aggregations. Everything groups with map-side partial aggregates before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions.timing import idiv, round_millis, sap_type, ticks_to_micros
from medialake.operators.ordered import ordered_parts, prev_row, row_index, running, with_key_totals


def publish_stats(objects: DataFrame, by: list[str] | None = None, track: list[str] | None = None) -> DataFrame:
    """Bytes, objects and distinct (track, group) pairs.

    The pairs are reduced first, so the distinct count is a plain sum afterwards
    and one hot ``by`` value never gathers its rows in one task.
    """
    by = by or []
    pair = [*(track or ["broadcast_id", "track_name"]), "group_id"]
    per_pair = objects.groupBy(*dict.fromkeys([*by, *pair])).agg(
        F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("objects"))
    return per_pair.groupBy(*by).agg(
        F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"), F.count(F.lit(1)).alias("groups"))


def live_stats(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index", **kw) -> DataFrame:
    """As :func:`publish_stats` per broadcast, counting group changes in send order."""
    d = running(objects, [broadcast, "track_name"], [seq], [prev_row("__prev", F.col("group_id"))], **kw)
    change = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("group_id")), 1).otherwise(0)
    return d.groupBy(broadcast).agg(
        F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("objects"),
        F.sum(change).cast("bigint").alias("groups"))


def track_heads(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index", **kw) -> DataFrame:
    """Largest (group, object) per track and the track's alias in order of first appearance."""
    heads = objects.groupBy(broadcast, "track_name").agg(
        F.max(F.struct("group_id", "object_id")).alias("__head"), F.min(seq).alias("first_index"))
    d = row_index(heads, [broadcast], ["first_index"], "__alias", **kw)
    return d.select(broadcast, "track_name", "first_index",
                    F.col("__head.group_id").alias("head_group"), F.col("__head.object_id").alias("head_object"),
                    F.col("__alias").alias("track_alias"))


def sap_maxima(frags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return frags.groupBy(*(keys or ["broadcast_id", "track_name"])).agg(
        F.max("sap_type").alias("max_object_sap"),
        F.coalesce(F.max(F.when(F.col("object_id") == 0, F.col("sap_type"))),
                   F.when(F.max("sap_type").isNotNull(), F.lit(0))).alias("max_group_sap"))


def measured_bitrate(objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    d = objects.groupBy(*(keys or ["broadcast_id", "track_name"])).agg(
        F.sum("payload_bytes").alias("__bytes"), F.sum("media_duration_us").alias("__us"))
    rate = idiv(F.col("__bytes") * 8 * 1000000, F.when(F.col("__us") > 0, F.col("__us")))
    return d.withColumn("measured_bitrate", F.coalesce(rate, F.lit(0).cast("bigint"))).drop("__bytes", "__us")


def group_bounds(objects: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    """Start and end flags of each object in its (track, group)."""
    keys = keys or ["broadcast_id", "track_name", "group_id"]
    d = with_key_totals(objects, keys, {"__last": F.max("object_id")}, **kw)
    return d.withColumns({
        "starts_group": F.col("object_id") == 0,
        "ends_group": F.col("object_id") == F.col("__last"),
    }).drop("__last")


def rollup_fragments(samples: DataFrame, keys: list[str], seq: str = "sample_index") -> DataFrame:
    """Samples to fragments: total duration, least presentation time, SAP of the first sample.

    ``samples``: keys, handler_type, timescale, base_decode_time, decode_time,
    duration, composition_offset, flags. A row with NULL ``decode_time`` stands for
    a fragment without samples and falls back to the base time.
    """
    pres = F.when(F.col("decode_time").isNotNull(),
                  F.greatest(F.col("decode_time") + F.col("composition_offset"), F.lit(0).cast("bigint")))
    d = samples.groupBy(*keys, "handler_type", "timescale").agg(
        F.min("base_decode_time").alias("base_decode_time"),
        F.coalesce(F.sum("duration"), F.lit(0)).cast("bigint").alias("duration"),
        F.min(pres).alias("__pres"),
        F.min_by("flags", seq).alias("__flags"))
    return d.select(
        *keys, "handler_type",
        ticks_to_micros("base_decode_time", "timescale").alias("start_time_us"),
        ticks_to_micros("duration", "timescale").alias("duration_us"),
        ticks_to_micros(F.coalesce("__pres", "base_decode_time"), "timescale").alias("earliest_presentation_time_us"),
        sap_type("handler_type", F.coalesce("__flags", F.lit(0))).alias("sap_type"))


def frame_rate(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Frames per second over run-length durations; 0 when empty."""
    d = runs.groupBy(*(keys or ["asset_id"])).agg(
        F.sum("run_count").alias("__n"), F.sum(F.col("run_count") * F.col("value")).alias("__ticks"),
        F.max("timescale").alias("__scale"))
    rate = F.col("__n").cast("double") * F.col("__scale").cast("double") / F.when(F.col("__ticks") > 0, F.col("__ticks")).cast("double")
    return d.withColumn("frame_rate", F.coalesce(rate, F.lit(0.0))).drop("__n", "__ticks", "__scale")


def track_group_span(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index") -> DataFrame:
    """Per track: groups one loop cycle takes, first index that loops, whether the track loops at all."""
    body = F.col("kind") != "initialization"
    return objects.groupBy(broadcast, "track_name").agg(
        (F.max("group_id") + 1).alias("group_span"), F.min(F.when(body, F.col(seq))).alias("first_body_index"), F.max(body).alias("loopable"))


def loop_span(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index") -> DataFrame:
    """Per plan: media end time, first index after initialization, whether it can loop."""
    media = F.col("kind") == "media"
    body = F.col("kind") != "initialization"
    return objects.groupBy(broadcast).agg(
        F.coalesce(F.max(F.when(media, F.col("media_time_us") + F.col("media_duration_us"))), F.lit(0)).cast("bigint").alias("cycle_us"),
        F.min(F.when(body, F.col(seq))).alias("first_body_index"),
        F.max(body).alias("loopable"))


def media_timeline(frags: DataFrame, asset: str = "broadcast_id", time: str = "media_time_us") -> DataFrame:
    """Distinct (milliseconds, group, object) entries, one row each."""
    return frags.select(asset, round_millis(time).alias("time_ms"), "group_id", "object_id").distinct()


def media_timeline_text(frags: DataFrame, asset: str = "broadcast_id", time: str = "media_time_us",
                        max_items: int = 10000, span_ms: int = 600_000, **kw) -> DataFrame:
    """The timeline as JSON arrays ``[[ms,[group,object],0],...]`` in parts of bounded size."""
    entry = F.format_string("[%d,[%d,%d],0]", "time_ms", "group_id", "object_id")
    parts = ordered_parts(media_timeline(frags, asset, time), [asset], ["time_ms", "group_id", "object_id"], entry,
                          max_items=max_items, span=span_ms, **kw)
    return parts.select(asset, "part_index", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")).alias("timeline"))


def sap_timeline(frags: DataFrame, keys: list[str] | None = None, seq: str = "plan_index",
                 ept: str = "earliest_presentation_time_us", max_items: int = 10000, **kw) -> DataFrame:
    """Per track, in plan order, ``{"l":[group,object],"data":[sap,ms]}`` arrays in bounded parts."""
    keys = keys or ["broadcast_id", "track_name"]
    known = frags.where(F.col("sap_type").isNotNull()).withColumn("__ms", round_millis(ept))
    entry = F.format_string('{"l":[%d,%d],"data":[%d,%d]}', "group_id", "object_id", F.col("sap_type").cast("bigint"), "__ms")
    parts = ordered_parts(known, keys, [seq], entry, max_items=max_items, **kw)
    return parts.select(*keys, "part_index", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")).alias("timeline"))


def protection_entries(refs: DataFrame, asset: str = "asset_id", **kw) -> DataFrame:
    """One entry per (system, scheme), ranked by first appearance; ``refs`` carry track_seq and system_seq."""
    first = F.struct("track_seq", "system_seq")
    d = refs.groupBy(asset, "system_id", "scheme").agg(
        F.min(first).alias("__first"), F.min_by("pssh", first).alias("pssh"))
    d = d.withColumns({"__t": F.col("__first.track_seq"), "__s": F.col("__first.system_seq")})
    d = row_index(d, [asset], ["__t", "__s", "system_id", "scheme"], "__rank", **kw)
    return d.select(asset, "system_id", "scheme", "pssh", (F.col("__rank") + 1).cast("string").alias("ref_id"))


def protection_kids(refs: DataFrame, asset: str = "asset_id", **kw) -> DataFrame:
    """Key ids of each (system, scheme), unique, one row each with its first-seen position."""
    keys = [asset, "system_id", "scheme"]
    d = refs.groupBy(*keys, "kid").agg(F.min("track_seq").alias("__t"))
    return row_index(d, keys, ["__t", "kid"], "kid_index", **kw).drop("__t")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def track_summary(tracks: DataFrame, asset: str = "asset_id", order: str = "track_id", max_items: int = 10000, **kw) -> DataFrame:
    """``name(handler:codec)`` joined by ``, `` in track order, in bounded parts."""
    item = F.concat("track_name", F.lit("("), "handler_type", F.lit(":"), "codec", F.lit(")"))
    parts = ordered_parts(tracks, [asset], [order], item, max_items=max_items, **kw)
    return parts.select(asset, "part_index", F.array_join("items", ", ").alias("summary"))


def streams_per_subscription(served: DataFrame, request: str = "request_id") -> DataFrame:
    """Distinct (group, subgroup) streams of each subscription, reduced in two steps."""
    pairs = served.groupBy(request, "group_id", "subgroup_id").agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(request).agg(F.count(F.lit(1)).alias("streams"), F.sum("__n").alias("objects"))


def pacing_rows(sends: DataFrame, broadcast: str = "broadcast_id", seq: str = "send_seq", sent: str = "send_time_us",
                time: str = "media_time_us") -> DataFrame:
    """Target time and lateness of each media send.

    Pacing starts with a broadcast's first media object; a target is the media
    time since then, not below 0.
    """
    media = sends.where("kind = 'media'")
    start = media.groupBy(broadcast).agg(F.min_by(F.struct(F.col(sent).alias("at"), F.col(time).alias("media")), seq).alias("__start"))
    d = media.join(start, [broadcast])
    target = F.col("__start.at") + F.greatest(F.col(time) - F.col("__start.media"), F.lit(0).cast("bigint"))
    return d.withColumns({
        "target_ms": idiv(target, 1000), "now_ms": idiv(F.col(sent), 1000), "delta_ms": idiv(F.col(sent) - target, 1000),
    }).drop("__start")


def pacing_report(trace: DataFrame, by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Lateness of paced sends per track and phase.

    ``exact`` uses exact percentiles on values first counted per key, so the
    per-key state holds distinct lateness values, not rows.
    """
    by = by or ["track", "event"]
    paced = trace.where(F.col("event").isin("pacing_before", "pacing_after"))
    counted = paced.groupBy(*by, "delta_ms").agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    p95 = (F.percentile("delta_ms", F.lit(0.95), n) if exact
           else F.percentile_approx(F.col("delta_ms"), 0.95, 10000).cast("double"))
    src = counted if exact else paced.withColumn("__n", F.lit(1).cast("bigint"))
    return src.groupBy(*by).agg(
        F.sum(n).alias("sends"), F.min("delta_ms").alias("min_delta_ms"), F.max("delta_ms").alias("max_delta_ms"),
        (F.sum(F.col("delta_ms") * n) / F.sum(n)).alias("avg_delta_ms"), p95.alias("p95_delta_ms"),
        (F.sum(F.when(F.col("delta_ms") > 0, n).otherwise(0)) / F.sum(n)).alias("late_share"))


def wire_overhead(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    return trace.where("event = 'enqueue'").groupBy(*(by or ["track"])).agg(
        F.sum("payload_bytes").alias("payload_bytes"), F.sum("wire_bytes").alias("wire_bytes"),
        (F.sum("wire_bytes") - F.sum("payload_bytes")).alias("overhead_bytes"),
        F.sum("opened").cast("bigint").alias("streams"), F.sum("fin").cast("bigint").alias("fins"))


def pid_inventory(packets: DataFrame, file: str = "file_id", seq: str = "packet_index", **kw) -> DataFrame:
    """Packets, unit starts and continuity gaps per pid; the null pid has no counter."""
    d = running(packets, [file, "pid"], [seq], [prev_row("__prev", F.col("continuity"))], **kw)
    gap = (F.col("pid") != 8191) & F.col("__prev").isNotNull() & (F.col("continuity") != (F.col("__prev") + 1) % 16)
    return d.groupBy(file, "pid").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.when(F.col("pusi"), 1).otherwise(0)).cast("bigint").alias("unit_starts"),
        F.sum(F.when(gap, 1).otherwise(0)).cast("bigint").alias("continuity_gaps"))
