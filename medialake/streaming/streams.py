"""Streaming operators: DataFrame in, DataFrame out, on keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions.timing import idiv, sap_type, ticks_to_micros
from medialake.operators.sets import merge_ranges
from medialake.streaming import processors as P
from medialake.streaming.bytestreams import Boxes, PesSamples

_LATE = ", late boolean"


def _state(df: DataFrame, keys: list[str], processor, schema: str, time_mode: str = "None", idle_ms: int | None = None) -> DataFrame:
    """``processor`` on the keys of ``df``; with ``idle_ms`` the state of a key ends when it has been idle for so long."""
    if idle_ms is not None:
        processor.ttl_ms, time_mode = idle_ms, "ProcessingTime"
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def stream_boxes(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Chunks to ``init``, ``fragment``, ``dropped`` and ``error`` rows per path."""
    return _state(chunks, ["path"], Boxes(),
                  "path string, chunk_seq bigint, kind string, track_id bigint, init_bytes binary, fragment binary, error string" + _LATE, idle_ms=idle_ms)


def stream_fragments(chunks: DataFrame, payload: bool = False, idle_ms: int | None = None) -> DataFrame:
    """Live fragments of every path: a row a track fragment, in order of ``arrival_seq``, with times in microseconds.

    ``is_sync`` says that a video fragment begins with a sync sample. Chunks that
    cannot be used and unknown tracks are rows with ``error`` and no ``arrival_seq``.
    The bytes (``moof`` and ``mdat``) are there with ``payload``.
    """
    rows = _state(chunks, ["path"], Boxes(timed=True, keep_bytes=payload),
                  "path string, chunk_seq bigint, kind string, track_id bigint, init_bytes binary, fragment binary, error string, arrival_seq bigint, track_name string, handler_type string, "
                  "timescale bigint, base_ticks bigint, duration_ticks bigint, earliest_ticks bigint, first_flags bigint, payload_bytes bigint" + _LATE, idle_ms=idle_ms)
    sap = sap_type("handler_type", "first_flags")
    timed = {"start_us": ticks_to_micros("base_ticks", "timescale"), "duration_us": ticks_to_micros("duration_ticks", "timescale"),
             "earliest_presentation_time_us": ticks_to_micros("earliest_ticks", "timescale"), "sap_type": sap, "is_sync": (F.col("handler_type") == "vide") & (sap == 2)}
    late = F.when(F.col("late"), "late chunk")
    return rows.where("kind IN ('fragment', 'dropped', 'error') OR late").select(
        "path", "chunk_seq", "arrival_seq", "track_id", "track_name", "handler_type", *[F.when(F.col("arrival_seq").isNotNull(), c).alias(n) for n, c in timed.items()],
        "payload_bytes", *([F.col("fragment").alias("payload")] if payload else []), F.coalesce("error", late).alias("error"))


def stream_live_groups(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Bytes to numbered objects in one query: chunks, fragments, key-frame groups per path."""
    return stream_groups(stream_fragments(chunks, idle_ms=idle_ms).where("error IS NULL"), "path", idle_ms)


def stream_pes(packets: DataFrame, idle_ms: int | None = None) -> DataFrame:
    return _state(packets, ["feed_id", "pid"], PesSamples(), "feed_id bigint, pid int, packet_index bigint, pts90k bigint, payload binary" + _LATE, idle_ms=idle_ms)


def stream_groups(frags: DataFrame, feed: str = "feed_id", idle_ms: int | None = None) -> DataFrame:
    d = frags.select(F.col(feed).alias("feed_id"), "arrival_seq", "track_name", "handler_type", "is_sync")
    out = _state(d, ["feed_id"], P.LiveGroups(), f"feed_id {d.schema['feed_id'].dataType.simpleString()}, arrival_seq bigint, track_name string, group_id bigint, object_id bigint" + _LATE, idle_ms=idle_ms)
    return out.withColumnRenamed("feed_id", feed)


def stream_shared_groups(frags: DataFrame, has_video: bool = True, idle_ms: int | None = None) -> DataFrame:
    """Shared groups per session. Whether a session has video is known from its announced tracks."""
    d = frags if "has_video" in frags.columns else frags.withColumn("has_video", F.lit(has_video))
    d = d.select("session_id", "arrival_seq", "track_name", "handler_type", "is_sync", "start_us", "has_video")
    return _state(d, ["session_id"], P.SharedGroups(),
                  "session_id bigint, arrival_seq bigint, track_name string, group_id bigint, object_id bigint" + _LATE, idle_ms=idle_ms)


def stream_retain_groups(frags: DataFrame, n: int = 2, idle_ms: int | None = None) -> DataFrame:
    """Evicted rows as the latest groups advance; what is not evicted is what is kept."""
    d = frags.select("feed_id", "arrival_seq", "group_id")
    return _state(d, ["feed_id"], P.LatestGroups(n), "feed_id bigint, arrival_seq bigint, group_id bigint" + _LATE, idle_ms=idle_ms)


def stream_retain_newest(objects: DataFrame, n: int = 128, idle_ms: int | None = None) -> DataFrame:
    return _state(objects.select("session_id", "arrival_seq"), ["session_id"], P.NewestRows(n), "session_id bigint, arrival_seq bigint" + _LATE, idle_ms=idle_ms)


def stream_clock(es: DataFrame, idle_ms: int | None = None) -> DataFrame:
    d = es.select("feed_id", "track_name", "arrival_seq", "is_video", "timescale", "pts_us")
    return _state(d, ["feed_id", "track_name"], P.SampleClock(),
                  "feed_id bigint, track_name string, arrival_seq bigint, duration_us bigint, sample_ticks bigint, decode_time bigint" + _LATE, idle_ms=idle_ms)


def stream_subscriptions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Subscribe rows (``is_subscribe``) and updates of requests to accept/reject rows with the state after each."""
    return _state(events, ["request_id"], P.Subscriptions(),
                  "request_id bigint, update_seq bigint, accepted boolean, start_group bigint, start_object bigint, end_group bigint, "
                  "filter_type bigint, priority bigint, forward bigint" + _LATE, idle_ms=idle_ms)


def stream_demand(objects: DataFrame, intervals: DataFrame, keys: list[str] | None = None, bucket_us: int = 3600_000_000) -> DataFrame:
    """Stream-static form of the demand gate: objects of tracks subscribed at their time, each once.

    The intervals are merged, so at most one per track is open and no object lies in
    two. Closed ones meet the stream on (track, time bucket), with buckets of about
    their own length: doubled ``bucket_us``, so an interval lies in three at most.
    """
    keys = keys or ["track_name"]
    merged = merge_ranges(intervals.select(*keys, F.col("subscribe_us").alias("start_ms"), F.col("unsubscribe_us").alias("end_ms")), keys, span=bucket_us)
    length = F.greatest(idiv(F.col("end_ms") - F.col("start_ms"), bucket_us), F.lit(1).cast("bigint"))
    closed = merged.where("end_ms > start_ms").withColumn("__level", F.length(F.bin(length)) - 1)
    still_open = merged.where("end_ms IS NULL")
    at = F.col("media_time_us")

    def gate(left: DataFrame, right: DataFrame, on: list[str], inside) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"__r{k}") for k in on], F.col("start_ms").alias("__lo"), F.col("end_ms").alias("__hi"))
        same = [F.col(k) == F.col(f"__r{k}") for k in on]
        return left.join(r, [*same, inside], "left_semi")

    out = gate(objects, still_open, keys, at >= F.col("__lo"))
    for r in sorted(x["__level"] for x in closed.select("__level").distinct().collect()):  # at most one for each power of two
        width = bucket_us << r
        own = closed.where(F.col("__level") == r).withColumn("__bucket", F.explode(F.sequence(idiv("start_ms", width), idiv("end_ms", width))))
        placed = objects.withColumn("__bucket", idiv(at, width))
        out = out.unionByName(gate(placed, own, [*keys, "__bucket"], (at >= F.col("__lo")) & (at < F.col("__hi"))).drop("__bucket"))
    return out


def stream_republish(log: DataFrame, interval_ms: int) -> DataFrame:
    return _state(log.select("broadcast_id", "version_seq"), ["broadcast_id"], P.Republish(interval_ms),
                  "broadcast_id bigint, version_seq bigint, published_ms bigint, again boolean", "ProcessingTime")


def stream_retained_catalog(objects: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Latest catalog object of each broadcast, once per micro-batch that changes it."""
    d = objects.select("broadcast_id", "arrival_seq", "group_id", "object_id", "payload")
    return _state(d, ["broadcast_id"], P.LastCatalog(),
                  "broadcast_id bigint, arrival_seq bigint, group_id bigint, object_id bigint, payload string" + _LATE, idle_ms=idle_ms)


def stream_stats(objects: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes", at: str = "media_time_us",
                 by: list[str] | None = None) -> DataFrame:
    """Bytes and objects per tumbling or sliding window; the watermark on object time bounds the state."""
    d = objects.withColumn("__ts", F.timestamp_micros(F.col(at))).withWatermark("__ts", delay)
    w = F.window("__ts", window, slide) if slide else F.window("__ts", window)
    agg = d.groupBy(w.alias("w"), *(by or ["broadcast_id"])).agg(
        F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("objects"))
    return agg.select(*(by or ["broadcast_id"]), F.unix_micros(F.col("w.start")).alias("window_start_us"), "bytes", "objects")


def stream_live_stats(objects: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Running bytes, objects and group changes per track, one row per track and micro-batch."""
    d = objects.select("broadcast_id", "track_name", "plan_index", "group_id", "payload_bytes")
    return _state(d, ["broadcast_id", "track_name"], P.Transitions(),
                  "broadcast_id bigint, track_name string, bytes bigint, objects bigint, groups bigint" + _LATE, idle_ms=idle_ms)


def stream_liveness(events: DataFrame, gap_ms: int, forget_ms: int | None = None) -> DataFrame:
    """``events``: (feed_id, is_close). Emits a row when a feed turns live, gap or finished."""
    return _state(events.select("feed_id", "is_close"), ["feed_id"], P.Liveness(gap_ms, forget_ms),
                  "feed_id bigint, at_ms bigint, state string", "ProcessingTime")


def settle_stream(announcements: DataFrame, gap: str = "500 milliseconds", delay: str = "1 second", at: str = "announce_us") -> DataFrame:
    """Quiet-gap sessions of track announcements per feed; the first session of a feed is its settled track set."""
    d = announcements.withColumn("__ts", F.timestamp_micros(F.col(at))).withWatermark("__ts", delay)
    s = d.groupBy("feed_id", F.session_window("__ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("tracks"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))
    return s.select("feed_id", "tracks", "first_us", "last_us")


def as_live_source(df: DataFrame, tracks: DataFrame, catalog_mode: str = "generated") -> tuple[DataFrame, DataFrame]:
    """Objects of a live source and its violations.

    With ``catalog_mode="source"`` the first row (``arrival_seq`` 0) must be a
    non-empty catalog. A row of a track that is not announced is a violation and
    is not published.
    """
    if catalog_mode not in ("generated", "source"):
        raise ValueError(f"unknown catalog mode {catalog_mode!r}")
    known = tracks.select("feed_id", "track_name").distinct().withColumn("__known", F.lit(True))
    is_catalog = F.col("track_name") == "catalog"
    d = df.join(known, ["feed_id", "track_name"], "left")
    unknown = ~is_catalog & F.col("__known").isNull()
    no_catalog = (F.lit(catalog_mode == "source") & (F.col("arrival_seq") == 0)
                  & (~is_catalog | (F.coalesce(F.length("payload"), F.lit(0)) == 0)))
    d = d.withColumn("violation", F.when(no_catalog, "first object is not a catalog").when(unknown, "unknown track"))
    return d.where("violation IS NULL").drop("violation", "__known"), d.where("violation IS NOT NULL").drop("__known")
