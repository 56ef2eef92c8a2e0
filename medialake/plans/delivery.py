"""Queries on aggregates: stats, heads, timelines, bitrates, pacing, settling, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions.timing import idiv
from medialake.operators import live, project, relate, rollup
from medialake.plans.registry import query
from medialake.plans.relations import _MATCH, _subs


@query("A1_publish_stats", """
SELECT broadcast_id, track_name, CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS objects, count(DISTINCT group_id) AS groups FROM objects_v GROUP BY 1, 2""")
def _(v):
    return rollup.publish_stats(v.objects, ["broadcast_id", "track_name"])


@query("A1_publish_stats_total", """
SELECT CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS objects, count(DISTINCT (broadcast_id, track_name, group_id)) AS groups FROM objects_v""")
def _(v):
    return rollup.publish_stats(v.objects)


@query("A2_live_stats", """
SELECT broadcast_id, CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS objects, CAST(sum(CASE WHEN p IS NULL OR p <> group_id THEN 1 ELSE 0 END) AS BIGINT) AS groups
FROM (SELECT *, lag(group_id) OVER (PARTITION BY broadcast_id, track_name ORDER BY plan_index) AS p
      FROM (SELECT * REPLACE (group_id % 3 // 2 + plan_index % 11 // 9 AS group_id) FROM objects_v)) GROUP BY 1""")
def _(v):
    o = v.objects.withColumn("group_id", idiv(F.col("group_id") % 3, 2) + idiv(F.col("plan_index") % 11, 9))
    return rollup.live_stats(o, hot=v.hot_broadcasts)


@query("A3_track_heads", """
SELECT broadcast_id, track_name, first_index, hg AS head_group, ho AS head_object,
  CAST(row_number() OVER (PARTITION BY broadcast_id ORDER BY first_index) - 1 AS BIGINT) AS track_alias FROM
 (SELECT broadcast_id, track_name, min(plan_index) AS first_index, max(group_id) AS hg, arg_max(object_id, group_id * 1000000 + object_id) AS ho FROM objects_v GROUP BY 1, 2)""")
def _(v):
    return rollup.track_heads(v.objects, hot=v.hot_broadcasts)


@query("A4_sap_maxima", """
SELECT broadcast_id, track_name, max(s) AS max_object_sap, coalesce(max(CASE WHEN object_id = 0 THEN s END), CASE WHEN max(s) IS NOT NULL THEN 0 END) AS max_group_sap
FROM (SELECT *, CASE WHEN payload_bytes % 3 = 0 THEN NULL ELSE sap_type END AS s FROM objects_v) GROUP BY 1, 2""")
def _(v):
    o = v.objects.withColumn("sap_type", F.when(F.col("payload_bytes") % 3 != 0, F.col("sap_type")))
    return rollup.sap_maxima(o)


@query("A5_measured_bitrate", """
SELECT broadcast_id, track_name, CAST(sum(payload_bytes) AS BIGINT) * 8000000 // CAST(sum(media_duration_us) AS BIGINT) AS measured_bitrate FROM objects_v GROUP BY 1, 2""")
def _(v):
    return rollup.measured_bitrate(v.objects)


@query("A6_group_bounds", """
SELECT broadcast_id, plan_index, object_id = 0 AS starts_group, object_id = max(object_id) OVER (PARTITION BY broadcast_id, track_name, group_id) AS ends_group FROM objects_v""")
def _(v):
    return rollup.group_bounds(v.objects, hot=v.hot_broadcasts).select("broadcast_id", "plan_index", "starts_group", "ends_group")


@query("A9_loop_span", """
SELECT broadcast_id, CAST(max(CASE WHEN kind = 'media' THEN media_time_us + media_duration_us END) AS BIGINT) AS cycle_us,
  min(CASE WHEN kind <> 'initialization' THEN plan_index END) AS first_body_index, bool_or(kind <> 'initialization') AS loopable
FROM (SELECT * REPLACE (CASE WHEN event_type = 'signup' AND object_id = 0 THEN 'initialization' ELSE 'media' END AS kind) FROM objects_v) GROUP BY 1""")
def _(v):
    o = v.objects.withColumn("kind", F.when((F.col("event_type") == "signup") & (F.col("object_id") == 0), "initialization").otherwise("media"))
    return rollup.loop_span(o)


@query("A9_track_group_span", """
SELECT broadcast_id, track_name, max(group_id) + 1 AS group_span, min(CASE WHEN kind <> 'initialization' THEN plan_index END) AS first_body_index,
  bool_or(kind <> 'initialization') AS loopable
FROM (SELECT * REPLACE (CASE WHEN event_type = 'signup' AND object_id = 0 THEN 'initialization' ELSE 'media' END AS kind) FROM objects_v) GROUP BY 1, 2""")
def _(v):
    o = v.objects.withColumn("kind", F.when((F.col("event_type") == "signup") & (F.col("object_id") == 0), "initialization").otherwise("media"))
    return rollup.track_group_span(o)


@query("A16_pacing_rows", """
WITH s AS (SELECT *, media_time_us + (plan_index * 37) % 400 * 1000 - 100000 AS sent FROM objects_v),
f AS (SELECT broadcast_id, arg_min(sent, plan_index) AS began, arg_min(media_time_us, plan_index) AS media FROM s GROUP BY 1)
SELECT broadcast_id, plan_index, (began + greatest(media_time_us - media, 0)) // 1000 AS target_ms, sent // 1000 AS now_ms,
  (sent - (began + greatest(media_time_us - media, 0))) // 1000 AS delta_ms FROM s JOIN f USING (broadcast_id)""")
def _(v):
    sent = F.col("media_time_us") + (F.col("plan_index") * 37) % 400 * 1000 - 100000
    d = rollup.pacing_rows(v.objects.withColumn("send_time_us", sent), seq="plan_index")
    return d.select("broadcast_id", "plan_index", "target_ms", "now_ms", "delta_ms")


@query("A10_media_timeline", "SELECT DISTINCT broadcast_id, (media_time_us + 500) // 1000 AS time_ms, group_id, object_id FROM objects_v")
def _(v):
    return rollup.media_timeline(v.objects)


@query("A10_media_timeline_text", """
SELECT broadcast_id, 0 AS part_index, '[' || string_agg('[' || time_ms || ',[' || group_id || ',' || object_id || '],0]', ',' ORDER BY time_ms, group_id, object_id) || ']' AS timeline
FROM (SELECT DISTINCT broadcast_id, (media_time_us + 500) // 1000 AS time_ms, group_id, object_id FROM objects_v) GROUP BY 1""")
def _(v):
    return rollup.media_timeline_text(v.objects, hot=v.hot_broadcasts)


@query("A11_sap_timeline", """
SELECT broadcast_id, track_name, 0 AS part_index, '[' || string_agg('{"l":[' || group_id || ',' || object_id || '],"data":[' || sap_type || ',' || ((media_time_us + 500) // 1000) || ']}', ',' ORDER BY plan_index) || ']' AS timeline
FROM objects_v GROUP BY 1, 2""")
def _(v):
    return rollup.sap_timeline(v.objects, ept="media_time_us", hot=v.hot_broadcasts)


_REFS = "refs AS (SELECT t.asset_id, track_seq, system_seq, system_id, scheme, kid, pssh FROM ptracks_v t JOIN systems_v s ON t.asset_id = s.asset_id WHERE is_protected)"


@query("A12_protection_entries", f"""
WITH {_REFS}, g AS (SELECT asset_id, system_id, scheme, min(track_seq * 10 + system_seq) AS f, arg_min(pssh, track_seq * 10 + system_seq) AS pssh FROM refs GROUP BY 1, 2, 3)
SELECT asset_id, system_id, scheme, pssh, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY f) AS VARCHAR) AS ref_id FROM g""")
def _(v):
    return rollup.protection_entries(relate.attach_protection(v.ptracks, v.systems)[0])


@query("A12_protection_kids", f"""
WITH {_REFS}, g AS (SELECT asset_id, system_id, scheme, kid, min(track_seq) AS f FROM refs GROUP BY 1, 2, 3, 4)
SELECT asset_id, system_id, scheme, kid, CAST(row_number() OVER (PARTITION BY asset_id, system_id, scheme ORDER BY f) - 1 AS BIGINT) AS kid_index FROM g""")
def _(v):
    return rollup.protection_kids(relate.attach_protection(v.ptracks, v.systems)[0])


@query("A13_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v):
    return rollup.duplicate_keys(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("A14_track_summary", """
SELECT asset_id, 0 AS part_index, string_agg(track_name || '(' || handler_type || ':' || codec || ')', ', ' ORDER BY track_id) AS summary FROM tracks_v GROUP BY 1""")
def _(v):
    return rollup.track_summary(v.tracks)


@query("A15_streams_per_subscription", f"""
SELECT s.request_id, count(DISTINCT (o.group_id, o.subgroup_id)) AS streams, count(*) AS objects FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name WHERE {_MATCH} GROUP BY 1""")
def _(v):
    o = v.objects.select("track_name", "group_id", "object_id", "subgroup_id")
    return relate.served_totals(_subs(v), o, hot=v.hot_tracks).where("objects > 0").select("request_id", "streams", "objects")


@query("A16_pacing_report", """
SELECT track, event, count(*) AS sends, min(delta_ms) AS min_delta_ms, max(delta_ms) AS max_delta_ms, round(avg(delta_ms), 6) AS avg_delta_ms,
  round(quantile_cont(CAST(delta_ms AS DOUBLE), 0.95), 6) AS p95_delta_ms, round(sum(CASE WHEN delta_ms > 0 THEN 1 ELSE 0 END) / count(*), 6) AS late_share
FROM trace_v WHERE event IN ('pacing_before', 'pacing_after') GROUP BY 1, 2""")
def _(v):
    d = rollup.pacing_report(v.trace, exact=True)
    return d.withColumns({c: F.round(c, 6) for c in ("avg_delta_ms", "p95_delta_ms", "late_share")})


@query("A17_wire_overhead", """
SELECT track, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, CAST(sum(wire_bytes) AS BIGINT) AS wire_bytes,
  CAST(sum(wire_bytes) - sum(payload_bytes) AS BIGINT) AS overhead_bytes, CAST(sum(opened) AS BIGINT) AS streams, CAST(sum(fin) AS BIGINT) AS fins
FROM trace_v WHERE event = 'enqueue' GROUP BY 1""")
def _(v):
    return rollup.wire_overhead(v.trace)


@query("S12_plan_report", """
SELECT broadcast_id, plan_index, track_name, group_id, object_id, payload_bytes AS bytes, media_time_us AS time_us,
  CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'metadata' ELSE 'media' END AS kind FROM objects_v""")
def _(v):
    kind = F.when(F.col("event_type") == "signup", "initialization").when(F.col("event_type") == "view", "metadata").otherwise("media")
    return project.plan_report(v.objects.withColumn("kind", kind))


@query("S9_object_filenames", """
SELECT broadcast_id, plan_index, CASE WHEN event_type = 'view' THEN track_name || '_g' || group_id || '_o' || object_id || '.json'
  ELSE track_name || '_g' || group_id || '_o' || object_id || '_media.mp4' END AS object_filename FROM objects_v""")
def _(v):
    from medialake.sources.sinks import object_filename

    o = v.objects.withColumn("kind", F.when(F.col("event_type") == "view", "metadata").otherwise("media"))
    return o.select("broadcast_id", "plan_index", object_filename().alias("object_filename"))


@query("T7_track_settle", """
WITH a AS (SELECT *, announce_us - lag(announce_us) OVER (PARTITION BY feed_id ORDER BY announce_us, track) AS gap FROM announce_v)
SELECT feed_id, track, announce_us, sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY announce_us, track ROWS UNBOUNDED PRECEDING) = 0 AS settled FROM a""")
def _(v):
    return live.settle_tracks(v.announcements, gap_us=21_600_000_000, hot=v.hot_feeds)


def _window_sql(width: int, slide: int) -> str:
    return f"""
SELECT broadcast_id, w AS window_start_us, CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS objects FROM
 (SELECT *, unnest(list_transform(range({width // slide}), lambda k: media_time_us // {slide} * {slide} - k * {slide})) AS w FROM objects_v) GROUP BY 1, 2"""


@query("T12_tumbling_stats", _window_sql(3600_000_000, 3600_000_000))
def _(v):
    return live.window_stats(v.objects, 3600_000_000)


@query("T12_sliding_stats", _window_sql(3600_000_000, 900_000_000))
def _(v):
    return live.window_stats(v.objects, 3600_000_000, 900_000_000)


@query("T14_queue_delay", """
SELECT arrival_seq, (start_us // 1000 + (arrival_seq * 37) % 400) * 1000 - start_us AS queue_delay_us FROM frags_v""")
def _(v):
    sent = (idiv("start_us", 1000) + (F.col("arrival_seq") * 37) % 400) * 1000
    d = v.frags.select("arrival_seq", F.col("start_us").alias("creation_time_us"), sent.alias("send_time_us"))
    return project.queue_delay(d).select("arrival_seq", "queue_delay_us")


_T15 = """
WITH e AS (SELECT feed_id, handler_type = 'vide' AS is_video, arrival_seq, start_us, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type || '-' || payload_bytes END AS codec_params FROM frags_v),
i AS (SELECT e.*, min(start_us) OVER (PARTITION BY feed_id) AS s FROM e),
f AS (SELECT feed_id, is_video, arg_min(codec_params, arrival_seq) AS codec_params, min(arrival_seq) AS found_seq FROM i
      WHERE start_us <= s + 172800000000 AND codec_params IS NOT NULL GROUP BY 1, 2)"""


def _codec_rows(v):
    params = F.when(F.col("event_type").isin("signup", "purchase"), F.concat("event_type", F.lit("-"), F.col("payload_bytes").cast("string")))
    return v.frags.select("feed_id", (F.col("handler_type") == "vide").alias("is_video"), "arrival_seq", F.col("start_us").alias("arrival_us"), params.alias("codec_params"))


@query("T15_codec_discovery", _T15 + " SELECT * FROM f")
def _(v):
    return live.discover_codecs(_codec_rows(v), 172_800_000_000)[0]


@query("T15_removed_tracks", _T15 + """ SELECT DISTINCT feed_id, is_video FROM e WHERE (feed_id, is_video) NOT IN (SELECT (feed_id, is_video) FROM f)""")
def _(v):
    return live.discover_codecs(_codec_rows(v), 172_800_000_000)[1]


@query("T11_retained_catalog", """
SELECT broadcast_id, arg_max(plan_index, plan_index) AS plan_index, arg_max(group_id, plan_index) AS group_id, arg_max(payload_bytes, plan_index) AS payload_bytes FROM objects_v GROUP BY 1""")
def _(v):
    from medialake.operators.catalog import retained_catalog

    return retained_catalog(v.objects.select("broadcast_id", "plan_index", "group_id", "payload_bytes"), seq="plan_index")


@query("T13_liveness", """
WITH r AS (SELECT feed_id, start_us AS t, 0 AS side FROM frags_v
  UNION SELECT feed_id, max(start_us), 1 FROM frags_v WHERE feed_id % 3 = 0 GROUP BY 1
  UNION SELECT feed_id, start_us + 3600000000 * (arrival_seq % 72), 2 FROM frags_v),
w AS (SELECT *, max(CASE WHEN side = 0 THEN t END) OVER past AS seen, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER past AS closed FROM r
  WINDOW past AS (PARTITION BY feed_id ORDER BY t, side ROWS UNBOUNDED PRECEDING))
SELECT feed_id, t AS tick_us, CASE WHEN closed = 1 THEN 'finished' WHEN seen IS NULL OR t - seen > 86400000000 THEN 'gap' ELSE 'live' END AS state FROM w WHERE side = 2""")
def _(v):
    f = v.frags.select("feed_id", "arrival_seq", "start_us")
    closes = f.where("feed_id % 3 = 0").groupBy("feed_id").agg(F.max("start_us").alias("close_us"))
    ticks = f.select("feed_id", (F.col("start_us") + F.lit(3600000000) * (F.col("arrival_seq") % 72)).alias("tick_us"))
    return live.liveness(f.withColumnRenamed("start_us", "arrival_us"), closes, ticks, 86_400_000_000)
