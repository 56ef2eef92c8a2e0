"""Queries on order: end flags, deltas, transitions, send order, latest-first, plans, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import text
from medialake.operators import order, publish, rollup, sequence, sets
from medialake.operators.ordered import stage
from medialake.plans.media import _LANG_SQL
from medialake.plans.registry import query
from medialake.plans.relations import _MATCH, _subs
from medialake.sources.sinks import object_filename


@query("W9_end_flags", """
WITH s AS (SELECT broadcast_id, track_name, group_id, subgroup_id, max(object_id) AS m FROM objects_v GROUP BY 1, 2, 3, 4)
SELECT broadcast_id, plan_index,
  coalesce(max(object_id) OVER (PARTITION BY broadcast_id, track_name, group_id ORDER BY plan_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= object_id, true) AS final_in_group,
  coalesce(max(object_id) OVER (PARTITION BY broadcast_id, track_name, group_id, subgroup_id ORDER BY plan_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= object_id, true) AS final_in_subgroup,
  NOT EXISTS (SELECT 1 FROM s WHERE s.broadcast_id = o.broadcast_id AND s.track_name = o.track_name AND s.group_id = o.group_id
              AND s.subgroup_id <> o.subgroup_id AND s.m > o.object_id) AS contains_group_largest
FROM objects_v o""")
def _(v):
    return sequence.end_flags(v.objects, hot=v.hot_broadcasts).select(
        "broadcast_id", "plan_index", "final_in_group", "final_in_subgroup", "contains_group_largest")


@query("W10_id_delta", """
SELECT broadcast_id, plan_index, coalesce(object_id - lag(object_id) OVER (PARTITION BY broadcast_id, track_name, group_id, subgroup_id ORDER BY plan_index) - 1, object_id) AS id_delta
FROM objects_v""")
def _(v):
    return sequence.object_id_delta(v.objects, hot=v.hot_broadcasts).select("broadcast_id", "plan_index", "id_delta")


@query("W14_group_transitions", """
SELECT broadcast_id, track_name, plan_index, group_id, p AS closed_group FROM
 (SELECT *, lag(group_id) OVER (PARTITION BY broadcast_id, track_name ORDER BY plan_index) AS p FROM objects_v) WHERE p IS NULL OR p <> group_id""")
def _(v):
    return sequence.group_transitions(v.objects, hot=v.hot_broadcasts).select("broadcast_id", "track_name", "plan_index", "group_id", "closed_group")


@query("O1_send_order", f"""
WITH m AS (SELECT s.request_id, o.broadcast_id, o.plan_index, o.media_time_us FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name WHERE {_MATCH}),
r AS (SELECT *, max((media_time_us - (plan_index % 5) * 40000000000, plan_index)) OVER (PARTITION BY request_id ORDER BY plan_index ROWS UNBOUNDED PRECEDING) AS head FROM m)
SELECT broadcast_id, request_id, plan_index, CAST(dense_rank() OVER (PARTITION BY broadcast_id ORDER BY head, plan_index) AS BIGINT) AS send_seq FROM r""")
def _(v):
    o = v.objects.select("track_name", "broadcast_id", "plan_index", "group_id", "object_id",
                         (F.col("media_time_us") - (F.col("plan_index") % 5) * F.lit(40000000000)).alias("media_time_us"))
    # A broadcast has at most objects x subscriptions matches; only one above the task size needs splitting.
    return order.subscribed_send_order(_subs(v), o, hot=v.hot_matches).select("broadcast_id", "request_id", "plan_index", "send_seq")


@query("O2_next_object", f"""
SELECT s.request_id, n AS next_index FROM subs_v s LEFT JOIN (SELECT s.request_id, min(plan_index) AS n FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name
  WHERE {_MATCH} AND o.plan_index >= s.request_id % 3000 GROUP BY 1) USING (request_id)""")
def _(v):
    s = _subs(v).withColumn("position", F.col("request_id") % 3000)
    o = v.objects.select("track_name", "plan_index", "group_id", "object_id")
    return order.next_object(s, o).select("request_id", "next_index")


@query("O3_latest_groups", """
SELECT broadcast_id, plan_index, group_id FROM (SELECT *, max(group_id) OVER (PARTITION BY broadcast_id) AS m FROM objects_v) WHERE group_id >= m - 1""")
def _(v):
    return order.retain_latest_groups(v.objects, feed="broadcast_id", hot=v.hot_broadcasts).select("broadcast_id", "plan_index", "group_id")


@query("O4_newest_objects", """
SELECT session_id, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival_seq DESC) AS r FROM shared_v) WHERE r <= 128""")
def _(v):
    return order.retain_newest(v.shared).select("session_id", "arrival_seq")


@query("U1_build_plan", """
WITH a AS (SELECT asset_id, 0 AS sec, 0 AS s, 'catalog' AS track_name, 0 AS group_id, 0 AS object_id, 'initialization' AS kind,
           0 AS media_time_us, 0 AS media_duration_us, NULL AS sap_type, 0 AS payload_bytes FROM tracks_v GROUP BY 1
 UNION ALL SELECT broadcast_id, 1, plan_index, track_name, group_id, object_id, 'media', media_time_us, media_duration_us, sap_type, payload_bytes FROM objects_v
 UNION ALL SELECT asset_id, 2, 0, 'timeline', 0, 0, 'metadata', 0, 0, NULL, 0 FROM tracks_v GROUP BY 1
 UNION ALL SELECT asset_id, 3, track_id, track_name || '_sap', 0, 0, 'metadata', 0, 0, NULL, 0 FROM tracks_v)
SELECT asset_id, track_name, group_id, object_id, kind, media_time_us, media_duration_us, CAST(sap_type AS INT) AS sap_type, payload_bytes,
       CAST(row_number() OVER (PARTITION BY asset_id ORDER BY sec, s) - 1 AS BIGINT) AS plan_index FROM a""")
def _(v):
    plan = sets.build_plan(_plan_frags(v), v.tracks, hot=v.hot_assets)
    return plan.select("asset_id", "track_name", "group_id", "object_id", "kind", "media_time_us", "media_duration_us", "sap_type", "payload_bytes", "plan_index")


def _plan_frags(v):
    """Every asset's objects as fragments that lie one after another in its file."""
    f = v.objects.select(F.col("broadcast_id").alias("asset_id"), "track_name", "group_id", "object_id", "subgroup_id", F.col("plan_index").alias("arrival_seq"),
                         "media_time_us", "media_duration_us", "sap_type", "payload_bytes")
    f = publish.with_file_places(f, "asset_id", hot=v.hot_assets)
    return f.withColumn("path", F.concat(F.lit("asset_"), F.col("asset_id").cast("string"), F.lit(".mp4")))


def _content_plan(v):
    # written once: the catalog, both timelines and the media rows read it
    frags, tracks = stage(_plan_frags(v)), v.tracks.withColumn("language", text.language_tag("language"))
    return sets.build_plan(frags, tracks, documents=publish.plan_documents(frags, tracks, hot=v.hot_assets), hot=v.hot_assets)


_PLAN_SQL = f"""
mx AS (SELECT asset_id, max(track_id) AS mx, '"' || string_agg(track_name, '","' ORDER BY track_id) || '"' AS names FROM tracks_v GROUP BY 1),
sapmax AS (SELECT broadcast_id AS asset_id, track_name, max(sap_type) AS om, coalesce(max(CASE WHEN object_id = 0 THEN sap_type END), 0) AS gm FROM objects_v GROUP BY 1, 2),
entries AS (
  SELECT t.asset_id, track_id AS pos, '{{"name":"' || t.track_name || '","packaging":"cmaf","role":"' || CASE handler_type WHEN 'vide' THEN 'video' ELSE 'audio' END || '","isLive":false,"renderGroup":1'
   || coalesce(',"codec":"' || nullif(codec, '') || '"', '')
   || CASE WHEN handler_type = 'vide' AND frame_rate > 0 THEN ',"framerate":' || CASE WHEN abs(frame_rate - round(frame_rate)) < 0.0005 THEN CAST(CAST(round(frame_rate) AS BIGINT) AS VARCHAR) ELSE printf('%.3f', frame_rate) END ELSE '' END
   || ',"timescale":' || timescale || ',"bitrate":' || coalesce(nullif(max_bitrate, 0), CASE WHEN handler_type = 'soun' THEN 128000 ELSE 2000000 END)
   || coalesce(',"avgBitrate":' || nullif(avg_bitrate, 0), '')
   || CASE WHEN handler_type = 'vide' THEN coalesce(',"width":' || nullif(width, 0), '') || coalesce(',"height":' || nullif(height, 0), '') ELSE '' END
   || CASE WHEN handler_type = 'soun' THEN ',"samplerate":' || sample_rate || ',"channelConfig":"' || channel_count || '"' ELSE '' END
   || coalesce(',"lang":"' || {_LANG_SQL} || '"', '') || coalesce(',"trackDuration":' || nullif(duration_ms, 0), '')
   || coalesce(',"maxGrpSapStartingType":' || gm, '') || coalesce(',"maxObjSapStartingType":' || om, '') || '}}' AS j
  FROM tracks_v t LEFT JOIN sapmax s ON s.asset_id = t.asset_id AND s.track_name = t.track_name
  UNION ALL SELECT asset_id, mx + 1, '{{"name":"timeline","packaging":"mediatimeline","role":"mediatimeline","isLive":false,"depends":[' || names || '],"mimeType":"application/json"}}' FROM mx
  UNION ALL SELECT asset_id, 1000000000 + track_id, '{{"name":"' || track_name || '_sap","packaging":"eventtimeline","eventType":"org.ietf.moq.cmsf.sap","role":"eventtimeline","isLive":false,"depends":["' || track_name || '"],"mimeType":"application/json"}}' FROM tracks_v),
cat AS (SELECT asset_id, '{{"version":"1","tracks":[' || string_agg(j, ',' ORDER BY pos) || ']}}' AS d FROM entries GROUP BY 1),
tl AS (SELECT broadcast_id AS asset_id, '[' || string_agg('[' || time_ms || ',[' || group_id || ',' || object_id || '],0]', ',' ORDER BY time_ms, group_id, object_id) || ']' AS d
       FROM (SELECT DISTINCT broadcast_id, (media_time_us + 500) // 1000 AS time_ms, group_id, object_id FROM objects_v) GROUP BY 1),
st AS (SELECT broadcast_id AS asset_id, track_name, '[' || string_agg('{{"l":[' || group_id || ',' || object_id || '],"data":[' || sap_type || ',' || ((media_time_us + 500) // 1000) || ']}}', ',' ORDER BY plan_index) || ']' AS d FROM objects_v GROUP BY 1, 2),
obj AS (
  SELECT asset_id, 0 AS sec, 0 AS s, 'catalog' AS track_name, 0 AS group_id, 0 AS object_id, 0 AS subgroup_id, 'initialization' AS kind, 0 AS media_time_us, 0 AS media_duration_us, NULL AS sap_type, NULL AS path, NULL AS file_offset, d AS document, strlen(d) AS payload_bytes FROM cat
  UNION ALL SELECT broadcast_id, 1, plan_index, track_name, group_id, object_id, subgroup_id, 'media', media_time_us, media_duration_us, sap_type, 'asset_' || broadcast_id || '.mp4',
    CAST(coalesce(sum(payload_bytes) OVER (PARTITION BY broadcast_id ORDER BY plan_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), NULL, payload_bytes FROM objects_v
  UNION ALL SELECT mx.asset_id, 2, 0, 'timeline', 0, 0, 0, 'metadata', 0, 0, NULL, NULL, NULL, coalesce(d, '[]'), strlen(coalesce(d, '[]')) FROM mx LEFT JOIN tl USING (asset_id)
  UNION ALL SELECT t.asset_id, 3, track_id, t.track_name || '_sap', 0, 0, 0, 'metadata', 0, 0, NULL, NULL, NULL, coalesce(d, '[]'), strlen(coalesce(d, '[]')) FROM tracks_v t LEFT JOIN st ON st.asset_id = t.asset_id AND st.track_name = t.track_name),
plan AS (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY sec, s) - 1 AS BIGINT) AS plan_index FROM obj)"""


@query("U1_plan_content", f"""
WITH {_PLAN_SQL}
SELECT asset_id, plan_index, track_name, kind, group_id, object_id, media_time_us, media_duration_us, CAST(sap_type AS INT) AS sap_type, payload_bytes, path, file_offset, document FROM plan""")
def _(v):
    return _content_plan(v).select("asset_id", "plan_index", "track_name", "kind", "group_id", "object_id", "media_time_us", "media_duration_us", "sap_type", "payload_bytes", "path", "file_offset", "document")


@query("U1_plan_stats", f"""
WITH {_PLAN_SQL}
SELECT asset_id, kind, CAST(sum(payload_bytes) AS BIGINT) AS bytes, count(*) AS objects, count(DISTINCT (track_name, group_id)) AS groups FROM plan GROUP BY 1, 2""")
def _(v):
    return rollup.publish_stats(_content_plan(v), ["asset_id", "kind"], track=["asset_id", "track_name"])


@query("U1_plan_to_send_order", f"""
WITH {_PLAN_SQL},
m AS (SELECT s.request_id, p.* FROM subs_v s JOIN plan p ON s.track_name = p.track_name WHERE kind = 'media' AND {_MATCH}),
r AS (SELECT *, max((media_time_us, plan_index)) OVER (PARTITION BY asset_id, request_id ORDER BY plan_index ROWS UNBOUNDED PRECEDING) AS head FROM m)
SELECT asset_id, request_id, plan_index, path, file_offset, payload_bytes, track_name || '_g' || group_id || '_o' || object_id || '_media.mp4' AS object_filename,
       CAST(dense_rank() OVER (PARTITION BY asset_id ORDER BY head, plan_index) AS BIGINT) AS send_seq FROM r""")
def _(v):
    plan = _content_plan(v).where("kind = 'media'")
    plan = plan.select("asset_id", "plan_index", "track_name", "kind", "group_id", "object_id", "media_time_us", "path", "file_offset", "payload_bytes")
    sent = order.subscribed_send_order(_subs(v), plan, "asset_id", hot=v.hot_matches.renamed(broadcast_id="asset_id"))
    return sent.withColumn("object_filename", object_filename()).select("asset_id", "request_id", "plan_index", "path", "file_offset", "payload_bytes", "object_filename", "send_seq")


@query("U1_plan_tracks", """
WITH m AS (SELECT asset_id, max(track_id) AS mx FROM tracks_v GROUP BY 1)
SELECT asset_id, 0 AS track_id, 'catalog' AS track_name, 'catalog' AS packaging, NULL AS depends_on FROM m
UNION ALL SELECT asset_id, track_id, track_name, 'cmaf', NULL FROM tracks_v
UNION ALL SELECT asset_id, mx + 1, 'timeline', 'mediatimeline', NULL FROM m
UNION ALL SELECT asset_id, mx + 1 + row_number() OVER (PARTITION BY asset_id ORDER BY track_id), track_name || '_sap', 'eventtimeline', track_name FROM tracks_v JOIN m USING (asset_id)""")
def _(v):
    return sets.plan_tracks(v.tracks).select("asset_id", "track_id", "track_name", "packaging", "depends_on")


@query("U1_plan_dependencies", """
SELECT asset_id, 'timeline' AS track_name, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY track_id) - 1 AS BIGINT) AS position, track_name AS depends_on FROM tracks_v
UNION ALL SELECT asset_id, track_name || '_sap', 0, track_name FROM tracks_v""")
def _(v):
    return sets.plan_dependencies(v.tracks)


@query("U3_announced_tracks", """
SELECT feed_id, 'catalog' AS track_name FROM announce_v GROUP BY 1 UNION ALL SELECT feed_id, track FROM announce_v""")
def _(v):
    reg = v.announcements.select("feed_id", F.col("track").alias("track_name"))
    cat = v.table("customer").select(F.col("c_custkey").alias("feed_id"), F.lit("catalog").alias("track_name"))
    return sets.announced_tracks(cat, reg)


@query("U5_merge_time_ranges", """
WITH o AS (SELECT link_id, start_ms, coalesce(end_ms, 9223372036854775807) AS e FROM links_v),
m AS (SELECT *, max(e) OVER (PARTITION BY link_id ORDER BY start_ms, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY link_id ORDER BY start_ms, e ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT link_id, min(start_ms) AS start_ms, nullif(max(e), 9223372036854775807) AS end_ms FROM i GROUP BY link_id, isl""")
def _(v):
    return sets.merge_ranges(v.links.select("link_id", "start_ms", "end_ms"), ["link_id"], hot=v.hot_links)


@query("U5_merge_location_ranges", """
WITH o AS (SELECT DISTINCT link_id, start_group * 100000 + coalesce(start_object, 0) AS s,
   CASE WHEN end_group IS NULL THEN 9000000000 ELSE end_group * 100000 + coalesce(end_object, 99999) END AS e FROM links_v),
m AS (SELECT *, max(e) OVER (PARTITION BY link_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY link_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
r AS (SELECT link_id, min(s) AS s, max(e) AS e FROM i GROUP BY link_id, isl)
SELECT link_id, s // 100000 AS start_group, s % 100000 AS start_object, CASE WHEN e < 9000000000 THEN e // 100000 END AS end_group,
  CASE WHEN e < 9000000000 AND e % 100000 <> 99999 THEN e % 100000 END AS end_object FROM r""")
def _(v):
    return sets.merge_ranges(v.links.select("link_id", "start_group", "start_object", "end_group", "end_object"), ["link_id"], "location", hot=v.hot_links)
