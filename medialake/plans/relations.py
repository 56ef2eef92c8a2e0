"""Queries on joins, namespaces and subscription state."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import text
from medialake.functions.timing import idiv
from medialake.operators import project, relate, sets, subscribe
from medialake.plans.registry import query

_MATCH = """(filter_type NOT IN (3, 4) OR group_id > start_group OR (group_id = start_group AND object_id >= start_object))
   AND (filter_type <> 4 OR group_id <= end_group)"""


def _subs(v):
    return v.subs.select("request_id", "track_name", "filter_type", "start_group", "start_object", "end_group")


@query("P5_media_only", """
SELECT broadcast_id, plan_index FROM objects_v WHERE track_name IN (SELECT track_name FROM tracks_v)""")
def _(v):
    return project.media_only(v.objects, v.tracks).select("broadcast_id", "plan_index")


@query("P7_namespace_equality", """
SELECT event_id, a = b AS equal FROM (SELECT event_id, list_filter(string_split('live/' || event_type || '/' || (user_id % 3), '/'), lambda x: x <> '') AS a,
  list_filter(string_split('live//' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'view' END || '/' || (event_id % 3) || '/', '/'), lambda x: x <> '') AS b FROM events)""")
def _(v):
    e = v.table("events").select(
        "event_id",
        F.concat(F.lit("live/"), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("a"),
        F.concat(F.lit("live//"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("view"), F.lit("/"),
                 (F.col("event_id") % 3).cast("string"), F.lit("/")).alias("b"))
    return e.select("event_id", text.namespace_equals("a", "b").alias("equal"))


_NS = """
SELECT event_id, 'live/' || event_type || '/' || (user_id % 3) AS full_ns,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'live' WHEN 2 THEN 'live/view' ELSE 'live/click/1' END AS prefix_ns FROM events"""


def _namespaces(v):
    k = F.col("event_id") % 4
    return v.table("events").select(
        "event_id",
        F.concat(F.lit("live/"), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("full_ns"),
        F.when(k == 0, "").when(k == 1, "live").when(k == 2, "live/view").otherwise("live/click/1").alias("prefix_ns"))


@query("P8_namespace_prefix_reference", f"SELECT event_id, prefix_ns = '' OR full_ns = prefix_ns AS matches FROM ({_NS})")
def _(v):
    return project.namespace_prefix(_namespaces(v), "full_ns", "prefix_ns").select("event_id", "matches")


@query("P8_namespace_prefix_strict", f"""
SELECT event_id, prefix_ns = '' OR full_ns = prefix_ns OR starts_with(full_ns, prefix_ns || '/') AS matches FROM ({_NS})""")
def _(v):
    return project.namespace_prefix(_namespaces(v), "full_ns", "prefix_ns", "prefix").select("event_id", "matches")


@query("J1_attach_track", """
SELECT f.arrival_seq, coalesce(t.track_name, 'media') AS track_name, coalesce(t.timescale, 0) AS timescale, t.codec
FROM frags_v f LEFT JOIN tracks_v t ON f.asset_id = t.asset_id AND f.track_id = t.track_id""")
def _(v):
    f = v.frags.select("arrival_seq", "asset_id", "track_id")
    t = v.tracks.select("asset_id", "track_id", "track_name", "timescale", "codec")
    return relate.attach_track(f, t).select("arrival_seq", "track_name", "timescale", "codec")


@query("J1_attach_track_drop", """
SELECT f.arrival_seq, t.track_name, t.timescale FROM frags_v f JOIN tracks_v t ON f.asset_id = t.asset_id AND f.track_id = t.track_id""")
def _(v):
    f = v.frags.select("arrival_seq", "asset_id", "track_id")
    t = v.tracks.select("asset_id", "track_id", "track_name", "timescale")
    return relate.attach_track(f, t, "drop").select("arrival_seq", "track_name", "timescale")


@query("J2_attach_init", """
SELECT o.broadcast_id, o.plan_index, length(t.codec || t.track_name) + length('payload-' || o.payload_bytes) AS probe_bytes,
       md5(t.codec || t.track_name || 'payload-' || o.payload_bytes) AS probe_md5
FROM objects_v o JOIN tracks_v t ON o.track_name = t.track_name""")
def _(v):
    o = v.objects.withColumn("payload", F.encode(F.concat(F.lit("payload-"), F.col("payload_bytes").cast("string")), "UTF-8"))
    inits = v.tracks.select("track_name", F.encode(F.concat("codec", "track_name"), "UTF-8").alias("init_segment"))
    d = relate.attach_init(o, inits)
    return d.select("broadcast_id", "plan_index", F.length("probe").cast("bigint").alias("probe_bytes"), F.md5("probe").alias("probe_md5"))


@query("J4_match_subscriptions", f"""
SELECT s.request_id, o.plan_index, o.group_id, o.object_id FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name WHERE {_MATCH}""")
def _(v):
    o = v.objects.select("track_name", "plan_index", "group_id", "object_id")
    return relate.match_subscriptions(_subs(v), o).select("request_id", "plan_index", "group_id", "object_id")


@query("J4_unmatched_subscriptions", f"""
SELECT request_id, track_name FROM subs_v WHERE request_id NOT IN
 (SELECT s.request_id FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name WHERE {_MATCH})""")
def _(v):
    o = v.objects.select("track_name", "group_id", "object_id")
    return relate.unmatched_subscriptions(_subs(v), o, hot=v.hot_tracks).select("request_id", "track_name")


@query("P6_location_filter", f"""
SELECT request_id, filter_type, count(*) AS matched, CAST(sum(group_id) AS BIGINT) AS group_sum, CAST(sum(object_id) AS BIGINT) AS object_sum
FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name WHERE {_MATCH} GROUP BY 1, 2""")
def _(v):
    o = v.objects.select("track_name", "group_id", "object_id", F.lit(1).alias("matched"), F.col("group_id").alias("group_sum"), F.col("object_id").alias("object_sum"))
    found = relate.location_totals(_subs(v), o, ["matched", "group_sum", "object_sum"], hot=v.hot_tracks).where("matched > 0")
    return found.join(_subs(v).select("request_id", "filter_type"), ["request_id"]).select("request_id", "filter_type", "matched", "group_sum", "object_sum")


@query("J5_drm_enrichment", """
WITH prot AS (SELECT DISTINCT asset_id, system_id, scheme FROM ptracks_v JOIN systems_v USING (asset_id) WHERE is_protected),
cfg AS (SELECT system_id, min(pssh) AS la_url, CASE WHEN min(pssh) < '5' THEN NULL ELSE min(pssh) END AS robustness FROM systems_v WHERE system_seq < 2 GROUP BY 1)
SELECT asset_id, p.system_id, scheme, coalesce(la_url, 'https://old') AS la_url, CASE WHEN la_url IS NOT NULL THEN 'new' ELSE 'old' END AS la_url_type,
  coalesce(robustness, 'SW') AS robustness FROM prot p LEFT JOIN cfg c ON p.system_id = c.system_id""")
def _(v):
    refs, _bad = relate.attach_protection(v.ptracks, v.systems)
    prot = refs.select("asset_id", "system_id", "scheme").distinct().withColumns(
        {"la_url": F.lit("https://old"), "la_url_type": F.lit("old"), "robustness": F.lit("SW")})
    cfg = v.systems.where("system_seq < 2").groupBy("system_id").agg(F.min("pssh").alias("la_url"))
    cfg = cfg.withColumns({"la_url_type": F.lit("new"), "cert_url": F.lit(None).cast("string"), "cert_url_type": F.lit(None).cast("string"),
                           "robustness": F.when(F.col("la_url") >= "5", F.col("la_url"))})
    return relate.enrich_drm(prot, cfg).select("asset_id", "system_id", "scheme", "la_url", "la_url_type", "robustness")


_J6 = """
WITH s AS (SELECT asset_id, handler_type, sample_index, sample_index // 50 AS fragment_seq, CASE WHEN size % 3 = 0 THEN NULL ELSE duration END AS duration,
   CASE WHEN size % 5 = 0 THEN NULL ELSE size END AS size, CASE WHEN size % 4 = 0 THEN NULL ELSE size % 2 END AS flags FROM samples_v),
f AS (SELECT asset_id, handler_type, fragment_seq, CASE WHEN fragment_seq % 2 = 0 THEN 700 END AS duration, CAST(NULL AS BIGINT) AS size,
   CASE WHEN fragment_seq % 3 = 0 THEN 11 END AS flags FROM (SELECT DISTINCT asset_id, handler_type, fragment_seq FROM s)),
i AS (SELECT asset_id, handler_type, 900 AS duration, 1000 AS size, 22 AS flags FROM (SELECT DISTINCT asset_id, handler_type FROM s WHERE asset_id <> 3))
SELECT s.asset_id, s.handler_type, s.sample_index, coalesce(s.duration, f.duration, i.duration) AS duration, coalesce(s.size, f.size, i.size) AS size,
  {flags} AS flags
FROM s LEFT JOIN f ON s.asset_id = f.asset_id AND s.handler_type = f.handler_type AND s.fragment_seq = f.fragment_seq
LEFT JOIN i ON s.asset_id = i.asset_id AND s.handler_type = i.handler_type"""


def _overlay(v, precedence):
    size = F.col("size")
    track = ["asset_id", "handler_type"]
    s = v.samples.select(
        *track, "sample_index", idiv("sample_index", 50).alias("fragment_seq"), F.when(size % 3 != 0, F.col("duration")).alias("duration"),
        F.when(size % 5 != 0, size).alias("size"), F.when(size % 4 != 0, size % 2).alias("flags"))
    seq = F.col("fragment_seq")
    f = s.select(*track, "fragment_seq").distinct().select(
        *track, "fragment_seq", F.when(seq % 2 == 0, 700).alias("duration"), F.lit(None).cast("bigint").alias("size"), F.when(seq % 3 == 0, 11).alias("flags"))
    i = s.where("asset_id <> 3").select(*track).distinct().select(
        *track, F.lit(900).alias("duration"), F.lit(1000).alias("size"), F.lit(22).alias("flags"))
    d = relate.overlay_defaults(s, f, i, [*track, "fragment_seq"], track, precedence)
    return d.select(*track, "sample_index", "duration", "size", "flags")


@query("J6_default_overlay", _J6.format(flags="coalesce(s.flags, f.flags, i.flags)"))
def _(v):
    return _overlay(v, "standard")


@query("J6_default_overlay_init_flags", _J6.format(flags="coalesce(s.flags, i.flags, f.flags)"))
def _(v):
    return _overlay(v, "init_flags")


@query("J7_protection_refs", """
SELECT asset_id, track_name, system_id, scheme, kid FROM ptracks_v JOIN systems_v USING (asset_id) WHERE is_protected""")
def _(v):
    return relate.attach_protection(v.ptracks, v.systems)[0].select("asset_id", "track_name", "system_id", "scheme", "kid")


@query("J7_protection_violations", """
SELECT asset_id, track_name FROM ptracks_v WHERE is_protected AND asset_id NOT IN (SELECT asset_id FROM systems_v)""")
def _(v):
    return relate.attach_protection(v.ptracks, v.systems)[1].select("asset_id", "track_name")


@query("J9_subscription_admission", """
WITH a AS (SELECT track_name, track_id AS alias FROM tracks_v)
SELECT request_id, CASE WHEN o.o_orderpriority = '5-LOW' THEN 'namespace mismatch' WHEN alias IS NULL THEN 'track does not exist' ELSE 'accepted' END AS outcome,
  CASE WHEN o.o_orderpriority <> '5-LOW' AND alias IS NULL THEN 2 END AS error_code, CASE WHEN o.o_orderpriority <> '5-LOW' THEN alias END AS accepted_alias
FROM subs_v s JOIN orders o ON s.request_id = o.o_orderkey LEFT JOIN a ON s.track_name = a.track_name""")
def _(v):
    ns = v.table("orders").select(F.col("o_orderkey").alias("request_id"),
                                  F.when(F.col("o_orderpriority") == "5-LOW", "other/live").otherwise("live/main").alias("namespace"))
    subs = v.subs.select("request_id", "track_name").join(ns, ["request_id"])
    t = v.tracks.select("track_name", F.col("track_id").alias("track_alias"))
    return relate.admit(subs, t, "live/main").select("request_id", "outcome", "error_code", "accepted_alias")


_MERGED = """
WITH o AS (SELECT link_id, track_name, start_ms, coalesce(end_ms, 9223372036854775807) AS e FROM links_v),
m AS (SELECT *, max(e) OVER (PARTITION BY link_id, track_name ORDER BY start_ms, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY link_id, track_name ORDER BY start_ms, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
r AS (SELECT link_id, track_name, min(start_ms) AS start_ms, max(e) AS e FROM i GROUP BY link_id, track_name, isl)"""


@query("J11_clip_extraction", _MERGED + """
SELECT link_id, track_name, plan_index, r.start_ms, nullif(r.e, 9223372036854775807) AS end_ms
FROM (SELECT track_name, plan_index, (media_time_us - 1704067200000000) // 1000 AS at_ms FROM objects_v) o JOIN r USING (track_name) WHERE at_ms BETWEEN r.start_ms AND r.e""")
def _(v):
    from medialake.plans.views import EPOCH_US

    o = v.objects.select("track_name", "plan_index", idiv(F.col("media_time_us") - EPOCH_US, 1000).alias("at_ms"))
    r = sets.merge_ranges(v.links.select("link_id", "track_name", "start_ms", "end_ms"), ["link_id", "track_name"])
    return relate.extract_clips(o, r, ["track_name"], "at_ms").select("link_id", "track_name", "plan_index", "start_ms", "end_ms")


@query("J11_location_clips", """
SELECT range_id, plan_index FROM links_v l JOIN objects_v o USING (track_name)
WHERE (group_id > start_group OR (group_id = start_group AND object_id >= coalesce(start_object, 0)))
  AND (end_group IS NULL OR group_id < end_group OR (group_id = end_group AND (end_object IS NULL OR object_id <= end_object)))""")
def _(v):
    l = v.links.select("range_id", "track_name", "start_group", "start_object", "end_group", "end_object")
    o = v.objects.select("track_name", "plan_index", "group_id", "object_id")
    return relate.extract_location_clips(o, l, ["track_name"]).select("range_id", "plan_index")


@query("J12_frozen_tracks", """
WITH f AS (SELECT feed_id, min(announce_us) + 7 * 86400000000 AS freeze_us FROM announce_v GROUP BY 1)
SELECT arrival_seq FROM frags_v r JOIN announce_v a ON r.feed_id = a.feed_id AND r.event_type = a.track JOIN f ON r.feed_id = f.feed_id WHERE announce_us <= freeze_us""")
def _(v):
    a = v.announcements
    freeze = a.groupBy("feed_id").agg((F.min("announce_us") + 7 * 86400000000).alias("freeze_us"))
    rows = v.frags.select("arrival_seq", "feed_id", F.col("event_type").alias("track"))
    return relate.only_frozen_tracks(rows, a, freeze, ["feed_id", "track"]).select("arrival_seq")


@query("N2_demand_gate", """
SELECT o.broadcast_id, o.plan_index FROM objects_v o WHERE EXISTS (SELECT 1 FROM
  (SELECT track_name, 1704067200000000 + 3600000000 * (request_id % 700) AS a, 1704067200000000 + 3600000000 * (request_id % 700 + end_group) AS b, filter_type FROM subs_v) s
  WHERE s.track_name = o.track_name AND o.media_time_us >= a AND (filter_type = 2 OR o.media_time_us < b))""")
def _(v):
    from medialake.plans.views import EPOCH_US

    start = EPOCH_US + F.lit(3600000000) * (F.col("request_id") % 700)
    s = v.subs.select("track_name", start.alias("subscribe_us"),
                      F.when(F.col("filter_type") != 2, start + F.lit(3600000000) * F.col("end_group")).alias("unsubscribe_us"))
    o = v.objects.select("broadcast_id", "plan_index", "track_name", "media_time_us")
    return subscribe.demand_gate(o, s, forward=False).select("broadcast_id", "plan_index")


@query("N3_dormant_tracks", """
WITH u AS (SELECT l_orderkey AS request_id, min(l_linenumber * 1000 + l_suppkey) AS activated_by FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT request_id, CASE WHEN forward THEN 'active' WHEN activated_by IS NOT NULL THEN 'activated' ELSE 'dormant' END AS state,
  CASE WHEN NOT forward THEN activated_by END AS activated_by FROM subs_v LEFT JOIN u USING (request_id)""")
def _(v):
    u = v.table("lineitem").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("update_seq"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("forward"))
    return subscribe.activate_dormant(v.subs.select("request_id", "forward"), u).select("request_id", "state", "activated_by")


@query("N4_completion", f"""
SELECT s.request_id, s.track_name, coalesce(n, 0) AS objects, coalesce(st, 0) AS streams FROM subs_v s LEFT JOIN
 (SELECT s.request_id, count(*) AS n, count(DISTINCT (o.group_id, o.subgroup_id)) AS st FROM subs_v s JOIN objects_v o ON s.track_name = o.track_name
  WHERE {_MATCH} GROUP BY 1) c USING (request_id)""")
def _(v):
    o = v.objects.select("track_name", "group_id", "object_id", "subgroup_id")
    return subscribe.completion(_subs(v), o, hot=v.hot_tracks).select("request_id", "track_name", "objects", "streams")


@query("N1_fold_updates", """
WITH RECURSIVE u AS (SELECT l_orderkey AS request_id, l_partkey % 20 AS sg, l_suppkey % 4 AS so, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 + CAST(l_quantity AS INT) END AS ep,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10) AS n FROM lineitem),
w AS (SELECT request_id, 0 AS n, start_group, start_object, end_group, filter_type, 128 AS priority, CASE WHEN forward THEN 1 ELSE 0 END AS forward FROM subs_v
  UNION ALL
  SELECT request_id, n, CASE WHEN ok THEN sg ELSE start_group END, CASE WHEN ok THEN so ELSE start_object END,
    CASE WHEN NOT ok THEN end_group WHEN ep > 0 THEN ep - 1 WHEN filter_type <> 4 THEN 0 ELSE end_group END,
    CASE WHEN ok AND ep > 0 THEN 4 ELSE filter_type END, CASE WHEN ok THEN 64 ELSE priority END, CASE WHEN ok THEN 1 ELSE forward END
  FROM (SELECT w.request_id, u.n, sg, so, ep, start_group, start_object, end_group, filter_type, priority, forward,
          (sg > start_group OR (sg = start_group AND so >= start_object)) AND (filter_type <> 4 OR (ep > 0 AND ep - 1 <= end_group)) AS ok
        FROM w JOIN u ON u.request_id = w.request_id AND u.n = w.n + 1))
SELECT request_id, start_group, start_object, end_group, filter_type, priority, forward FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) AS r FROM w) WHERE r = 1""")
def _(v):
    subs = v.subs.select("request_id", "start_group", "start_object", "end_group", "filter_type",
                         F.lit(128).alias("priority"), F.col("forward").cast("int").alias("forward"))
    line = v.table("lineitem")
    ups = line.select(
        F.col("l_orderkey").alias("request_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("update_seq"),
        (F.col("l_partkey") % 20).alias("start_group"), (F.col("l_suppkey") % 4).alias("start_object"),
        F.lit(64).alias("priority"), F.lit(1).alias("forward"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1 + F.col("l_quantity").cast("int")).alias("end_group_plus_one"))
    return subscribe.fold_updates(subs, ups)[0]
