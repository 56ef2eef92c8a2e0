"""Queries on fragments and samples: times, flags, grouping, numbering, clocks, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.functions import text, timing
from medialake.functions.timing import idiv
from medialake.operators import expand, project, rollup, sequence
from medialake.operators.ordered import by_heat
from medialake.plans.registry import query


@query("P1_tick_rescale", """
SELECT arrival_seq, decode_ticks * 1000000 // timescale AS time_us, decode_ticks * 1000000 // 90000 AS pts_us,
       (start_us + 500) // 1000 AS start_ms FROM frags_v""")
def _(v):
    return project.with_micros(v.frags, "decode_ticks", "timescale").select(
        "arrival_seq", "time_us", timing.pts90k_to_micros("decode_ticks").alias("pts_us"), timing.round_millis("start_us").alias("start_ms"))


@query("P2_presentation_time", """
SELECT arrival_seq, greatest(decode_ticks + composition_offset, 0) * 1000000 // timescale AS presentation_us FROM frags_v""")
def _(v):
    return project.with_presentation_time(v.frags, "decode_ticks").select("arrival_seq", "presentation_us")


@query("P3_sap_type", """
SELECT arrival_seq, CASE WHEN handler_type <> 'vide' THEN 1 WHEN (flags & 65536) = 0 THEN 2 ELSE 0 END AS sap_type FROM frags_v""")
def _(v):
    return project.with_sap_type(v.frags).select("arrival_seq", "sap_type")


@query("P4_send_flags", """
SELECT broadcast_id, plan_index, object_id = 0 OR is_sync OR sap_type <> 0 AS is_sync_point,
       CASE WHEN payload_bytes % 3 = 0 THEN media_time_us ELSE payload_bytes END AS send_presentation_us,
       CASE WHEN payload_bytes % 6 BETWEEN 0 AND 3 THEN payload_bytes % 6 END AS declared_sap FROM
(SELECT *, CASE WHEN payload_bytes % 3 = 0 THEN 0 ELSE payload_bytes END AS ept FROM objects_v)""")
def _(v):
    bytes_ = F.col("payload_bytes")
    d = v.objects.select(
        "broadcast_id", "plan_index", "object_id", F.col("is_sync").alias("is_video_keyframe"), "sap_type",
        F.when(bytes_ % 3 == 0, 0).otherwise(bytes_).alias("earliest_presentation_time_us"),
        F.col("media_time_us").alias("start_time_us"), (bytes_ % 6).alias("raw_sap"))
    return project.with_send_flags(d).select(
        "broadcast_id", "plan_index", "is_sync_point", "send_presentation_us", timing.declared_sap("raw_sap").alias("declared_sap"))


@query("P10_metadata_gate", """
SELECT track_id, CASE WHEN track_name = '' THEN 'name' WHEN handler_type NOT IN ('vide','soun') THEN 'media_type' WHEN codec = '' THEN 'codec'
  WHEN handler_type = 'soun' AND sample_rate = 0 THEN 'sample_rate' WHEN handler_type = 'soun' AND channel_count = 0 THEN 'channel_count' END AS failed_rule
FROM tracks_v""")
def _(v):
    return project.gate_tracks(v.tracks).select("track_id", "failed_rule")


_LANG_SQL = "CASE language WHEN 'eng' THEN 'en' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' WHEN 'und' THEN NULL ELSE language END"


@query("P11_catalog_projection", f"""
SELECT track_id, track_name AS name, packaging, CASE handler_type WHEN 'vide' THEN 'video' ELSE 'audio' END AS role, false AS is_live,
  nullif(codec, '') AS codec, {_LANG_SQL} AS lang, timescale, nullif(duration_ms, 0) AS track_duration_ms, 1 AS render_group,
  CASE WHEN handler_type = 'vide' THEN nullif(width, 0) END AS width, CASE WHEN handler_type = 'vide' THEN nullif(height, 0) END AS height,
  CASE WHEN handler_type = 'vide' AND frame_rate > 0 THEN frame_rate END AS framerate,
  CASE WHEN handler_type = 'soun' THEN sample_rate END AS samplerate,
  CASE WHEN handler_type = 'soun' THEN CAST(channel_count AS VARCHAR) END AS channel_config,
  coalesce(nullif(max_bitrate, 0), CASE WHEN handler_type = 'soun' THEN 128000 ELSE 2000000 END) AS bitrate, nullif(avg_bitrate, 0) AS avg_bitrate
FROM tracks_v""")
def _(v):
    t = v.tracks.withColumn("language", text.language_tag("language"))
    return project.to_catalog_tracks(t, is_live=False).drop("asset_id", "mime_type", "event_type")


@query("P12_bitrate_resolution", """
SELECT t.asset_id, t.track_name,
  coalesce(nullif(max_bitrate, 0), nullif(c.avg, 0), nullif(m.rate, 0), CASE WHEN handler_type = 'soun' THEN 128000 ELSE 2000000 END) AS bitrate,
  coalesce(nullif(max_bitrate, 0), nullif(c.avg, 0), nullif(m.rate, 0)) IS NULL AS estimated
FROM tracks_v t
LEFT JOIN (SELECT track_name, avg_bitrate AS avg FROM tracks_v) c USING (track_name)
LEFT JOIN (SELECT track_name, CAST(sum(payload_bytes) AS BIGINT) * 8000000 // CAST(sum(media_duration_us) AS BIGINT) AS rate FROM objects_v GROUP BY 1) m USING (track_name)""")
def _(v):
    conf = v.tracks.select("track_name", F.col("avg_bitrate").alias("configured_bitrate"))
    measured = rollup.measured_bitrate(v.objects, ["track_name"])
    return project.resolve_bitrate(v.tracks, conf, measured, ["track_name"]).select("asset_id", "track_name", "bitrate", "estimated")


@query("P13_send_projection", """
SELECT track_id, track_name AS name, CASE handler_type WHEN 'soun' THEN 'audio' ELSE 'video' END AS media_type, codec, width, height,
  CAST(floor(frame_rate * 1000.0 + 0.5) AS BIGINT) AS framerate_millis,
  CASE WHEN handler_type = 'soun' THEN coalesce(nullif(sample_rate, 0), 48000) END AS samplerate,
  CASE WHEN handler_type = 'soun' THEN CAST(coalesce(nullif(channel_count, 0), 2) AS VARCHAR) END AS channel_config,
  coalesce(nullif(rate, 0), CASE WHEN handler_type = 'soun' THEN 128000 ELSE 2000000 END) AS bitrate
FROM tracks_v LEFT JOIN (SELECT track_name, CAST(sum(payload_bytes) AS BIGINT) * 8000000 // CAST(sum(media_duration_us) AS BIGINT) AS rate
                         FROM objects_v GROUP BY 1) USING (track_name)""")
def _(v):
    return project.to_send_tracks(v.tracks, rollup.measured_bitrate(v.objects, ["track_name"])).drop("asset_id")


@query("P9_path_prefix", """
SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages
WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en' OR regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) LIKE '/en/%'""")
def _(v):
    p = v.table("pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return project.path_under(p, "/en")


@query("F5_path_slug", """
SELECT page_id, CASE WHEN seg = '' THEN 'dash' ELSE regexp_replace(seg, '[^A-Za-z0-9]', '_', 'g') END AS slug
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS seg FROM pages)""")
def _(v):
    return v.table("pages").select("page_id", text.path_slug("url").alias("slug"))


@query("F1_track_key", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '' THEN NULL ELSE
  list_aggregate(list_transform(regexp_extract_all(hex(encode(c_mktsegment)), '..'), lambda x: CASE WHEN regexp_matches(chr(CAST('0x' || x AS INT)), '^[A-Za-z0-9_]$')
     THEN chr(CAST('0x' || x AS INT)) ELSE '.' || lower(x) END), 'string_agg', '') || '-' ||
  list_aggregate(list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: CASE WHEN regexp_matches(chr(CAST('0x' || x AS INT)), '^[A-Za-z0-9_]$')
     THEN chr(CAST('0x' || x AS INT)) ELSE '.' || lower(x) END), 'string_agg', '') || '--' ||
  list_aggregate(list_transform(regexp_extract_all(hex(encode(o_orderpriority)), '..'), lambda x: CASE WHEN regexp_matches(chr(CAST('0x' || x AS INT)), '^[A-Za-z0-9_]$')
     THEN chr(CAST('0x' || x AS INT)) ELSE '.' || lower(x) END), 'string_agg', '') END AS track_key
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(v):
    d = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.select("o_orderkey", text.track_key_encode(F.array("c_mktsegment", "c_name"), "o_orderpriority").alias("track_key"))


@query("F4_percent_check", """
SELECT page_id, NOT contains(regexp_replace(url, '%[A-Za-z0-9_-]+%', '', 'g'), '%') AS url_ok,
       NOT contains(regexp_replace(html, '%[A-Za-z0-9_-]+%', '', 'g'), '%') AS html_ok FROM pages""")
def _(v):
    return v.table("pages").select("page_id", text.percent_ok("url").alias("url_ok"), text.percent_ok("html").alias("html_ok"))


@query("F6_language_tag", """
SELECT track_id, CASE language WHEN 'eng' THEN 'en' WHEN 'fra' THEN 'fr' WHEN 'deu' THEN 'de' WHEN 'und' THEN '' ELSE language END AS tag FROM tracks_v""")
def _(v):
    return v.tracks.select("track_id", text.language_tag("language").alias("tag"))


@query("F7_uuid_text", """
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid,
       false AS name_is_uuid, true AS uuid_is_uuid FROM (SELECT p_partkey, md5(p_name) AS h FROM part)""")
def _(v):
    d = v.table("part").select("p_partkey", "p_name", text.uuid_text(F.unhex(F.md5("p_name"))).alias("uuid"))
    return d.select("p_partkey", "uuid", text.is_uuid("p_name").alias("name_is_uuid"), text.is_uuid("uuid").alias("uuid_is_uuid"))


@query("F8_base64", "SELECT page_id, base64(encode(html)) AS encoded, true AS round_trip FROM pages")
def _(v):
    d = v.table("pages").select("page_id", F.encode("html", "UTF-8").alias("raw"))
    return d.select("page_id", F.regexp_replace(F.base64("raw"), "[\r\n]", "").alias("encoded"), (F.unbase64(F.base64("raw")) == F.col("raw")).alias("round_trip"))


@query("F9_range_text", """
SELECT range_id, CAST(start_ms AS VARCHAR) || coalesce('-' || CAST(end_ms AS VARCHAR), '') AS time_text, start_ms, end_ms,
  CAST(start_group AS VARCHAR) || coalesce('.' || CAST(start_object AS VARCHAR), '')
  || coalesce('-' || CAST(end_group AS VARCHAR) || coalesce('.' || CAST(end_object AS VARCHAR), ''), '') AS location_text,
  end_group IS NULL OR end_group > start_group OR coalesce(end_object, 9223372036854775807) >= coalesce(start_object, 0) AS location_ok
FROM links_v""")
def _(v):
    l = v.links
    time = F.struct("start_ms", "end_ms")
    place = F.struct(F.struct(F.col("start_group").alias("group"), F.col("start_object").alias("object")).alias("start"),
                     F.when(F.col("end_group").isNotNull(), F.struct(F.col("end_group").alias("group"), F.col("end_object").alias("object"))).alias("end"))
    d = l.select("range_id", text.format_time_range(time).alias("time_text"), text.format_location_range(place).alias("location_text"))
    t, p = text.parse_time_range("time_text"), text.parse_location_range("location_text")
    return d.select("range_id", "time_text", t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms"), "location_text", p.isNotNull().alias("location_ok"))


@query("F10_json_fields", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS rebuilt FROM events""")
def _(v):
    d = v.table("events").select("event_id", F.from_json("props", "k BIGINT").alias("p"))
    return d.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("rebuilt"))


@query("W1_key_frame_groups", """
SELECT * FROM (SELECT arrival_seq, feed_id, track_name, CAST(sum(CASE WHEN handler_type = 'vide' AND is_sync THEN 1 ELSE 0 END)
  OVER (PARTITION BY feed_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_id FROM frags_v) WHERE group_id >= 0""")
def _(v):
    return sequence.assign_groups(v.frags, hot=v.hot_feeds).select("arrival_seq", "feed_id", "track_name", "group_id")


@query("W2_object_numbers", "SELECT broadcast_id AS feed_id, plan_index AS arrival_seq, group_id, object_id FROM objects_v")
def _(v):
    d = by_heat(v.frags, v.hot_feeds, lambda part, heat: sequence.number_objects(sequence.assign_groups(part, hot=heat), hot=heat))
    return d.select("feed_id", "arrival_seq", "group_id", "object_id")


SHARED_SQL = """
WITH a AS (SELECT *, max(CASE WHEN handler_type = 'vide' AND is_sync THEN start_us END)
             OVER (PARTITION BY session_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM shared_v),
b AS (SELECT *, CAST(sum(CASE WHEN handler_type = 'vide' AND is_sync AND (before IS NULL OR start_us > before) THEN 1 ELSE 0 END)
             OVER (PARTITION BY session_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_id FROM a),
c AS (SELECT *, max(CASE WHEN handler_type = 'vide' AND is_sync THEN 1 ELSE 0 END)
             OVER (PARTITION BY session_id, group_id, track_name ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) AS started
      FROM b WHERE group_id >= 0 AND NOT coalesce(handler_type = 'vide' AND is_sync AND start_us < before, false))
SELECT session_id, arrival_seq, track_name, group_id,
  CAST(row_number() OVER (PARTITION BY session_id, group_id, track_name ORDER BY arrival_seq) - 1 AS BIGINT) AS object_id
FROM c WHERE handler_type <> 'vide' OR started = 1"""


@query("W3_shared_groups", SHARED_SQL)
def _(v):
    return sequence.assign_shared_groups(v.shared, hot=v.hot_sessions).select("session_id", "arrival_seq", "track_name", "group_id", "object_id")


@query("W4_fragment_ordinal", """
SELECT asset_id, arrival_seq, CAST(row_number() OVER (PARTITION BY asset_id, track_name ORDER BY arrival_seq) - 1 AS BIGINT) AS group_id, 0 AS object_id FROM frags_v""")
def _(v):
    return sequence.number_batch(v.frags, hot=v.hot_assets).select("asset_id", "arrival_seq", "group_id", "object_id")


@query("W4_split_numbers", """
SELECT asset_id, arrival_seq, CAST(dense_rank() OVER (PARTITION BY asset_id, track_name ORDER BY arrival_seq // 40) - 1 AS BIGINT) AS group_id,
  CAST(row_number() OVER (PARTITION BY asset_id, track_name, arrival_seq // 40 ORDER BY arrival_seq) - 1 AS BIGINT) AS object_id FROM frags_v""")
def _(v):
    d = v.frags.withColumn("fragment_seq", idiv("arrival_seq", 40))
    return sequence.number_batch(d, "split", hot=v.hot_assets).select("asset_id", "arrival_seq", "group_id", "object_id")


@query("W4_progressive_numbers", """
SELECT asset_id, arrival_seq, CAST(dense_rank() OVER (PARTITION BY asset_id ORDER BY track_id) - 1 AS BIGINT) AS group_id,
  CAST(row_number() OVER (PARTITION BY asset_id, track_name ORDER BY arrival_seq) - 1 AS BIGINT) AS object_id FROM frags_v""")
def _(v):
    return sequence.number_batch(v.frags, "progressive", hot=v.hot_assets).select("asset_id", "arrival_seq", "group_id", "object_id")


@query("W5_decode_clock", """
SELECT asset_id, handler_type, sample_index, CAST(coalesce(sum(duration) OVER (PARTITION BY asset_id, handler_type ORDER BY sample_index
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM samples_v""")
def _(v):
    return sequence.with_decode_time(v.samples, ["asset_id", "handler_type"], hot=v.hot_samples).select("asset_id", "handler_type", "sample_index", "decode_time")


_GOP_SQL = """
WITH clk AS (SELECT *, CAST(coalesce(sum(duration) OVER (PARTITION BY asset_id, handler_type ORDER BY sample_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM samples_v),
vid AS (SELECT *, sum(CASE WHEN sync OR sample_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY sample_index ROWS UNBOUNDED PRECEDING) - 1 AS gop
        FROM clk WHERE handler_type = 'vide'),
starts AS (SELECT asset_id, gop, decode_time * 1000000 // timescale AS start_us FROM vid WHERE sync OR sample_index = 0),
aud AS (SELECT c.*, c.decode_time * 1000000 // c.timescale AS t_us FROM clk c WHERE handler_type <> 'vide'),
st AS (SELECT asset_id, start_us, max(gop) AS gop FROM starts GROUP BY 1, 2),
al AS (SELECT a.*, coalesce(s.gop, 0) AS gop FROM aud a ASOF LEFT JOIN st s ON a.asset_id = s.asset_id AND a.t_us >= s.start_us)"""


@query("J3_gop_alignment", _GOP_SQL + """
SELECT asset_id, sample_index, CAST(gop AS BIGINT) AS gop FROM al""")
def _(v):
    keys = ["asset_id", "handler_type"]
    clocked = sequence.gop_of_video(v.samples, keys, hot=v.hot_samples)
    starts = clocked.where("handler_type = 'vide' AND (sync OR sample_index = 0)").select(
        "asset_id", "gop", timing.ticks_to_micros("decode_time", "timescale").alias("start_us"))
    sound = clocked.where("handler_type <> 'vide'").select(
        "asset_id", "sample_index", timing.ticks_to_micros("decode_time", "timescale").alias("t_us"))
    return sequence.align_to_gops(sound, starts, ["asset_id"], hot=v.hot_samples).select("asset_id", "sample_index", "gop")


@query("W6_gop_coalescing", _GOP_SQL + """,
allrows AS (SELECT asset_id, handler_type, sample_index, timescale, duration, composition_offset, size, decode_time, gop FROM vid
        UNION ALL SELECT asset_id, handler_type, sample_index, timescale, duration, composition_offset, size, decode_time, gop FROM al),
placed AS (SELECT *, (row_number() OVER (PARTITION BY asset_id, handler_type, gop ORDER BY sample_index) - 1) // 120 AS part FROM allrows),
ch AS (SELECT asset_id, handler_type, gop, part, min(sample_index) AS first_sample, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS payload_bytes,
         min(decode_time) AS d0, CAST(sum(duration) AS BIGINT) AS dur, max(timescale) AS ts, arg_min(composition_offset, sample_index) AS off
       FROM placed GROUP BY 1, 2, 3, 4)
SELECT asset_id, handler_type, CAST(gop AS BIGINT) AS gop, CAST(row_number() OVER (PARTITION BY asset_id, handler_type ORDER BY first_sample) - 1 AS BIGINT) AS object_id,
  first_sample, sample_count, payload_bytes, d0 * 1000000 // ts AS start_time_us, dur * 1000000 // ts AS duration_us,
  greatest(d0 + off, 0) * 1000000 // ts AS earliest_presentation_time_us,
  CASE WHEN handler_type <> 'vide' THEN 1 WHEN part = 0 THEN 2 ELSE 0 END AS sap_type FROM ch""")
def _(v):
    return sequence.coalesce_gops(v.samples, hot=v.hot_samples)


_DUR_SQL = """
WITH a AS (SELECT *, lag(pts_us) OVER (PARTITION BY feed_id, track_name ORDER BY arrival_seq) AS p FROM es_v),
b AS (SELECT *, CASE WHEN p <> 0 AND pts_us - p > 0 AND pts_us - p <= 500000 THEN pts_us - p END AS good FROM a),
c AS (SELECT *, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY feed_id, track_name ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING),
        CASE WHEN is_video THEN 33333 ELSE 1024000000 // timescale END) AS duration_us FROM b)"""


@query("W7_duration_estimate", _DUR_SQL + " SELECT feed_id, track_name, arrival_seq, duration_us FROM c")
def _(v):
    return sequence.estimate_durations(v.es, hot=v.hot_feeds).select("feed_id", "track_name", "arrival_seq", "duration_us")


@query("W8_monotone_clock", _DUR_SQL + """,
d AS (SELECT *, CASE WHEN NOT is_video THEN 1024 ELSE greatest(duration_us * timescale // 1000000, 1) END AS sample_ticks FROM c)
SELECT feed_id, track_name, arrival_seq, sample_ticks, CAST(coalesce(sum(sample_ticks) OVER (PARTITION BY feed_id, track_name ORDER BY arrival_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM d""")
def _(v):
    d = sequence.monotone_clock(sequence.estimate_durations(v.es, hot=v.hot_feeds), hot=v.hot_feeds)
    return d.select("feed_id", "track_name", "arrival_seq", "sample_ticks", "decode_time")


@query("W13_audio_frame_times", """
SELECT arrival_seq, k AS frame_index, decode_ticks + (k * 1024 * 90000 + 24000) // 48000 AS frame_pts90k
FROM (SELECT arrival_seq, decode_ticks, unnest(range(1 + payload_bytes % 7)) AS k FROM frags_v WHERE handler_type = 'soun')""")
def _(v):
    d = v.frags.where("handler_type = 'soun'").select(
        "arrival_seq", F.col("decode_ticks").alias("pts90k"), (1 + F.col("payload_bytes") % 7).alias("frame_count"), F.lit(0).alias("sample_rate"))
    return sequence.expand_audio_frames(d).select("arrival_seq", "frame_index", "frame_pts90k")


@query("A7_fragment_rollup", """
SELECT asset_id, handler_type, sample_index // 25 AS fragment_seq, 1000 * (sample_index // 25) * 1000000 // max(timescale) AS start_time_us,
  CAST(sum(duration) AS BIGINT) * 1000000 // max(timescale) AS duration_us,
  min(greatest(512 * sample_index + composition_offset, 0)) * 1000000 // max(timescale) AS earliest_presentation_time_us,
  CASE WHEN handler_type <> 'vide' THEN 1 WHEN arg_min(sync, sample_index) THEN 2 ELSE 0 END AS sap_type
FROM samples_v GROUP BY asset_id, handler_type, sample_index // 25""")
def _(v):
    seq = idiv("sample_index", 25)
    d = v.samples.withColumns({
        "fragment_seq": seq, "base_decode_time": seq * 1000, "decode_time": F.col("sample_index") * 512,
        "flags": F.when(F.col("sync"), 0x02000000).otherwise(0x01010000).cast("bigint")})
    return rollup.rollup_fragments(d, ["asset_id", "fragment_seq"])


@query("A8_frame_rate", """
SELECT asset_id, round(CAST(sum(run_count) AS DOUBLE) * 90000.0 / CAST(sum(run_count * value) AS DOUBLE), 6) AS frame_rate FROM runs_v GROUP BY 1""")
def _(v):
    d = rollup.frame_rate(v.runs.withColumn("timescale", F.lit(90000).cast("bigint")))
    return d.withColumn("frame_rate", F.round("frame_rate", 6))


@query("X1_run_expansion", """
SELECT asset_id, first + k AS sample_index, value FROM (SELECT asset_id, value, first, unnest(range(run_count)) AS k FROM
 (SELECT *, CAST(coalesce(sum(run_count) OVER (PARTITION BY asset_id ORDER BY run_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM runs_v))""")
def _(v):
    return expand.expand_runs(v.runs, hot=v.hot_runs)


_X2_SQL = """
WITH ch AS (SELECT asset_id, run_index + 1 AS chunk_index, run_count * 1000 AS chunk_offset FROM runs_v),
cm AS (SELECT asset_id, run_index + 1 AS first_chunk, 1 + value // 512 % 3 AS per FROM runs_v WHERE run_count > 12 OR run_index = 0),
sz AS (SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY run_index, k) - 1 AS BIGINT) AS sample_index, value AS size
       FROM (SELECT *, unnest(range(value // 512 % 4)) AS k FROM runs_v)),
a AS (SELECT c.*, m.per FROM ch c ASOF JOIN cm m ON c.asset_id = m.asset_id AND c.chunk_index >= m.first_chunk),
b AS (SELECT *, CAST(coalesce(sum(per) OVER (PARTITION BY asset_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM a),
p AS (SELECT asset_id, chunk_index, chunk_offset, first + k AS sample_index FROM (SELECT *, unnest(range(per)) AS k FROM b))"""


def _chunks(v):
    r = v.runs
    chunks = r.select("asset_id", (F.col("run_index") + 1).alias("chunk_index"), (F.col("run_count") * 1000).alias("chunk_offset"))
    cmap = r.where("run_count > 12 OR run_index = 0").select(
        "asset_id", (F.col("run_index") + 1).alias("first_chunk"), (1 + idiv("value", 512) % 3).alias("samples_per_chunk"))
    sizes = expand.expand_runs(r.select("asset_id", "run_index", (idiv("value", 512) % 4).alias("run_count"), "value"), hot=v.hot_runs)
    return chunks, cmap, sizes


@query("X2_sample_offsets", _X2_SQL + """
SELECT p.asset_id, p.chunk_index, p.sample_index, s.size, CAST(p.chunk_offset + coalesce(sum(s.size) OVER (PARTITION BY p.asset_id, p.chunk_index ORDER BY p.sample_index
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset
FROM p JOIN sz s ON p.asset_id = s.asset_id AND p.sample_index = s.sample_index""")
def _(v):
    chunks, cmap, sizes = _chunks(v)
    return expand.sample_offsets(chunks, cmap, sizes.withColumnRenamed("value", "size"), hot=v.hot_runs)[0]


@query("X2_chunk_coverage", _X2_SQL + """
SELECT s.asset_id, s.n AS sample_count, CAST(coalesce(m.n, 0) AS BIGINT) AS mapped_samples, coalesce(m.n, 0) >= s.n AS covered
FROM (SELECT asset_id, count(*) AS n FROM sz GROUP BY 1) s LEFT JOIN (SELECT asset_id, sum(per) AS n FROM b GROUP BY 1) m USING (asset_id)""")
def _(v):
    chunks, cmap, sizes = _chunks(v)
    return expand.sample_offsets(chunks, cmap, sizes.withColumnRenamed("value", "size"), hot=v.hot_runs)[1]


@query("X3_loop_replay", """
WITH s AS (SELECT broadcast_id, track_name, max(group_id) + 1 AS span FROM objects_v GROUP BY 1, 2),
c AS (SELECT broadcast_id, max(media_time_us + media_duration_us) AS len FROM objects_v GROUP BY 1)
SELECT o.broadcast_id, o.plan_index, k AS cycle, group_id + span * k AS group_id, object_id, media_time_us + len * k AS media_time_us
FROM objects_v o JOIN s ON o.broadcast_id = s.broadcast_id AND o.track_name = s.track_name JOIN c ON o.broadcast_id = c.broadcast_id, (SELECT unnest(range(3)) AS k)""")
def _(v):
    return expand.replay(v.objects, 3).select("broadcast_id", "plan_index", "cycle", "group_id", "object_id", "media_time_us")


@query("X4_sync_marks", """
WITH l AS (SELECT asset_id, handler_type, sample_index + 1 AS n FROM samples_v WHERE sync AND handler_type = 'vide')
SELECT s.asset_id, s.handler_type, s.sample_index, CASE WHEN h.asset_id IS NOT NULL THEN l.n IS NOT NULL ELSE s.handler_type <> 'vide' END AS sync
FROM samples_v s LEFT JOIN (SELECT DISTINCT asset_id, handler_type FROM l) h ON s.asset_id = h.asset_id AND s.handler_type = h.handler_type
LEFT JOIN l ON l.asset_id = s.asset_id AND l.handler_type = s.handler_type AND l.n = s.sample_index + 1""")
def _(v):
    listed = v.samples.where("sync AND handler_type = 'vide'").select("asset_id", "handler_type", (F.col("sample_index") + 1).alias("sync_number"))
    return expand.mark_sync(v.samples.drop("sync"), listed, ["asset_id", "handler_type"]).select("asset_id", "handler_type", "sample_index", "sync")
