"""Queries on catalogs: diff, validation, change log, end of broadcast, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import catalog, relate, sets
from medialake.operators.catalog import Catalog
from medialake.plans.registry import query

_FIELDS = "position, packaging, event_type, role, is_live, bitrate, samplerate, channel_config, track_duration_ms, label, init_ref"
_SAME = " AND ".join(f"b.{c} IS NOT DISTINCT FROM a.{c}" for c in _FIELDS.split(", ")[1:])
_KEYED = """
WITH b AS (SELECT *, coalesce(namespace, '') AS ns FROM cat_before), a AS (SELECT *, coalesce(namespace, '') AS ns FROM cat_after)"""


@query("J8_catalog_diff", _KEYED + f"""
SELECT coalesce(a.broadcast_id, b.broadcast_id) AS broadcast_id, coalesce(a.ns, b.ns) AS namespace, coalesce(a.name, b.name) AS name,
  CASE WHEN b.name IS NULL THEN 'add' WHEN a.name IS NULL THEN 'remove' WHEN {_SAME} THEN 'same' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.broadcast_id = b.broadcast_id AND a.ns = b.ns AND a.name = b.name""")
def _(v):
    return catalog.catalog_diff(v.cat_before, v.cat_after)


@query("U2_catalog_added", "SELECT broadcast_id, name FROM cat_after EXCEPT SELECT broadcast_id, name FROM cat_before")
def _(v):
    return sets.catalog_added(v.cat_before, v.cat_after, ["broadcast_id", "name"])


@query("U2_catalog_removed", "SELECT broadcast_id, name FROM cat_before EXCEPT SELECT broadcast_id, name FROM cat_after")
def _(v):
    return sets.catalog_removed(v.cat_before, v.cat_after, ["broadcast_id", "name"])


@query("U6_catalog_equality", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY position) AS p FROM cat_before),
a AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY position) AS p FROM cat_after WHERE broadcast_id > 12 UNION ALL
      SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY position) AS p FROM cat_before WHERE broadcast_id <= 12)
SELECT coalesce(a.broadcast_id, b.broadcast_id) AS broadcast_id, bool_and(a.p IS NOT NULL AND b.p IS NOT NULL AND a.name = b.name AND {_SAME} AND a.namespace IS NOT DISTINCT FROM b.namespace) AS equal
FROM a FULL JOIN b ON a.broadcast_id = b.broadcast_id AND a.p = b.p GROUP BY 1""")
def _(v):
    after = v.cat_after.where("broadcast_id > 12").unionByName(v.cat_before.where("broadcast_id <= 12"))
    return catalog.catalogs_equal(Catalog(v.cat_before), Catalog(after))


_RULES = """
SELECT broadcast_id, name AS track, 'packaging is empty' AS rule FROM cat_before WHERE packaging = ''
UNION ALL SELECT broadcast_id, name, 'bitrate is missing' FROM cat_before WHERE bitrate IS NULL
UNION ALL SELECT broadcast_id, name, 'eventType is missing' FROM cat_before WHERE packaging = 'eventtimeline' AND event_type IS NULL
UNION ALL SELECT broadcast_id, name, 'eventType is not allowed' FROM cat_before WHERE packaging <> 'eventtimeline' AND event_type IS NOT NULL
UNION ALL SELECT broadcast_id, name, 'trackDuration on a live track' FROM cat_before WHERE is_live AND track_duration_ms IS NOT NULL
UNION ALL SELECT broadcast_id, name, 'audio needs samplerate and channelConfig' FROM cat_before WHERE role = 'audio' AND (samplerate IS NULL OR channel_config IS NULL)
UNION ALL SELECT broadcast_id, name, 'stray percent in label' FROM cat_before WHERE label = '50% off'"""


@query("L1_validate_catalog", _RULES + """
UNION ALL SELECT broadcast_id, name, 'initRef has no init data' FROM cat_before WHERE init_ref NOT IN (SELECT id FROM cat_inits)
UNION ALL SELECT broadcast_id, name, 'duplicate track name' FROM cat_before GROUP BY broadcast_id, coalesce(namespace, ''), name HAVING count(*) > 1""")
def _(v):
    return catalog.validate_catalog(Catalog(v.cat_before, inits=v.cat_inits))


@query("L1_validate_tracks", _RULES)
def _(v):
    return catalog.validate_tracks(v.cat_before)


@query("J10_dangling_refs", """
SELECT broadcast_id, name, init_ref FROM cat_before WHERE init_ref NOT IN (SELECT id FROM cat_inits)""")
def _(v):
    return relate.dangling_refs(v.cat_before, v.cat_inits).select("broadcast_id", "name", "init_ref")


_LOG_SQL = """
WITH RECURSIVE ver AS (SELECT broadcast_id, version_seq, row_number() OVER (PARTITION BY broadcast_id ORDER BY version_seq) AS vn
             FROM (SELECT DISTINCT broadcast_id, version_seq FROM snapshots_v)),
s AS (SELECT x.broadcast_id, x.name, x.bitrate, vn FROM snapshots_v x JOIN ver USING (broadcast_id, version_seq)),
chg AS (SELECT broadcast_id, vn, sum(CASE WHEN op = 'add' THEN 1 ELSE 0 END) AS added, sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END) AS removed,
          sum(CASE WHEN op = 'change' THEN 1 ELSE 0 END) AS changed FROM (
   SELECT coalesce(a.broadcast_id, b.broadcast_id) AS broadcast_id, coalesce(a.vn, b.vn + 1) AS vn,
     CASE WHEN b.name IS NULL THEN 'add' WHEN a.name IS NULL THEN 'remove' WHEN a.bitrate <> b.bitrate THEN 'change' END AS op
   FROM s a FULL JOIN s b ON a.broadcast_id = b.broadcast_id AND a.name = b.name AND a.vn = b.vn + 1) WHERE op IS NOT NULL GROUP BY 1, 2),
d AS (SELECT v.broadcast_id, v.version_seq, v.vn, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed
      FROM ver v LEFT JOIN chg c ON v.broadcast_id = c.broadcast_id AND v.vn = c.vn),
walk AS (SELECT broadcast_id, vn, version_seq, 0 AS grp, 0 AS obj, true AS emitted, added, removed FROM d WHERE vn = 1
   UNION ALL
   SELECT d.broadcast_id, d.vn, d.version_seq,
     CASE WHEN d.changed > 0 OR ((d.added + d.removed) > 0 AND w.obj >= 8) THEN w.grp + 1 ELSE w.grp END,
     CASE WHEN d.changed > 0 THEN 0 WHEN d.added + d.removed = 0 THEN w.obj WHEN w.obj >= 8 THEN 0 ELSE w.obj + 1 END,
     d.changed > 0 OR d.added + d.removed > 0, d.added, d.removed
   FROM d JOIN walk w ON d.broadcast_id = w.broadcast_id AND d.vn = w.vn + 1)
SELECT broadcast_id, version_seq, CASE WHEN obj = 0 THEN 'independent' ELSE 'delta' END AS kind, grp AS group_id, obj AS object_id, 0 AS subgroup_id,
  CASE WHEN obj > 0 THEN CAST(added AS BIGINT) END AS added, CASE WHEN obj > 0 THEN CAST(removed AS BIGINT) END AS removed
FROM walk WHERE emitted"""


@query("L2_catalog_log", _LOG_SQL)
def _(v):
    return catalog.catalog_log(v.snapshots, hot=v.hot_nations)


@query("L2_version_changes", _LOG_SQL[:_LOG_SQL.index("chg AS (")].replace("RECURSIVE ", "").rstrip().rstrip(",") + """
SELECT c.broadcast_id, v.version_seq, namespace, name, op FROM (
   SELECT coalesce(a.broadcast_id, b.broadcast_id) AS broadcast_id, coalesce(a.vn, b.vn + 1) AS vn, 'ns' AS namespace, coalesce(a.name, b.name) AS name,
     CASE WHEN b.name IS NULL THEN 'add' WHEN a.name IS NULL THEN 'remove' WHEN a.bitrate <> b.bitrate THEN 'change' END AS op
   FROM s a FULL JOIN s b ON a.broadcast_id = b.broadcast_id AND a.name = b.name AND a.vn = b.vn + 1) c
JOIN ver v ON v.broadcast_id = c.broadcast_id AND v.vn = c.vn WHERE op IS NOT NULL AND v.vn > 1""")
def _(v):
    return catalog.version_changes(v.snapshots, hot=v.hot_nations)


@query("L4_force_independent", f"""
WITH log AS ({_LOG_SQL.strip()}),
asked AS (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY request_seq) AS n FROM (SELECT DISTINCT broadcast_id, version_seq + 1 AS request_seq FROM snapshots_v WHERE version_seq % 7 IN (0, 3)))
SELECT a.broadcast_id, a.request_seq, l.version_seq, 'independent' AS kind, CAST(l.group_id + n AS BIGINT) AS group_id, CAST(0 AS BIGINT) AS object_id
FROM asked a ASOF JOIN log l ON a.broadcast_id = l.broadcast_id AND a.request_seq >= l.version_seq""")
def _(v):
    asked = v.snapshots.where("version_seq % 7 IN (0, 3)").select("broadcast_id", (F.col("version_seq") + 1).alias("request_seq")).distinct()
    return catalog.force_independent(catalog.catalog_log(v.snapshots, hot=v.hot_nations), asked)[0]


@query("L5_changes_after_end", """
WITH ver AS (SELECT DISTINCT broadcast_id, version_seq FROM snapshots_v)
SELECT broadcast_id, version_seq, 'change after end of broadcast' AS violation FROM ver
WHERE version_seq > (SELECT min(version_seq) FROM ver e WHERE e.broadcast_id = ver.broadcast_id AND e.version_seq >= 30 + e.broadcast_id % 5)""")
def _(v):
    versions = v.snapshots.select("broadcast_id", "version_seq").distinct().withColumn("ended", F.col("version_seq") >= 30 + F.col("broadcast_id") % 5)
    return catalog.changes_after_end(versions)


@query("L3_convert_to_vod", """
SELECT broadcast_id, name, false AS is_live, coalesce(duration_ms, track_duration_ms) AS track_duration_ms FROM cat_before
LEFT JOIN (SELECT c_name AS name, 1000 + CAST(floor(c_acctbal) AS BIGINT) AS duration_ms FROM customer WHERE c_acctbal > 5000) USING (name)""")
def _(v):
    dur = v.table("customer").where("c_acctbal > 5000").select(F.col("c_name").alias("name"), (1000 + F.floor("c_acctbal").cast("bigint")).alias("duration_ms"))
    out = catalog.end_broadcast(Catalog(v.cat_before, inits=v.cat_inits), dur, "convert")
    return out.tracks.select("broadcast_id", "name", "is_live", "track_duration_ms")


@query("L3_terminate", """
SELECT c_nationkey AS broadcast_id, '1' AS version, true AS is_complete, CAST(count(*) AS BIGINT) AS tracks_before, CAST(0 AS BIGINT) AS tracks_after FROM customer GROUP BY 1""")
def _(v):
    header = v.table("customer").select(F.col("c_nationkey").alias("broadcast_id"), F.lit("1").alias("version")).distinct()
    done = catalog.end_broadcast(Catalog(v.cat_before, header=header), v.cat_before, "terminate")

    def held(tracks, name):
        return tracks.groupBy("broadcast_id").agg(F.count(F.lit(1)).alias(name))

    return done.header.join(held(v.cat_before, "tracks_before"), ["broadcast_id"]).join(held(done.tracks, "tracks_after"), ["broadcast_id"], "left").withColumn(
        "tracks_after", F.coalesce("tracks_after", F.lit(0).cast("bigint")))


@query("S10_catalog_json", """
WITH t AS (SELECT broadcast_id, pos // 10000 AS part_index, string_agg('{"name":"' || name || '"' || coalesce(',"namespace":"' || namespace || '"', '') || ',"packaging":"' || packaging || '"'
  || coalesce(',"eventType":"' || event_type || '"', '') || ',"role":"' || role || '","isLive":' || is_live || coalesce(',"label":"' || label || '"', '')
  || ',"initRef":"' || init_ref || '"' || coalesce(',"bitrate":' || bitrate, '') || coalesce(',"samplerate":' || samplerate, '')
  || coalesce(',"channelConfig":"' || channel_config || '"', '') || coalesce(',"trackDuration":' || track_duration_ms, '') || '}', ',' ORDER BY pos) AS tracks
  FROM (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY position) - 1 AS pos FROM cat_before) GROUP BY 1, 2),
i AS (SELECT broadcast_id, pos // 10000 AS part_index, string_agg('{"id":"' || id || '","type":"' || type || '","data":"' || data || '"}', ',' ORDER BY pos) AS inits
  FROM (SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY CAST(regexp_extract(id, '#([0-9]+)', 1) AS BIGINT), id) - 1 AS pos FROM cat_inits) GROUP BY 1, 2)
SELECT broadcast_id, part_index, CASE WHEN part_index = 0 THEN 'independent' ELSE 'delta' END AS kind,
  '{' || CASE WHEN part_index = 0 THEN '"version":"1","tracks":[' || coalesce(tracks, '') || ']' || coalesce(',"initDataList":[' || inits || ']', '')
    ELSE concat_ws(',', '"deltaUpdate":[{"op":"add","tracks":[' || tracks || ']}]', '"initDataList":[' || inits || ']') END || '}' AS document
FROM t FULL JOIN i USING (broadcast_id, part_index)""")
def _(v):
    inits = v.cat_inits.withColumn("position", F.regexp_extract("id", "#([0-9]+)", 1).cast("bigint"))
    return catalog.catalog_json(Catalog(v.cat_before, inits=inits))
