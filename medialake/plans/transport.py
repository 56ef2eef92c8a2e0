"""Queries on transport-stream packets, program tables and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.operators import order, relate, rollup, sequence, sets
from medialake.operators.links import build_links, parse_links
from medialake.plans.registry import query

_PROG = """
WITH p AS (SELECT file_id, arg_min(program, position) AS program, arg_min(pmt_pid, position) AS pmt_pid FROM pat_v WHERE program <> 0 GROUP BY 1),
pids AS (SELECT DISTINCT file_id, pid FROM (SELECT file_id, unnest([0, pmt_pid, pcr_pid, elementary_pid]) AS pid FROM pmt_v JOIN p USING (file_id, program)
         UNION ALL SELECT file_id, unnest([0, pmt_pid]) FROM p))"""


@query("O5_pick_program", """
SELECT file_id, arg_min(program, position) AS program, arg_min(pmt_pid, position) AS pmt_pid FROM pat_v WHERE program <> 0 GROUP BY 1""")
def _(v):
    return order.pick_program(v.pat)


@query("O6_pick_streams", """
SELECT file_id, program, arg_min(CASE WHEN stream_type IN (27, 36, 2) THEN elementary_pid END, CASE WHEN stream_type IN (27, 36, 2) THEN position END) AS video_pid,
  arg_min(CASE WHEN stream_type IN (15, 17, 3, 4) THEN elementary_pid END, CASE WHEN stream_type IN (15, 17, 3, 4) THEN position END) AS audio_pid FROM pmt_v GROUP BY 1, 2""")
def _(v):
    return order.pick_streams(v.pmt)


@query("U4_program_pids", _PROG + " SELECT file_id, pid FROM pids")
def _(v):
    return sets.program_pids(order.pick_program(v.pat), v.pmt)


@query("J13_select_program", _PROG + """
SELECT file_id, packet_index, pid FROM packets_v WHERE pid = 8191 OR (file_id, pid) IN (SELECT (file_id, pid) FROM pids)""")
def _(v):
    pids = sets.program_pids(order.pick_program(v.pat), v.pmt)
    return relate.select_program(v.packets.withColumn("pid", F.col("pid").cast("bigint")), pids).select("file_id", "packet_index", "pid")


@query("A18_pid_inventory", """
SELECT file_id, pid, count(*) AS packets, CAST(sum(CASE WHEN pusi THEN 1 ELSE 0 END) AS BIGINT) AS unit_starts,
  CAST(sum(CASE WHEN pid <> 8191 AND p IS NOT NULL AND continuity <> (p + 1) % 16 THEN 1 ELSE 0 END) AS BIGINT) AS continuity_gaps
FROM (SELECT *, lag(continuity) OVER (PARTITION BY file_id, pid ORDER BY packet_index) AS p FROM packets_v) GROUP BY 1, 2""")
def _(v):
    return rollup.pid_inventory(v.packets, hot=v.hot_files)


@query("W11_packetise", """
WITH a AS (SELECT file_id, packet_index, row_number() OVER (PARTITION BY file_id ORDER BY packet_index) - 1 AS r FROM packets_v),
b AS (SELECT file_id, packet_index, CAST(r // 7 AS BIGINT) AS object_id, CAST(r % 7 AS BIGINT) AS slot, false AS is_psi FROM a),
l AS (SELECT file_id, max(object_id) AS last FROM b GROUP BY 1),
psi AS (SELECT DISTINCT file_id, pid FROM packets_v WHERE pid IN (0, 256))
SELECT *, object_id * 10000 AS media_time_us FROM (SELECT * FROM b UNION ALL
  SELECT psi.file_id, NULL, CAST(o AS BIGINT), CASE WHEN pid = 0 THEN 0 ELSE 1 END - 1000000, true FROM psi JOIN (SELECT file_id, unnest(range(0, last + 1, 50)) AS o FROM l) t ON psi.file_id = t.file_id)""")
def _(v):
    psi = v.packets.where(F.col("pid").isin(0, 256)).select("file_id", "pid").distinct().withColumn("psi_order", F.when(F.col("pid") == 0, 0).otherwise(1))
    return sequence.packetise(v.packets, psi, hot=v.hot_files).select("file_id", "packet_index", "object_id", "slot", "is_psi", "media_time_us")


@query("W12_continuity_renumber", """
SELECT file_id, pid, packet_index, CAST((row_number() OVER (PARTITION BY file_id, pid ORDER BY packet_index) - 1) % 16 AS BIGINT) AS continuity FROM packets_v WHERE pid IN (0, 256, 272)""")
def _(v):
    d = v.packets.where(F.col("pid").isin(0, 256, 272))
    return sequence.renumber_continuity(d, hot=v.hot_files).select("file_id", "pid", "packet_index", "continuity")


@query("F3_build_links", """
SELECT o_orderkey, 'moqt://h' || (o_custkey % 50) || '.example' || CASE WHEN o_orderkey % 3 = 0 THEN ':' || (4000 + o_orderkey % 3) ELSE '' END
  || CASE WHEN o_orderstatus = 'F' THEN '/relay' ELSE '' END || '#msf:live-c' || o_custkey || '--t' || (o_orderkey % 7)
  || CASE WHEN o_orderstatus = 'O' THEN '&connection=wt' ELSE '' END
  || '&mediatime-range=' || (o_orderkey % 900) || CASE WHEN o_orderkey % 2 = 0 THEN '-' || (o_orderkey % 900 + 50) ELSE '' END AS url FROM orders""")
def _(v):
    return _links(v)


def _links(v):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = v.table("orders").select(
        "o_orderkey", F.concat(F.lit("h"), (c % 50).cast("string"), F.lit(".example")).alias("host"),
        F.when(o % 3 == 0, 4000 + o % 3).otherwise(443).cast("int").alias("port"),
        F.lit("/relay").alias("path"), (F.col("o_orderstatus") == "F").alias("path_explicit"),
        F.array(F.lit("live"), F.concat(F.lit("c"), c.cast("string"))).alias("namespace"),
        F.concat(F.lit("t"), (o % 7).cast("string")).alias("track_name"),
        F.when(F.col("o_orderstatus") == "O", "wt").alias("connection"),
        F.array(F.struct((o % 900).alias("start_ms"), F.when(o % 2 == 0, o % 900 + 50).alias("end_ms"))).alias("mediatime"))
    return build_links(d).select("o_orderkey", "url")


_URL_SQL = """
SELECT o_orderkey, 'h' || (o_custkey % 50) || '.example' AS host, CASE WHEN o_orderkey % 3 = 0 THEN 4000 + o_orderkey % 3 ELSE 443 END AS port,
  CASE WHEN o_orderstatus = 'F' THEN '/relay' ELSE '' END AS path, 'live|c' || o_custkey AS namespace, 't' || (o_orderkey % 7) AS track_name,
  CASE WHEN o_orderstatus = 'O' THEN 'wt' END AS connection, o_orderkey % 900 AS start_ms, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 900 + 50 END AS end_ms,
  o_totalprice > 400000 AS broken FROM orders"""


def _some_broken(v):
    """The built links, those of the dearest orders with a second connection parameter."""
    d = _links(v).join(v.table("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return d.select("o_orderkey", F.when(F.col("o_totalprice") > 400000, F.concat("url", F.lit("&connection=q&connection=q"))).otherwise(F.col("url")).alias("url"))


@query("F2_parse_links", f"SELECT * EXCLUDE (broken) FROM ({_URL_SQL}) WHERE NOT broken")
def _(v):
    links, _rejects = parse_links(_some_broken(v))
    return links.select("o_orderkey", "host", "port", "path", F.array_join("namespace", "|").alias("namespace"), "track_name", "connection",
                        F.get("mediatime", F.lit(0))["start_ms"].alias("start_ms"), F.get("mediatime", F.lit(0))["end_ms"].alias("end_ms"))


@query("F2_rejected_links", f"SELECT o_orderkey, 'connection is repeated' AS error FROM ({_URL_SQL}) WHERE broken")
def _(v):
    return parse_links(_some_broken(v))[1].select("o_orderkey", "error")
