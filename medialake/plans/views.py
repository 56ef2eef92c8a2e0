"""Media entities derived from the driver tables, on Spark and as DuckDB views.

Each view is one whole table (or a join of whole tables) re-read as a media
entity: events as fragments, lineitem as samples, orders as subscriptions and
links, customer as catalog tracks. The SQL twin of a view stands next to it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.timing import idiv, micros_of
from medialake.operators.ordered import HotKeys, by_heat, find_hot, row_index, seq_span, stage

EPOCH_US = 1704067200000000  # first instant of the events table's year

SQL: dict[str, str] = {}


def md5_uuid(c: Column) -> Column:
    h = F.md5(c)
    return F.concat_ws("-", *[F.substring(h, s, n) for s, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])


def _md5_uuid_sql(expr: str) -> str:
    h = f"md5({expr})"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({h}, {s}, {n})" for s, n in cuts)


SQL["frags_v"] = """
SELECT user_id AS feed_id, user_id AS asset_id, event_id AS arrival_seq, event_type,
       CASE WHEN event_type IN ('signup','view','click') THEN 'vide' ELSE 'soun' END AS handler_type,
       event_type = 'signup' AS is_sync,
       'u' || user_id || '_' || CASE WHEN event_type IN ('signup','view','click') THEN 'vide' ELSE 'soun' END AS track_name,
       2 * user_id + CASE WHEN event_type IN ('signup','view','click') THEN 0 ELSE 1 END AS track_id,
       epoch_us(ts) AS start_us, CAST(round(value * 100) AS BIGINT) AS payload_bytes,
       1000 * (1 + event_id % 50) AS duration_us,
       CAST(CASE WHEN event_type IN ('signup','view','click') THEN 90000 ELSE 48000 END AS BIGINT) AS timescale,
       CAST(CASE WHEN event_type IN ('view','click') THEN 16842752 ELSE 33554432 END AS BIGINT) AS flags,
       event_id * 512 AS decode_ticks, (event_id % 9 - 4) * 1000 AS composition_offset
FROM events"""

SQL["shared_v"] = """
SELECT feed_id % 8 AS session_id, feed_id AS path, track_name, handler_type, is_sync, arrival_seq, duration_us,
       payload_bytes, start_us - (arrival_seq % 7) * 600000000 AS start_us
FROM frags_v"""

SQL["es_v"] = """
SELECT feed_id, track_name, handler_type = 'vide' AS is_video, is_sync AS keyframe, arrival_seq, timescale,
       (arrival_seq // 8) * 20000 + CASE arrival_seq % 11 WHEN 0 THEN -90000 WHEN 5 THEN 900000 ELSE 0 END + 1000000 AS pts_us
FROM frags_v"""

SQL["objects_v"] = """
SELECT feed_id AS broadcast_id, arrival_seq AS plan_index, track_name, handler_type, is_sync, event_type, group_id, object_id,
       object_id % 2 AS subgroup_id, 'media' AS kind, start_us AS media_time_us, duration_us AS media_duration_us,
       payload_bytes,
       CASE WHEN handler_type <> 'vide' THEN 1 WHEN is_sync THEN 2 ELSE 0 END AS sap_type
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY feed_id, group_id, track_name ORDER BY arrival_seq) - 1 AS BIGINT) AS object_id
      FROM (SELECT *, CAST(sum(CASE WHEN handler_type = 'vide' AND is_sync THEN 1 ELSE 0 END)
                   OVER (PARTITION BY feed_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_id
            FROM frags_v) WHERE group_id >= 0)"""

SQL["samples_v"] = """
SELECT (l_orderkey % 50) // 2 AS asset_id, CASE WHEN l_orderkey % 2 = 0 THEN 'vide' ELSE 'soun' END AS handler_type,
       CAST(CASE WHEN l_orderkey % 2 = 0 THEN 48000 ELSE 90000 END AS BIGINT) AS timescale,
       CAST(512 * l_linenumber AS BIGINT) AS duration, CAST(round(l_extendedprice) AS BIGINT) AS size,
       l_partkey % 97 = 0 AS sync, CAST((CAST(l_quantity AS INT) - 25) * 100 AS BIGINT) AS composition_offset,
       CAST(row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS sample_index
FROM lineitem"""

SQL["runs_v"] = """
SELECT l_orderkey AS asset_id, CAST(CAST(l_quantity AS INT) AS BIGINT) AS run_count, CAST(512 * l_linenumber AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS run_index
FROM lineitem"""

SQL["tracks_v"] = """
SELECT p_partkey // 2 + away AS asset_id, p_partkey + 2 * away AS track_id, CASE WHEN p_partkey % 2 = 0 THEN 'vide' ELSE 'soun' END AS handler_type,
       'u' || (p_partkey // 2 + away) || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'vide' ELSE 'soun' END AS track_name,
       CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type END AS codec, 'cmaf' AS packaging, '' AS mime_type, '' AS event_type,
       CAST(CASE WHEN p_partkey % 2 = 0 THEN 90000 ELSE 48000 END AS BIGINT) AS timescale,
       CASE WHEN p_partkey % 2 = 0 THEN p_size * 16 ELSE 0 END AS width, CASE WHEN p_partkey % 2 = 0 THEN p_size % 10 * 9 ELSE 0 END AS height,
       CASE WHEN p_size % 7 = 0 THEN 0 ELSE 48000 END AS sample_rate, 1 + p_size % 2 AS channel_count,
       CAST(CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_size * 0.5 END AS DOUBLE) AS frame_rate,
       CASE WHEN p_size % 3 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) ELSE 0 END AS max_bitrate,
       CASE WHEN p_size % 5 = 0 THEN CAST(round(p_retailprice * 50) AS BIGINT) ELSE 0 END AS avg_bitrate,
       CAST(p_size * 1000 AS BIGINT) AS duration_ms,
       CASE p_partkey % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'fra' WHEN 2 THEN 'deu' WHEN 3 THEN 'und' ELSE 'haw' END AS language
FROM (SELECT *, CAST(CASE WHEN p_brand = 'Brand#7' THEN 100000000 ELSE 0 END AS BIGINT) AS away FROM part)"""

SQL["subs_v"] = """
SELECT o_orderkey AS request_id, o_custkey // 10 AS feed_id,
       'u' || (o_custkey // 10) || '_' || CASE WHEN o_orderstatus = 'O' THEN 'vide' ELSE 'soun' END AS track_name,
       1 + o_orderkey % 4 AS filter_type, o_orderkey % 10 AS start_group, o_orderkey % 3 AS start_object,
       o_orderkey % 10 + o_custkey % 5 AS end_group, o_orderstatus <> 'P' AS forward, epoch_us(o_orderdate) AS subscribe_us
FROM orders"""

SQL["links_v"] = """
SELECT o_custkey AS link_id, o_orderkey AS range_id,
       'u' || (o_custkey // 10) || '_' || CASE WHEN o_custkey % 2 = 0 THEN 'vide' ELSE 'soun' END AS track_name,
       1000 * ((o_orderkey * 7919) % 2592000) AS start_ms,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 1000 * ((o_orderkey * 7919) % 2592000) + 60000 * (o_custkey % 600) END AS end_ms,
       o_orderkey % 100 AS start_group, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS start_object,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 100 + o_custkey % 4 END AS end_group,
       CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE 2 + o_orderkey % 5 END AS end_object
FROM orders"""

_CAT_SQL = """
SELECT c_nationkey AS broadcast_id, c_custkey AS position, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'ns' || c_nationkey END AS namespace,
       c_name || CASE WHEN c_mktsegment = '{segment}' THEN '-{tag}' ELSE '' END AS name, CASE WHEN c_custkey % 31 = 0 THEN 'eventtimeline' WHEN c_custkey % 101 = 0 THEN '' ELSE 'cmaf' END AS packaging,
       CASE WHEN c_custkey % 29 = 0 THEN 'ev' END AS event_type,
       CASE WHEN c_custkey % 2 = 1 THEN 'audio' ELSE 'video' END AS role, c_custkey % 3 <> 0 AS is_live,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE {bitrate} END AS bitrate,
       CAST(CASE WHEN c_custkey % 4 = 1 THEN 48000 END AS BIGINT) AS samplerate, CASE WHEN c_custkey % 4 = 1 THEN '2' END AS channel_config,
       CAST(CASE WHEN c_custkey % 23 = 0 THEN 60000 END AS BIGINT) AS track_duration_ms,
       CASE WHEN c_custkey % 41 = 0 THEN '50% off' WHEN c_custkey % 43 = 0 THEN '%name%' END AS label,
       c_name || '-init' AS init_ref
FROM customer"""
SQL["cat_before"] = _CAT_SQL.format(bitrate="CAST(1000000 + c_custkey AS BIGINT)", segment="AUTOMOBILE", tag="old")
SQL["cat_after"] = _CAT_SQL.format(
    bitrate="CAST(1000000 + c_custkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT)", segment="MACHINERY", tag="new"
)
SQL["cat_inits"] = """
SELECT c_nationkey AS broadcast_id, c_name || CASE WHEN c_acctbal > 0 THEN '-init' ELSE '-spare' END AS id, 'inline' AS type, md5(c_name) AS data
FROM customer"""

SQL["snapshots_v"] = """
SELECT broadcast_id, 2 * quarter + half AS version_seq, 'ns' AS namespace, name,
       CAST(1000000 + CASE WHEN quarter >= 16 THEN 1 ELSE 0 END AS BIGINT) AS bitrate
FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS broadcast_id, c_name AS name,
             CAST((year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS quarter
      FROM orders JOIN customer ON o_custkey = c_custkey), (SELECT unnest([0, 1]) AS half)"""

SQL["systems_v"] = f"""
SELECT s_suppkey AS asset_id, k AS system_seq, {_md5_uuid_sql("'system' || k")} AS system_id, md5(s_name || k) AS pssh
FROM (SELECT *, unnest(range(s_nationkey % 4)) AS k FROM supplier)"""
SQL["ptracks_v"] = f"""
SELECT p_partkey // 20 AS asset_id, p_partkey AS track_seq, 't' || p_partkey AS track_name, p_size % 4 <> 0 AS is_protected,
       CASE WHEN p_size % 2 = 0 THEN 'cenc' ELSE 'cbcs' END AS scheme, {_md5_uuid_sql("p_brand")} AS kid
FROM part"""

SQL["trace_v"] = """
SELECT event_id AS send_seq, CASE event_id % 3 WHEN 0 THEN 'pacing_before' WHEN 1 THEN 'pacing_after' ELSE 'enqueue' END AS event,
       track_name AS track, group_of AS group_id, target_ms, target_ms + delta_ms AS now_ms, delta_ms,
       payload_bytes, payload_bytes + 8 + event_id % 5 AS wire_bytes,
       CASE WHEN event_id % 20 = 0 OR event_id % 20 = 5 THEN 1 ELSE 0 END AS opened, CASE WHEN event_id % 20 = 11 THEN 1 ELSE 0 END AS fin, start_us
FROM (SELECT arrival_seq AS event_id, track_name, arrival_seq // 50 AS group_of, start_us // 1000 AS target_ms,
             (arrival_seq * 37) % 400 - 100 AS delta_ms, payload_bytes, start_us FROM frags_v)"""

SQL["packets_v"] = """
SELECT user_id % 10 AS file_id, event_id AS packet_index,
       CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 256 WHEN 2 THEN 257 WHEN 3 THEN 272 ELSE 8191 END AS pid,
       event_id % 3 = 0 AS pusi, (event_id // 5 - CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END + 16) % 16 AS continuity
FROM events"""

SQL["pat_v"] = """
SELECT s_suppkey // 5 AS file_id, s_suppkey % 5 AS position, s_nationkey % 4 AS program, 256 + 16 * s_nationkey AS pmt_pid
FROM supplier"""
SQL["pmt_v"] = """
SELECT c_custkey // 75 AS file_id, c_custkey % 75 AS position, c_nationkey % 4 AS program,
       CASE c_custkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 27 WHEN 2 THEN 15 WHEN 3 THEN 36 ELSE 3 END AS stream_type,
       257 + c_custkey % 75 AS elementary_pid, 258 + c_nationkey AS pcr_pid
FROM customer"""

SQL["announce_v"] = """
SELECT feed_id, event_type AS track, min(start_us) AS announce_us FROM frags_v GROUP BY 1, 2"""


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({SQL[n].strip()})" for n in needed)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


class Views:
    """The Spark side of the fixture views over the parquet tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def hot_feeds(self) -> HotKeys:
        """Feeds too large for one task, from one pass over one column of the source."""
        return find_hot(self.table("events").select(F.col("user_id").alias("feed_id")), ["feed_id"])

    @cached_property
    def hot_assets(self) -> HotKeys:
        return self.hot_feeds.renamed(feed_id="asset_id")

    @cached_property
    def hot_broadcasts(self) -> HotKeys:
        return self.hot_feeds.renamed(feed_id="broadcast_id")

    @cached_property
    def hot_tracks(self) -> HotKeys:
        """Tracks with more objects and filter ends than one task should order: a bound from events and orders."""
        o = self.table("events").groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n"))
        s = self.table("orders").groupBy(idiv("o_custkey", 10).alias("u")).agg((2 * F.count(F.lit(1))).alias("n"))
        big = o.unionByName(s).groupBy("u").agg(F.sum("n").alias("n")).where(F.col("n") > seq_span(self.spark))
        names = big.select(F.explode(F.array(*[F.concat(F.lit("u"), F.col("u").cast("string"), F.lit(f"_{h}")) for h in ("vide", "soun")])).alias("track_name"))
        return HotKeys(("track_name",), None if big.isEmpty() else stage(names))

    @cached_property
    def hot_sessions(self) -> HotKeys:
        return find_hot(self.table("events").select((F.col("user_id") % 8).alias("session_id")), ["session_id"])

    @cached_property
    def hot_shards(self) -> HotKeys:
        return find_hot(self.table("lineitem").select((F.col("l_orderkey") % 50).alias("shard")), ["shard"])

    @cached_property
    def hot_samples(self) -> HotKeys:
        rows = self.hot_shards.rows
        return HotKeys(("asset_id",), None if rows is None else rows.select(idiv("shard", 2).alias("asset_id")).distinct())

    @cached_property
    def hot_links(self) -> HotKeys:
        return find_hot(self.table("orders").select(F.col("o_custkey").alias("link_id")), ["link_id"])

    @cached_property
    def hot_nations(self) -> HotKeys:
        """Broadcasts of the snapshot view: a bound from each nation's customers times 80 versions."""
        n = self.table("customer").groupBy(F.col("c_nationkey").cast("bigint").alias("broadcast_id")).agg((80 * F.count(F.lit(1))).alias("n"))
        big = n.where(F.col("n") > seq_span(self.spark)).select("broadcast_id")
        return HotKeys(("broadcast_id",), None if big.isEmpty() else stage(big))

    @cached_property
    def hot_files(self) -> HotKeys:
        return find_hot(self.table("events").select((F.col("user_id") % 10).alias("file_id")), ["file_id"])

    @cached_property
    def hot_matches(self) -> HotKeys:
        """Broadcasts whose subscriptions times objects pass the size of one task: a bound on their matches."""
        o = self.table("events").groupBy(F.col("user_id").alias("broadcast_id")).agg(F.count(F.lit(1)).alias("n"))
        s = self.table("orders").groupBy(idiv("o_custkey", 10).alias("broadcast_id")).agg(F.count(F.lit(1)).alias("m"))
        big = o.join(s, ["broadcast_id"]).where(F.col("n") * F.col("m") > seq_span(self.spark)).select("broadcast_id")
        return HotKeys(("broadcast_id",), None if big.isEmpty() else stage(big))

    @cached_property
    def hot_runs(self) -> HotKeys:
        return find_hot(self.table("lineitem").select(F.col("l_orderkey").alias("asset_id")), ["asset_id"])

    @cached_property
    def frags(self) -> DataFrame:
        e = self.table("events")
        video = F.col("event_type").isin("signup", "view", "click")
        handler = F.when(video, "vide").otherwise("soun")
        user, seq = F.col("user_id"), F.col("event_id")
        return e.select(
            user.alias("feed_id"),
            user.alias("asset_id"),
            seq.alias("arrival_seq"),
            "event_type",
            handler.alias("handler_type"),
            (F.col("event_type") == "signup").alias("is_sync"),
            F.concat(F.lit("u"), user.cast("string"), F.lit("_"), handler).alias("track_name"),
            (2 * user + F.when(video, 0).otherwise(1)).alias("track_id"),
            micros_of("ts").alias("start_us"),
            F.round(F.col("value") * 100).cast("bigint").alias("payload_bytes"),
            (1000 * (1 + seq % 50)).alias("duration_us"),
            F.when(video, 90000).otherwise(48000).cast("bigint").alias("timescale"),
            F.when(F.col("event_type").isin("view", "click"), 16842752).otherwise(33554432).cast("bigint").alias("flags"),
            (seq * 512).alias("decode_ticks"),
            ((seq % 9 - 4) * 1000).alias("composition_offset"),
        )

    @cached_property
    def shared(self) -> DataFrame:
        return self.frags.select(
            (F.col("feed_id") % 8).alias("session_id"),
            F.col("feed_id").alias("path"),
            "track_name", "handler_type", "is_sync", "arrival_seq", "duration_us", "payload_bytes",
            (F.col("start_us") - (F.col("arrival_seq") % 7) * 600000000).alias("start_us"),
        )

    @cached_property
    def es(self) -> DataFrame:
        seq = F.col("arrival_seq")
        jump = F.when(seq % 11 == 0, -90000).when(seq % 11 == 5, 900000).otherwise(0)
        return self.frags.select(
            "feed_id", "track_name",
            (F.col("handler_type") == "vide").alias("is_video"),
            F.col("is_sync").alias("keyframe"),
            "arrival_seq", "timescale",
            (idiv(seq, 8) * 20000 + jump + 1000000).alias("pts_us"),
        )

    @cached_property
    def objects(self) -> DataFrame:
        from medialake.functions.timing import sap_type
        from medialake.operators.sequence import assign_groups, number_objects

        f = by_heat(self.frags, self.hot_feeds, lambda part, heat: number_objects(assign_groups(part, hot=heat), hot=heat))
        return f.select(
            F.col("feed_id").alias("broadcast_id"),
            F.col("arrival_seq").alias("plan_index"),
            "track_name", "handler_type", "is_sync", "event_type", "group_id", "object_id",
            (F.col("object_id") % 2).alias("subgroup_id"),
            F.lit("media").alias("kind"),
            F.col("start_us").alias("media_time_us"),
            F.col("duration_us").alias("media_duration_us"),
            "payload_bytes",
            sap_type("handler_type", "flags").alias("sap_type"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        line = self.table("lineitem")
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        even = F.col("l_orderkey") % 2 == 0
        indexed = row_index(line.withColumn("shard", F.col("l_orderkey") % 50), ["shard"], order, "sample_index", hot=self.hot_shards)
        return indexed.select(
            idiv("shard", 2).alias("asset_id"),
            F.when(even, "vide").otherwise("soun").alias("handler_type"),
            F.when(even, 48000).otherwise(90000).cast("bigint").alias("timescale"),
            (512 * F.col("l_linenumber")).cast("bigint").alias("duration"),
            F.round("l_extendedprice").cast("bigint").alias("size"),
            (F.col("l_partkey") % 97 == 0).alias("sync"),
            ((F.col("l_quantity").cast("int") - 25) * 100).cast("bigint").alias("composition_offset"),
            "sample_index",
        )

    @cached_property
    def runs(self) -> DataFrame:
        line = self.table("lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        return row_index(line, ["l_orderkey"], order, "run_index", hot=self.hot_runs.renamed(asset_id="l_orderkey")).select(
            F.col("l_orderkey").alias("asset_id"),
            F.col("l_quantity").cast("int").cast("bigint").alias("run_count"),
            (512 * F.col("l_linenumber")).cast("bigint").alias("value"),
            "run_index",
        )

    @cached_property
    def tracks(self) -> DataFrame:
        p = self.table("part")
        key, size = F.col("p_partkey"), F.col("p_size")
        # tracks of one brand have keys that no fragment or subscription names
        away = F.when(F.col("p_brand") == "Brand#7", 100000000).otherwise(0).cast("bigint")
        even = key % 2 == 0
        handler = F.when(even, "vide").otherwise("soun")
        lang = F.element_at(F.array(*[F.lit(x) for x in ("eng", "fra", "deu", "und", "haw")]), (key % 5 + 1).cast("int"))
        return p.select(
            (idiv(key, 2) + away).alias("asset_id"),
            (key + 2 * away).alias("track_id"),
            handler.alias("handler_type"),
            F.concat(F.lit("u"), (idiv(key, 2) + away).cast("string"), F.lit("_"), handler).alias("track_name"),
            F.when(size % 11 == 0, "").otherwise(F.col("p_type")).alias("codec"),
            F.lit("cmaf").alias("packaging"),
            F.lit("").alias("mime_type"),
            F.lit("").alias("event_type"),
            F.when(even, 90000).otherwise(48000).cast("bigint").alias("timescale"),
            F.when(even, size * 16).otherwise(0).alias("width"),
            F.when(even, size % 10 * 9).otherwise(0).alias("height"),
            F.when(size % 7 == 0, 0).otherwise(48000).alias("sample_rate"),
            (1 + size % 2).alias("channel_count"),
            F.when(size % 4 == 0, 0.0).otherwise(size * 0.5).alias("frame_rate"),
            F.when(size % 3 == 0, F.round(F.col("p_retailprice") * 100).cast("bigint")).otherwise(0).alias("max_bitrate"),
            F.when(size % 5 == 0, F.round(F.col("p_retailprice") * 50).cast("bigint")).otherwise(0).alias("avg_bitrate"),
            (size * 1000).cast("bigint").alias("duration_ms"),
            lang.alias("language"),
        )

    @cached_property
    def subs(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        feed = idiv(c, 10)
        return self.table("orders").select(
            o.alias("request_id"),
            feed.alias("feed_id"),
            F.concat(F.lit("u"), feed.cast("string"), F.lit("_"),
                     F.when(F.col("o_orderstatus") == "O", "vide").otherwise("soun")).alias("track_name"),
            (1 + o % 4).alias("filter_type"),
            (o % 10).alias("start_group"),
            (o % 3).alias("start_object"),
            (o % 10 + c % 5).alias("end_group"),
            (F.col("o_orderstatus") != "P").alias("forward"),
            micros_of("o_orderdate").alias("subscribe_us"),
        )

    @cached_property
    def links(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        start = 1000 * ((o * 7919) % 2592000)
        is_open = o % 97 == 0
        return self.table("orders").select(
            c.alias("link_id"),
            o.alias("range_id"),
            F.concat(F.lit("u"), idiv(c, 10).cast("string"), F.lit("_"),
                     F.when(c % 2 == 0, "vide").otherwise("soun")).alias("track_name"),
            start.alias("start_ms"),
            F.when(~is_open, start + 60000 * (c % 600)).alias("end_ms"),
            (o % 100).alias("start_group"),
            F.when(o % 5 != 0, o % 3).alias("start_object"),
            F.when(~is_open, o % 100 + c % 4).alias("end_group"),
            F.when(~is_open & (o % 4 != 0), 2 + o % 5).alias("end_object"),
        )

    def _catalog(self, bitrate: Column, segment: str, tag: str) -> DataFrame:
        k = F.col("c_custkey")
        audio = k % 4 == 1
        own = F.concat("c_name", F.when(F.col("c_mktsegment") == segment, f"-{tag}").otherwise(""))
        return self.table("customer").select(
            F.col("c_nationkey").alias("broadcast_id"),
            k.alias("position"),
            F.when(k % 13 != 0, F.concat(F.lit("ns"), F.col("c_nationkey").cast("string"))).alias("namespace"),
            own.alias("name"),
            F.when(k % 31 == 0, "eventtimeline").when(k % 101 == 0, "").otherwise("cmaf").alias("packaging"),
            F.when(k % 29 == 0, "ev").alias("event_type"),
            F.when(k % 2 == 1, "audio").otherwise("video").alias("role"),
            (k % 3 != 0).alias("is_live"),
            F.when(k % 17 != 0, bitrate).alias("bitrate"),
            F.when(audio, 48000).cast("bigint").alias("samplerate"),
            F.when(audio, "2").alias("channel_config"),
            F.when(k % 23 == 0, 60000).cast("bigint").alias("track_duration_ms"),
            F.when(k % 41 == 0, "50% off").when(k % 43 == 0, "%name%").alias("label"),
            F.concat("c_name", F.lit("-init")).alias("init_ref"),
        )

    @cached_property
    def cat_before(self) -> DataFrame:
        return self._catalog(1000000 + F.col("c_custkey"), "AUTOMOBILE", "old")

    @cached_property
    def cat_after(self) -> DataFrame:
        bump = F.when(F.col("c_acctbal") < 0, 1).otherwise(0)
        return self._catalog(1000000 + F.col("c_custkey") + bump, "MACHINERY", "new")

    @cached_property
    def cat_inits(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_nationkey").alias("broadcast_id"),
            F.concat("c_name", F.when(F.col("c_acctbal") > 0, "-init").otherwise("-spare")).alias("id"),
            F.lit("inline").alias("type"),
            F.md5("c_name").alias("data"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Track lists per broadcast: every quarter's buyers, each list published twice."""
        quarter = ((F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate") - 1).cast("bigint")
        # the file's size says little of the rows in it: customers are merged, else they could all pass the driver
        rows = (
            self.table("orders").select("o_custkey", quarter.alias("quarter")).distinct()
            .join(self.table("customer").select("c_custkey", "c_nationkey", "c_name").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        )
        return rows.select(
            F.col("c_nationkey").cast("bigint").alias("broadcast_id"),
            F.explode(F.array(2 * F.col("quarter"), 2 * F.col("quarter") + 1)).alias("version_seq"),
            F.lit("ns").alias("namespace"),
            F.col("c_name").alias("name"),
            (1000000 + F.when(F.col("quarter") >= 16, 1).otherwise(0)).cast("bigint").alias("bitrate"),
        )

    @cached_property
    def systems(self) -> DataFrame:
        s = self.table("supplier").where(F.col("s_nationkey") % 4 > 0)
        k = F.col("k").cast("string")
        return s.select("*", F.explode(F.sequence(F.lit(0), F.col("s_nationkey") % 4 - 1)).alias("k")).select(
            F.col("s_suppkey").alias("asset_id"),
            F.col("k").cast("bigint").alias("system_seq"),
            md5_uuid(F.concat(F.lit("system"), k)).alias("system_id"),
            F.md5(F.concat("s_name", k)).alias("pssh"),
        )

    @cached_property
    def ptracks(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            idiv(key, 20).alias("asset_id"),
            key.alias("track_seq"),
            F.concat(F.lit("t"), key.cast("string")).alias("track_name"),
            (size % 4 != 0).alias("is_protected"),
            F.when(size % 2 == 0, "cenc").otherwise("cbcs").alias("scheme"),
            md5_uuid(F.col("p_brand")).alias("kid"),
        )

    @cached_property
    def trace(self) -> DataFrame:
        seq = F.col("arrival_seq")
        target, delta = idiv("start_us", 1000), (seq * 37) % 400 - 100
        return self.frags.select(
            seq.alias("send_seq"),
            F.when(seq % 3 == 0, "pacing_before").when(seq % 3 == 1, "pacing_after").otherwise("enqueue").alias("event"),
            F.col("track_name").alias("track"),
            idiv(seq, 50).alias("group_id"),
            target.alias("target_ms"),
            (target + delta).alias("now_ms"),
            delta.alias("delta_ms"),
            "payload_bytes",
            (F.col("payload_bytes") + 8 + seq % 5).alias("wire_bytes"),
            F.when((seq % 20 == 0) | (seq % 20 == 5), 1).otherwise(0).alias("opened"),
            F.when(seq % 20 == 11, 1).otherwise(0).alias("fin"),
            "start_us",
        )

    @cached_property
    def packets(self) -> DataFrame:
        e = F.col("event_id")
        pid = F.element_at(F.array(*[F.lit(x) for x in (0, 256, 257, 272, 8191)]), (e % 5 + 1).cast("int"))
        slip = F.when(e % 50 == 7, 1).otherwise(0)
        return self.table("events").select(
            (F.col("user_id") % 10).alias("file_id"),
            e.alias("packet_index"),
            pid.alias("pid"),
            (e % 3 == 0).alias("pusi"),
            ((idiv(e, 5) - slip + 16) % 16).alias("continuity"),
        )

    @cached_property
    def pat(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            idiv(s, 5).alias("file_id"), (s % 5).alias("position"),
            (F.col("s_nationkey") % 4).alias("program"), (256 + 16 * F.col("s_nationkey")).alias("pmt_pid"),
        )

    @cached_property
    def pmt(self) -> DataFrame:
        c = F.col("c_custkey")
        types = F.array(*[F.lit(x) for x in (6, 27, 15, 36, 3)])
        return self.table("customer").select(
            idiv(c, 75).alias("file_id"), (c % 75).alias("position"), (F.col("c_nationkey") % 4).alias("program"),
            F.element_at(types, (c % 5 + 1).cast("int")).alias("stream_type"),
            (257 + c % 75).alias("elementary_pid"), (258 + F.col("c_nationkey")).alias("pcr_pid"),
        )

    @cached_property
    def announcements(self) -> DataFrame:
        return self.frags.groupBy("feed_id", F.col("event_type").alias("track")).agg(F.min("start_us").alias("announce_us"))
