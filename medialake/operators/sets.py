"""Unions, set differences, range coalescing and equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import OPEN_END
from medialake.functions.timing import idiv
from medialake.operators.ordered import HotKeys, by_heat, find_hot, row_index, run_max, run_sum, running, seq_span

RANGE_SPAN_MS = 3600_000
SAP_EVENT_TYPE = "org.ietf.moq.cmsf.sap"
TIMELINE_TRACK = "timeline"
SECTIONS = {"catalog": 0, "media": 1, "timeline": 2, "sap": 3}


def sap_track_name(track):
    return F.concat(track, F.lit("_sap"))


def plan_tracks(tracks: DataFrame, sap: bool = True, timeline: bool = True, asset: str = "asset_id", **kw) -> DataFrame:
    """Media tracks with the synthetic catalog, timeline and SAP tracks of their asset.

    Synthetic ids continue after the largest media id: timeline first, then one
    SAP track per media track in track order.
    """
    media = tracks.select(asset, F.col("track_id").cast("bigint").alias("track_id"), "handler_type", "codec", "track_name",
                          F.lit("cmaf").alias("packaging"), F.lit(None).cast("string").alias("depends_on"))
    per_asset = media.groupBy(asset).agg(F.max("track_id").alias("__max"))

    def synthetic(df, track_id, codec, name, packaging, depends):
        return df.select(asset, track_id.cast("bigint").alias("track_id"), F.lit("meta").alias("handler_type"), codec.alias("codec"),
                         name.alias("track_name"), F.lit(packaging).alias("packaging"), depends.cast("string").alias("depends_on"))

    none = F.lit(None)
    out = synthetic(per_asset, F.lit(0), F.lit("catalog"), F.lit("catalog"), "catalog", none).unionByName(media)
    if timeline:
        out = out.unionByName(synthetic(per_asset, F.col("__max") + 1, F.lit(""), F.lit(TIMELINE_TRACK), "mediatimeline", none))
    if sap:
        ranked = row_index(media, [asset], ["track_id"], "__n", **kw).join(per_asset, [asset])
        base = 2 if timeline else 1
        out = out.unionByName(synthetic(ranked, F.col("__max") + base + F.col("__n"), F.lit(""), sap_track_name(F.col("track_name")),
                                        "eventtimeline", F.col("track_name")))
    return out


def plan_dependencies(tracks: DataFrame, asset: str = "asset_id", **kw) -> DataFrame:
    """Tracks the timeline and SAP tracks depend on, one row per edge, in track order."""
    ordered = row_index(tracks.select(asset, F.col("track_id").cast("bigint").alias("track_id"), "track_name"), [asset], ["track_id"], "position", **kw)
    all_tracks = ordered.select(asset, F.lit(TIMELINE_TRACK).alias("track_name"), "position", F.col("track_name").alias("depends_on"))
    own = ordered.select(asset, sap_track_name(F.col("track_name")).alias("track_name"), F.lit(0).cast("bigint").alias("position"),
                         F.col("track_name").alias("depends_on"))
    return all_tracks.unionByName(own)


#: What an object of a plan is; NULL where it does not apply. Media lie at (path, file_offset, payload_bytes), documents are inline.
CONTENT = {"subgroup_id": "bigint", "media_time_us": "bigint", "media_duration_us": "bigint", "sap_type": "int", "payload_bytes": "bigint",
           "path": "string", "file_offset": "bigint", "document": "string"}


def build_plan(frags: DataFrame, tracks: DataFrame, sap: bool = True, timeline: bool = True, asset: str = "asset_id",
               seq: str = "arrival_seq", span: int | None = None, documents: DataFrame | None = None, **kw) -> DataFrame:
    """All objects of an asset in publish order, with their content: catalog, media, timeline, SAP timelines.

    ``documents`` (asset, track_name, part_index, document) are the contents of the
    synthetic tracks; part n of a document is object n of group 0. Synthetic objects
    have time and duration 0, and without documents no bytes.
    """
    def content(df, **given):
        return [given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in CONTENT.items()]

    zero = F.lit(0).cast("bigint")
    own = frags if "subgroup_id" in frags.columns else frags.withColumn("subgroup_id", zero)
    media = own.select(asset, "track_name", "group_id", "object_id", F.col(seq).cast("bigint").alias("__seq"), zero.alias("__part"),
                       F.lit(SECTIONS["media"]).alias("__section"), F.lit("media").alias("kind"), *content(own, document=F.lit(None)))

    def synthetic(df, name, section, kind, at=zero):
        rows = df.select(asset, name.alias("track_name"), at.alias("__seq"))
        part, text = zero, F.lit(None).cast("string")
        if documents is not None:
            rows = rows.join(documents, [asset, "track_name"], "left")
            part, text = F.coalesce(F.col("part_index"), zero), F.col("document")
        return rows.select(asset, "track_name", zero.alias("group_id"), part.alias("object_id"), "__seq", part.alias("__part"), F.lit(SECTIONS[section]).alias("__section"), F.lit(kind).alias("kind"),
                           *content(rows, subgroup_id=zero, media_time_us=zero, media_duration_us=zero, payload_bytes=F.coalesce(F.octet_length(text), zero), document=text))

    assets = tracks.select(asset).distinct()
    out = synthetic(assets, F.lit("catalog"), "catalog", "initialization").unionByName(media)
    if timeline:
        out = out.unionByName(synthetic(assets, F.lit(TIMELINE_TRACK), "timeline", "metadata"))
    if sap:
        out = out.unionByName(synthetic(tracks, sap_track_name(F.col("track_name")), "sap", "metadata", F.col("track_id").cast("bigint")))
    width = span or seq_span(frags.sparkSession)
    plan = row_index(out, [asset], ["__section", "__seq", "__part"], "plan_index",
                     chunk=F.struct(F.col("__section").alias("s"), idiv("__seq", width).alias("b")), **kw)
    return plan.drop("__section", "__seq", "__part")


def catalog_added(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.select(*keys).join(before.select(*keys), keys, "left_anti").distinct()


def catalog_removed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return catalog_added(after, before, keys)


def announced_tracks(catalog: DataFrame, registered: DataFrame, feed: str = "feed_id") -> DataFrame:
    """The catalog track and the registered tracks of every feed that has any."""
    cols = [feed, "track_name"]
    head = registered.select(feed).distinct().join(catalog.select(*cols), [feed])
    return head.unionByName(registered.select(*cols).distinct())


def program_pids(pat: DataFrame, pmt: DataFrame, file: str = "file_id") -> DataFrame:
    """Pids of the picked program: 0, its table, its clock and its streams. ``pat``: file, program, pmt_pid."""
    on = [file, "program", *(["pmt_pid"] if "pmt_pid" in pmt.columns else [])]
    picked = pmt.join(pat.select(file, "program", "pmt_pid"), on)
    listed = F.array(F.lit(0).cast("bigint"), *[F.col(c).cast("bigint") for c in ("pmt_pid", "pcr_pid", "elementary_pid")])
    streams = picked.select(file, F.explode(listed).alias("pid"))
    tables = pat.select(file, F.explode(F.array(F.lit(0).cast("bigint"), F.col("pmt_pid").cast("bigint"))).alias("pid"))
    return streams.unionByName(tables).distinct()


def merge_ranges(ranges: DataFrame, keys: list[str], kind: str = "time", span: int | None = None,
                 hot: HotKeys | None = None) -> DataFrame:
    """Union of overlapping ranges per key; touching but not overlapping ranges stay apart.

    Equal starts are reduced to their largest end first, so a chunk holds at
    most ``span`` rows of a key however many ranges there are.
    """
    if kind == "time":
        start, end = F.struct(F.col("start_ms").alias("a")), F.struct(F.coalesce("end_ms", F.lit(OPEN_END)).alias("a"))
        lead, width = "start_ms", span or RANGE_SPAN_MS
    elif kind == "location":
        start = F.struct(F.col("start_group").alias("a"), F.coalesce("start_object", F.lit(0)).cast("bigint").alias("b"))
        end = F.struct(F.coalesce("end_group", F.lit(OPEN_END)).alias("a"),
                       F.when(F.col("end_group").isNull(), OPEN_END).otherwise(F.coalesce("end_object", F.lit(OPEN_END))).cast("bigint").alias("b"))
        lead, width = "start_group", span or 1024
    else:
        raise ValueError(f"unknown kind {kind!r}")
    d = ranges.select(*keys, start.alias("__s"), end.alias("__e"), F.col(lead).alias("__lead"))
    d = d.groupBy(*keys, "__s", "__lead").agg(F.max("__e").alias("__e"))
    chunk = idiv("__lead", width)
    head = F.col("__reach").isNull() | (F.col("__s") > F.col("__reach"))

    def islands(part: DataFrame, heat: HotKeys) -> DataFrame:
        p = running(part, keys, ["__s"], [run_max("__reach", F.col("__e"), exclusive=True)], chunk=chunk, hot=heat)
        return running(p, keys, ["__s"], [run_sum("__island", F.when(head, 1).otherwise(0).cast("bigint"))], chunk=chunk, hot=heat)

    d = by_heat(d, hot or find_hot(ranges, keys), islands)
    m = d.groupBy(*keys, "__island").agg(F.min("__s").alias("s"), F.max("__e").alias("e")).drop("__island")

    def closed(c):
        return F.when(c != OPEN_END, c)

    if kind == "time":
        return m.select(*keys, F.col("s.a").alias("start_ms"), closed(F.col("e.a")).alias("end_ms"))
    return m.select(*keys, F.col("s.a").alias("start_group"), F.col("s.b").alias("start_object"),
                    closed(F.col("e.a")).alias("end_group"), closed(F.col("e.b")).alias("end_object"))
