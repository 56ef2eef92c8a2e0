"""Publish plans that carry their objects: media by reference to file ranges, documents inline.

``fragments -> plan_catalog, plan_documents -> build_plan`` gives rows that the
send order, loop replay, statistics and the object lake take as they are; media
bytes are read last, with ``attach_payload(plan, "file_offset", "payload_bytes")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators import catalog as catalogs
from medialake.operators import rollup
from medialake.operators.catalog import Catalog
from medialake.operators.ordered import run_sum, running
from medialake.operators.project import to_catalog_tracks
from medialake.operators.sets import SAP_EVENT_TYPE, TIMELINE_TRACK, plan_dependencies, plan_tracks, sap_track_name


def with_file_places(frags: DataFrame, file: str = "path", seq: str = "arrival_seq", size: str = "payload_bytes", start: int = 0, **kw) -> DataFrame:
    """``file_offset`` of fragments that lie one after another in their file, in order, from ``start`` on."""
    d = running(frags, [file], [seq], [run_sum("file_offset", F.col(size), exclusive=True)], **kw)
    return d.withColumn("file_offset", F.col("file_offset") + start)


def plan_catalog(frags: DataFrame, tracks: DataFrame, is_live: bool = False, sap: bool = True, timeline: bool = True, asset: str = "asset_id", **kw) -> DataFrame:
    """Catalog rows of all tracks of a plan but the catalog itself, in plan order by ``position``.

    Media tracks carry the largest SAP types of their fragments, synthetic tracks
    the names of the tracks they depend on.
    """
    heads = rollup.sap_maxima(frags, [asset, "track_name"]).select(
        asset, F.col("track_name").alias("name"), F.col("max_group_sap").cast("bigint").alias("max_grp_sap_starting_type"), F.col("max_object_sap").cast("bigint").alias("max_obj_sap_starting_type"))
    media = to_catalog_tracks(tracks, is_live).withColumn("position", F.col("track_id").cast("bigint")).join(heads, [asset, "name"], "left")
    # the names a track depends on are one field of its catalog entry
    edges = plan_dependencies(tracks, asset, **kw).groupBy(asset, "track_name").agg(F.sort_array(F.collect_list(F.struct("position", "depends_on"))).alias("__d"))
    made = plan_tracks(tracks, sap, timeline, asset, **kw).where(F.col("packaging").isin("mediatimeline", "eventtimeline"))
    made = made.join(edges, [asset, "track_name"], "left").select(
        asset, F.col("track_name").alias("name"), "packaging", F.col("packaging").alias("role"), F.lit(is_live).alias("is_live"), F.lit("application/json").alias("mime_type"),
        F.when(F.col("packaging") == "eventtimeline", SAP_EVENT_TYPE).alias("event_type"), F.transform("__d", lambda e: e["depends_on"]).alias("depends"), F.col("track_id").alias("position"))
    return media.drop("track_id").unionByName(made, allowMissingColumns=True)


def plan_documents(frags: DataFrame, tracks: DataFrame, catalog: DataFrame | None = None, sap: bool = True, timeline: bool = True, asset: str = "asset_id",
                   seq: str = "arrival_seq", time: str = "media_time_us", ept: str | None = None, **kw) -> DataFrame:
    """``asset, track_name, part_index, document``: catalog, media timeline and SAP timelines of every asset.

    ``catalog`` is a :func:`plan_catalog` result. A document in several parts is
    several objects of its track; a timeline without entries is ``[]``.
    """
    cat = catalogs.catalog_json(Catalog(catalog if catalog is not None else plan_catalog(frags, tracks, sap=sap, timeline=timeline, asset=asset, **kw)), broadcast=asset)
    out = cat.select(asset, F.lit("catalog").alias("track_name"), "part_index", "document")
    if timeline:
        found = rollup.media_timeline_text(frags, asset, time, **kw)
        lines = tracks.select(asset).distinct().join(found, [asset], "left")
        out = out.unionByName(lines.select(asset, F.lit(TIMELINE_TRACK).alias("track_name"), F.coalesce("part_index", F.lit(0)).cast("bigint").alias("part_index"), F.coalesce("timeline", F.lit("[]")).alias("document")))
    if sap:
        found = rollup.sap_timeline(frags, [asset, "track_name"], seq, ept or time, **kw)
        lines = tracks.select(asset, "track_name").join(found, [asset, "track_name"], "left")
        out = out.unionByName(lines.select(asset, sap_track_name(F.col("track_name")).alias("track_name"), F.coalesce("part_index", F.lit(0)).cast("bigint").alias("part_index"), F.coalesce("timeline", F.lit("[]")).alias("document")))
    return out
