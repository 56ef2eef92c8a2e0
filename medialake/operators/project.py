"""Row-wise operators: times, flags, gates and catalog projections. No shuffle of the main input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import text, timing
from medialake.functions.timing import col

DEFAULT_VIDEO_BITRATE = 2000000
DEFAULT_AUDIO_BITRATE = 128000


def with_micros(df: DataFrame, value: str, timescale: str, name: str = "time_us") -> DataFrame:
    return df.withColumn(name, timing.ticks_to_micros(value, timescale))


def with_presentation_time(df: DataFrame, decode: str = "decode_time", offset: str = "composition_offset",
                           timescale: str = "timescale") -> DataFrame:
    return df.withColumn("presentation_us", timing.presentation_micros(decode, offset, timescale))


def with_sap_type(df: DataFrame, handler: str = "handler_type", flags: str = "flags") -> DataFrame:
    return df.withColumn("sap_type", timing.sap_type(handler, flags))


def with_send_flags(df: DataFrame) -> DataFrame:
    """Send-time flags of live fragments: declared SAP, sync point, presentation time."""
    return df.withColumns({
        "is_sync_point": timing.is_sync_point("object_id", "is_video_keyframe", "sap_type"),
        "send_presentation_us": timing.send_presentation("earliest_presentation_time_us", "start_time_us"),
        "declared_sap": timing.declared_sap("sap_type"),
        "starts_group": F.col("object_id") == 0,
    })


def media_only(objects: DataFrame, tracks: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Media objects, optionally only of video and sound tracks."""
    media = objects.where("kind = 'media'")
    if tracks is None:
        return media
    on = on or ["track_name"]
    real = tracks.where(F.col("handler_type").isin("vide", "soun")).select(*on).distinct()
    return media.join(real, on, "left_semi")


def namespace_prefix(df: DataFrame, full: str, prefix: str, mode: str = "reference") -> DataFrame:
    return df.withColumn("matches", text.namespace_has_prefix(full, prefix, mode))


def path_under(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    return df.where(text.path_is_under(path, prefix))


def gate_tracks(tracks: DataFrame) -> DataFrame:
    """``failed_rule`` names the first missing media metadata, NULL when the track may be sent."""
    audio = F.col("handler_type") == "soun"
    return tracks.withColumn(
        "failed_rule",
        F.when(F.coalesce(F.col("track_name"), F.lit("")) == "", "name")
        .when(~F.coalesce(F.col("handler_type").isin("vide", "soun"), F.lit(False)), "media_type")
        .when(F.coalesce(F.col("codec"), F.lit("")) == "", "codec")
        .when(audio & (F.coalesce("sample_rate", F.lit(0)) == 0), "sample_rate")
        .when(audio & (F.coalesce("channel_count", F.lit(0)) == 0), "channel_count"),
    )


def default_bitrate(handler: Column | str) -> Column:
    return F.when(col(handler) == "soun", DEFAULT_AUDIO_BITRATE).otherwise(DEFAULT_VIDEO_BITRATE).cast("bigint")


def resolve_bitrate(tracks: DataFrame, configured: DataFrame | None = None, measured: DataFrame | None = None,
                    on: list[str] | None = None) -> DataFrame:
    """First non-zero of the track's own maximum, the configured and the measured rate, else the default."""
    on = on or ["asset_id", "track_name"]
    d = tracks
    for extra, name in ((configured, "configured_bitrate"), (measured, "measured_bitrate")):
        d = d.withColumn(name, F.lit(None).cast("bigint")) if extra is None else d.join(extra.select(*on, name), on, "left")
    known = F.coalesce(*[F.nullif(F.col(c), F.lit(0).cast("bigint"))
                         for c in ("max_bitrate", "configured_bitrate", "measured_bitrate")])
    return d.withColumns({"bitrate": F.coalesce(known, default_bitrate("handler_type")), "estimated": known.isNull()})


def to_catalog_tracks(tracks: DataFrame, is_live: bool) -> DataFrame:
    """Track descriptions as catalog rows; absent fields are NULL.

    ``bitrate`` comes from :func:`resolve_bitrate` when that column is there.
    """
    video, audio = F.col("handler_type") == "vide", F.col("handler_type") == "soun"

    def text_field(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    def positive(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c))

    if "bitrate" not in tracks.columns:
        tracks = resolve_bitrate(tracks)
    role = (
        F.when(video, "video").when(audio, "audio")
        .when(F.col("packaging").isin("mediatimeline", "eventtimeline"), F.col("packaging"))
    )
    keep = [c for c in ("asset_id", "broadcast_id", "track_id") if c in tracks.columns]
    return tracks.select(
        *keep,
        F.col("track_name").alias("name"),
        "packaging",
        F.lit(is_live).alias("is_live"),
        role.alias("role"),
        text_field("codec").alias("codec"),
        text_field("mime_type").alias("mime_type"),
        text_field("event_type").alias("event_type"),
        text_field("language").alias("lang"),
        positive("timescale").alias("timescale"),
        (F.lit(None).cast("bigint") if is_live else positive("duration_ms")).alias("track_duration_ms"),
        F.when(video | audio, 1).alias("render_group"),
        F.when(video, positive("width")).alias("width"),
        F.when(video, positive("height")).alias("height"),
        F.when(video & (F.col("frame_rate") > 0), F.col("frame_rate")).alias("framerate"),
        F.when(audio, F.col("sample_rate")).alias("samplerate"),
        F.when(audio, F.col("channel_count").cast("string")).alias("channel_config"),
        F.when(video | audio, F.col("bitrate")).alias("bitrate"),
        positive("avg_bitrate").alias("avg_bitrate"),
    )


def to_send_tracks(tracks: DataFrame, measured: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Sender configuration with defaults; ``measured`` brings ``measured_bitrate``."""
    audio = (F.col("handler_type") == "soun") | (
        (F.col("handler_type") != "vide") & (F.col("sample_rate") != 0) & (F.col("width") == 0) & (F.col("height") == 0)
    )
    on = on or ["track_name"]
    d = tracks if measured is None else tracks.join(measured.select(*on, "measured_bitrate"), on, "left")
    hint = F.lit(None).cast("bigint") if measured is None else F.nullif(F.col("measured_bitrate"), F.lit(0).cast("bigint"))
    keep = [c for c in ("asset_id", "track_id") if c in tracks.columns]
    return d.select(
        *keep,
        F.when(F.col("track_name") != "", F.col("track_name"))
        .otherwise(F.concat(F.lit("track"), F.col("track_id").cast("string"))).alias("name"),
        F.when(audio, "audio").otherwise("video").alias("media_type"),
        "codec", "width", "height",
        timing.framerate_millis("frame_rate").alias("framerate_millis"),
        F.when(audio, F.coalesce(F.nullif(F.col("sample_rate"), F.lit(0)), F.lit(48000))).alias("samplerate"),
        F.when(audio, F.coalesce(F.nullif(F.col("channel_count"), F.lit(0)), F.lit(2)).cast("string")).alias("channel_config"),
        F.coalesce(hint, F.when(audio, DEFAULT_AUDIO_BITRATE).otherwise(DEFAULT_VIDEO_BITRATE).cast("bigint")).alias("bitrate"),
    )


def queue_delay(objects: DataFrame, sent: str = "send_time_us", created: str = "creation_time_us") -> DataFrame:
    """Microseconds a fragment waited between its creation and its send."""
    return objects.withColumn("queue_delay_us", F.col(sent) - F.col(created))


def plan_report(objects: DataFrame) -> DataFrame:
    keep = [c for c in ("broadcast_id", "asset_id", "plan_index") if c in objects.columns]
    return objects.select(
        *keep, "track_name", "group_id", "object_id",
        F.col("payload_bytes").alias("bytes"),
        F.col("media_time_us").alias("time_us"),
        F.when((F.col("kind") == "initialization") & (F.col("track_name") == "catalog"), "catalog")
        .when(F.col("kind") == "initialization", "init")
        .otherwise(F.col("kind")).alias("kind"),
    )
