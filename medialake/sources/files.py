"""Configuration files, send traces and landed byte chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.schemas import CHUNK, DRM_CONFIG, FEED_CONFIG, SEND_TRACE

DEFAULT_LATENCY_MS = 120
DEFAULT_FRAGMENT_MS = 1000


def read_send_trace(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The send trace CSV with its header; empty fields are NULL."""
    reader = (spark.readStream if streaming else spark.read).schema(SEND_TRACE)
    return reader.option("header", "true").option("nullValue", "").csv(path)


def read_chunk_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed byte chunks (path, chunk_seq, bytes) as a stream."""
    reader = spark.readStream.schema(CHUNK)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _json_files(spark: SparkSession, path: str, schema) -> DataFrame:
    text = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return text.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE"}))


def read_drm_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows per system, rejected files). A file without ``systems`` or with a system without id is rejected whole."""
    d = _json_files(spark, path, DRM_CONFIG)
    bad_system = F.exists("doc.systems", lambda s: s.isNull() | s["systemID"].isNull())
    reason = F.when(F.col("doc.systems").isNull(), "systems is missing").when(bad_system, "systemID is missing")
    d = d.withColumn("reason", reason)
    ok = d.where("reason IS NULL").select("path", F.posexplode("doc.systems").alias("position", "s"))
    rows = ok.select("path", F.col("position").cast("bigint").alias("position"), F.col("s.systemID").alias("system_id"), F.col("s.laURL").alias("la_url"),
                     F.col("s.laURLType").alias("la_url_type"), F.col("s.certURL").alias("cert_url"), F.col("s.certURLType").alias("cert_url_type"),
                     F.col("s.robustness").alias("robustness"))
    return rows, d.where("reason IS NOT NULL").select("path", "reason")


def read_feed_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feed rows with defaults, rejects with reason)."""
    d = _json_files(spark, path, FEED_CONFIG)
    missing = d.where("doc.srt_callers IS NULL").select("path", F.lit(None).cast("string").alias("id"), F.lit("srt_callers is missing").alias("reason"))
    c = d.select("path", F.posexplode("doc.srt_callers").alias("position", "c"))
    port = F.col("c.srt.port")
    reason = (
        F.when(F.col("c.id").isNull(), "id is missing").when(F.col("c.srt").isNull(), "srt is missing")
        .when(F.col("c.srt.mode").isNull(), "srt.mode is missing").when(F.col("c.srt.mode") != "caller", "srt.mode is not caller")
        .when(F.col("c.srt.host").isNull(), "srt.host is missing").when(port.isNull() | ~port.between(1, 65535), "srt.port is not 1 to 65535")
    )
    c = c.withColumn("reason", reason)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(True))

    ok = c.where("reason IS NULL").select(
        "path", F.col("position").cast("bigint").alias("position"), F.col("c.id").alias("id"), F.col("c.srt.mode").alias("mode"),
        F.col("c.srt.host").alias("host"), port.cast("int").alias("port"), F.coalesce("c.srt.latency_ms", F.lit(DEFAULT_LATENCY_MS)).alias("latency_ms"),
        flag("c.mpegts.auto_detect_program").alias("auto_detect_program"), F.col("c.mpegts.program_number").alias("program_number"),
        F.col("c.mpegts.video_pid").alias("video_pid"), F.col("c.mpegts.audio_pid").alias("audio_pid"),
        flag("c.cmaf.fragment_on_keyframe").alias("fragment_on_keyframe"), flag("c.cmaf.empty_moov").alias("empty_moov"),
        flag("c.cmaf.default_base_moof").alias("default_base_moof"), flag("c.cmaf.separate_moof_per_track").alias("separate_moof_per_track"),
        F.coalesce("c.cmaf.target_fragment_duration_ms", F.lit(DEFAULT_FRAGMENT_MS)).alias("target_fragment_duration_ms"))
    return ok, missing.unionByName(c.where("reason IS NOT NULL").select("path", F.col("c.id").alias("id"), "reason"))
