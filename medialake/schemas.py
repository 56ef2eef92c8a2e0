"""Fixed schemas of media tables read from files or streams."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

SEND_TRACE = _struct(
    event=S, send_seq=L, now_ms=L, target_ms=L, delta_ms=L, track=S, group_id=L, subgroup_id=L, object_id=L,
    media_time_us=L, stream_id=L, opened=I, payload_bytes=L, wire_bytes=L, fin=I)

CHUNK = _struct(path=S, chunk_seq=L, bytes=T.BinaryType())

LIVE_OBJECT = _struct(
    feed_id=L, arrival_seq=L, track_name=S, kind=S, group_id=L, subgroup_id=L, object_id=L,
    media_time_us=L, media_duration_us=L, payload=T.BinaryType(), final_in_subgroup=B)

DRM_CONFIG = _struct(systems=T.ArrayType(_struct(
    systemID=S, laURL=S, laURLType=S, certURL=S, certURLType=S, robustness=S)))

FEED_CONFIG = _struct(srt_callers=T.ArrayType(_struct(
    id=S,
    srt=_struct(mode=S, host=S, port=L, latency_ms=L),
    mpegts=_struct(auto_detect_program=B, program_number=L, video_pid=L, audio_pid=L),
    cmaf=_struct(fragment_on_keyframe=B, empty_moov=B, default_base_moof=B, separate_moof_per_track=B, target_fragment_duration_ms=L))))
