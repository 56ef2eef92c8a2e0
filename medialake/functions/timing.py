"""Column expressions for tick, microsecond and millisecond arithmetic and send flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the media formats.
NON_SYNC_BIT = 0x00010000
CLOCK_90K = 90000
AAC_FRAME_SAMPLES = 1024


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column | str, b: Column | str | int) -> Column:
    """Integer division on BIGINT, truncating, inside codegen."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else col(b)
    return F.call_function("div", col(a).cast("bigint"), b.cast("bigint"))


def micros_of(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def ticks_to_micros(value: Column | str, timescale: Column | str) -> Column:
    scale = col(timescale).cast("bigint")
    safe = F.when(scale != 0, scale)
    return F.coalesce(idiv(col(value).cast("bigint") * F.lit(1000000).cast("bigint"), safe), F.lit(0).cast("bigint"))


def pts90k_to_micros(pts: Column | str) -> Column:
    return idiv(col(pts).cast("bigint") * F.lit(1000000).cast("bigint"), CLOCK_90K)


def round_millis(us: Column | str) -> Column:
    """Microseconds to milliseconds, half up."""
    return idiv(col(us).cast("bigint") + 500, 1000)


def presentation_micros(decode: Column | str, offset: Column | str, timescale: Column | str) -> Column:
    shifted = F.greatest(col(decode).cast("bigint") + col(offset).cast("bigint"), F.lit(0).cast("bigint"))
    return ticks_to_micros(shifted, timescale)


def sap_type(handler: Column | str, flags: Column | str) -> Column:
    """1 for non-video, 2 for a video sync sample, 0 otherwise."""
    sync = col(flags).cast("bigint").bitwiseAND(F.lit(NON_SYNC_BIT).cast("bigint")) == 0
    return F.when(col(handler) != "vide", F.lit(1)).when(sync, F.lit(2)).otherwise(F.lit(0)).cast("int")


def declared_sap(sap: Column | str) -> Column:
    """SAP classes outside 0..3 are not declared."""
    return F.when(col(sap).between(0, 3), col(sap))


def is_sync_point(object_id: Column | str, keyframe: Column | str, sap: Column | str) -> Column:
    return (
        (col(object_id) == 0)
        | F.coalesce(col(keyframe), F.lit(False))
        | F.coalesce(col(sap) != 0, F.lit(False))
    )


def send_presentation(ept: Column | str, start: Column | str) -> Column:
    return F.coalesce(F.when(col(ept) != 0, col(ept)), col(start))


def framerate_millis(fps: Column | str) -> Column:
    return F.floor(F.coalesce(col(fps), F.lit(0.0)) * 1000.0 + 0.5).cast("bigint")


def location_matches(
    filter_type: Column | str,
    start_group: Column | str,
    start_object: Column | str,
    end_group: Column | str,
    group_id: Column | str,
    object_id: Column | str,
) -> Column:
    """Subscription location filter: 3 opens at a location, 4 also ends at a group."""
    ft, g, o = col(filter_type), col(group_id), col(object_id)
    after = (g > col(start_group)) | ((g == col(start_group)) & (o >= col(start_object)))
    return F.when(ft == 3, after).when(ft == 4, after & (g <= col(end_group))).otherwise(F.lit(True))
