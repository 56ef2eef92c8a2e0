"""Grouping, numbering and clocks over arrival order, all on chunked running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.binary import be_uint, has_bit, slice_bytes
from medialake.functions.timing import AAC_FRAME_SAMPLES, CLOCK_90K, idiv, presentation_micros, ticks_to_micros
from medialake.operators.ordered import (
    HotKeys, by_heat, find_hot, prev_row, row_index, run_count, run_last, run_max, run_sum, running, with_key_totals,
)

GOP_CHUNK = 120          # samples in one coalesced object
PACKETS_PER_OBJECT = 7
TS_OBJECT_US = 10000     # media time of one transport-stream object
PSI_EVERY_OBJECTS = 50   # tables repeat each 500 ms
LONGEST_FRAME_US = 500000
DEFAULT_VIDEO_FRAME_US = 33333
NULL_PID = 0x1FFF


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("bigint")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def assign_groups(frags: DataFrame, feed: str = "feed_id", seq: str = "arrival_seq", on_keyframe: bool = True, **kw) -> DataFrame:
    """Groups opened by video key-frames, per feed; rows before the first key-frame drop out."""
    if not on_keyframe:
        return frags.withColumn("group_id", _zero())
    key = (F.col("handler_type") == "vide") & F.col("is_sync")
    d = running(frags, [feed], [seq], [run_sum("__keys", _flag(key))], **kw)
    return d.where("__keys > 0").withColumn("group_id", F.col("__keys") - 1).drop("__keys")


def number_objects(frags: DataFrame, feed: str = "feed_id", seq: str = "arrival_seq", **kw) -> DataFrame:
    return row_index(frags, [feed, "group_id", "track_name"], [seq], "object_id", **kw)


def assign_shared_groups(frags: DataFrame, session: str = "session_id", seq: str = "arrival_seq",
                         hot: HotKeys | None = None, **kw) -> DataFrame:
    """Groups shared by all renditions of a session.

    The open group's start is the largest key-frame start so far: a later start
    opens a group, an equal one joins it, an earlier one is dropped. Non-key video
    waits for its own track's key-frame in the group. A session without any video
    track numbers each track's rows as groups of one object.
    """
    video = F.col("handler_type") == "vide"
    key = video & F.col("is_sync")
    names = [*frags.columns, "group_id", "object_id"]

    def number(part: DataFrame, heat: HotKeys) -> DataFrame:
        d = with_key_totals(part, [session], {"__video": F.max(_flag(video))}, heat)
        shared = d.where("__video = 1")
        shared = running(shared, [session], [seq], [run_max("__before", F.when(key, F.col("start_us")), exclusive=True)], hot=heat, **kw)
        opens = key & (F.col("__before").isNull() | (F.col("start_us") > F.col("__before")))
        late = key & F.coalesce(F.col("start_us") < F.col("__before"), F.lit(False))
        shared = running(shared, [session], [seq], [run_sum("__opened", _flag(opens))], hot=heat, **kw).where(~late)
        shared = shared.where("__opened > 0").withColumn("group_id", F.col("__opened") - 1)
        track = [session, "group_id", "track_name"]
        shared = running(shared, track, [seq], [run_max("__key", _flag(key))], hot=heat, **kw)
        shared = row_index(shared.where(~video | (F.col("__key") == 1)), track, [seq], "object_id", hot=heat, **kw)
        alone = row_index(d.where("__video = 0"), [session, "path", "track_name"], [seq], "group_id", hot=heat, **kw)
        return shared.select(*names).unionByName(alone.withColumn("object_id", _zero()).select(*names))

    return by_heat(frags, hot or find_hot(frags, [session]), number)


def number_batch(rows: DataFrame, mode: str = "fragment", asset: str = "asset_id", seq: str = "arrival_seq", **kw) -> DataFrame:
    """Group and object numbers of batch input.

    ``fragment``: one row per fragment, group is its ordinal in the track.
    ``split``: rows are samples with ``fragment_seq``; object is the index in the fragment.
    ``progressive``: group is the track's position in the asset, object the sample index.
    """
    keys = [asset, "track_name"]
    if "hot" not in kw:
        kw["hot"] = find_hot(rows, [asset])
    if mode == "fragment":
        return row_index(rows, keys, [seq], "group_id", **kw).withColumn("object_id", _zero())
    if mode == "split":
        d = row_index(rows, [*keys, "fragment_seq"], [seq], "object_id", **kw)
        d = running(d, keys, [seq], [run_sum("__n", _flag(F.col("object_id") == 0))], **kw)
        return d.withColumn("group_id", F.col("__n") - 1).drop("__n")
    if mode == "progressive":
        tracks = rows.groupBy(*keys).agg(F.min("track_id").cast("bigint").alias("__first"))
        index = row_index(tracks, [asset], ["__first", "track_name"], "group_id", **kw).drop("__first")
        return row_index(rows, keys, [seq], "object_id", **kw).join(index, keys)
    raise ValueError(f"unknown mode {mode!r}")


def with_decode_time(samples: DataFrame, keys: list[str], seq: str = "sample_index", **kw) -> DataFrame:
    """Exclusive prefix sum of durations per track."""
    return running(samples, keys, [seq], [run_sum("decode_time", F.col("duration"), exclusive=True)], **kw)


def gop_of_video(samples: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Decode clock and GOP ordinal of video samples in one pass."""
    opens = F.col("sync") | (F.col("sample_index") == 0)
    d = running(samples, keys, ["sample_index"],
                [run_sum("decode_time", F.col("duration"), exclusive=True), run_sum("__gops", _flag(opens))], **kw)
    return d.withColumn("gop", F.col("__gops") - 1).drop("__gops")


def align_to_gops(samples: DataFrame, gop_starts: DataFrame, keys: list[str], time_span_us: int = 3600_000_000,
                  hot: HotKeys | None = None) -> DataFrame:
    """As-of join: each sample takes the latest GOP start at or before its time, GOP 0 before the first.

    ``samples`` needs ``t_us`` and ``sample_index``; ``gop_starts`` has ``gop`` and
    ``start_us``. One union and one running value: no pair of rows is ever formed.
    """
    s = samples.withColumns({"__is_start": F.lit(0), "gop": F.lit(None).cast("bigint")})
    g = gop_starts.select(*keys, F.col("start_us").alias("t_us"), "gop", F.col("gop").alias("sample_index"), F.lit(1).alias("__is_start"))
    both = s.unionByName(g, allowMissingColumns=True).withColumn("__rank", 1 - F.col("__is_start"))
    d = running(both, keys, ["t_us", "__rank", "sample_index"], [run_last("gop", F.col("gop"))], span=time_span_us, hot=hot)
    return (
        d.where("__is_start = 0").withColumn("gop", F.coalesce("gop", _zero()))
        .select(*samples.columns, "gop")
    )


def coalesce_gops(samples: DataFrame, asset: str = "asset_id", cap: int = GOP_CHUNK, hot: HotKeys | None = None, **kw) -> DataFrame:
    """Samples to bounded objects: GOPs cut into chunks of ``cap`` samples, one row per object.

    ``samples``: asset, handler_type, sample_index, duration, timescale, sync,
    composition_offset (and size). Sound tracks are cut at the GOP starts of the
    asset's video track.
    """
    keys = [asset, "handler_type"]
    cols = [*keys, "sample_index", "timescale", "duration", "composition_offset", "size", "decode_time", "gop"]

    def build(part: DataFrame, heat: HotKeys) -> DataFrame:
        clocked = gop_of_video(part, keys, hot=heat, **kw)
        video = clocked.where("handler_type = 'vide'")
        starts = video.where("sync OR sample_index = 0").select(asset, "gop", ticks_to_micros("decode_time", "timescale").alias("start_us"))
        other = clocked.where("handler_type <> 'vide'").drop("gop").withColumn("t_us", ticks_to_micros("decode_time", "timescale"))
        aligned = align_to_gops(other, starts, [asset], hot=heat)
        rows = video.select(*cols).unionByName(aligned.select(*cols))
        placed = row_index(rows, [*keys, "gop"], ["sample_index"], "__pos", hot=heat, **kw)
        chunks = placed.groupBy(*keys, "gop", idiv("__pos", cap).alias("gop_part")).agg(
            F.min("sample_index").alias("first_sample"),
            F.count(F.lit(1)).alias("sample_count"),
            F.sum("duration").alias("__duration"),
            F.sum("size").alias("payload_bytes"),
            F.min("decode_time").alias("__decode"),
            F.max("timescale").alias("__timescale"),
            F.min_by("composition_offset", "sample_index").alias("__offset"),
        )
        return row_index(chunks, keys, ["first_sample"], "object_id", hot=heat, **kw)

    objects = by_heat(samples, hot or find_hot(samples, [asset]), build)
    sap = F.when(F.col("handler_type") != "vide", 1).when(F.col("gop_part") == 0, 2).otherwise(0)
    return objects.select(
        *keys, "gop", "object_id", "first_sample", "sample_count", "payload_bytes",
        ticks_to_micros("__decode", "__timescale").alias("start_time_us"),
        ticks_to_micros("__duration", "__timescale").alias("duration_us"),
        presentation_micros("__decode", "__offset", "__timescale").alias("earliest_presentation_time_us"),
        sap.cast("int").alias("sap_type"),
    )


def estimate_durations(es: DataFrame, keys: list[str] | None = None, seq: str = "arrival_seq", hot: HotKeys | None = None, **kw) -> DataFrame:
    """Sample durations from presentation times; gaps fall back to the last good one, then a default."""
    keys = keys or ["feed_id", "track_name"]
    step = F.col("pts_us") - F.col("__prev")
    valid = F.when((F.col("__prev") != 0) & (step > 0) & (step <= LONGEST_FRAME_US), step)
    default = F.when(F.col("is_video"), DEFAULT_VIDEO_FRAME_US).otherwise(
        idiv(F.lit(AAC_FRAME_SAMPLES * 1000000), F.when(F.col("timescale") > 0, F.col("timescale")).otherwise(48000)))

    def estimate(part: DataFrame, heat: HotKeys) -> DataFrame:
        d = running(part, keys, [seq], [prev_row("__prev", F.col("pts_us"))], hot=heat, **kw)
        return running(d, keys, [seq], [run_last("__good", valid)], hot=heat, **kw)

    d = by_heat(es, hot or find_hot(es, keys), estimate)
    return d.withColumn("duration_us", F.coalesce("__good", default.cast("bigint"))).drop("__prev", "__good")


def sample_ticks() -> Column:
    """Clock advance of one sample: fixed for sound, scaled duration (at least 1) for video."""
    video = idiv(F.col("duration_us") * F.col("timescale"), 1000000)
    return F.when(~F.col("is_video"), AAC_FRAME_SAMPLES).otherwise(F.greatest(video, F.lit(1))).cast("bigint")


def monotone_clock(es: DataFrame, keys: list[str] | None = None, seq: str = "arrival_seq", **kw) -> DataFrame:
    """Decode time as the sum of earlier sample durations; needs ``duration_us``."""
    keys = keys or ["feed_id", "track_name"]
    d = es.withColumn("sample_ticks", sample_ticks())
    return running(d, keys, [seq], [run_sum("decode_time", F.col("sample_ticks"), exclusive=True)], **kw)


def end_flags(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index", hot: HotKeys | None = None, **kw) -> DataFrame:
    """Whether an object is the last of its group or subgroup, and whether the group's largest is not elsewhere."""
    group = [broadcast, "track_name", "group_id"]
    sub = [*group, "subgroup_id"]

    def extremes(part: DataFrame, heat: HotKeys) -> DataFrame:
        d = running(part, group, [seq], [run_max("__g", F.col("object_id"), exclusive=True)], reverse=True, hot=heat, **kw)
        d = running(d, sub, [seq], [run_max("__s", F.col("object_id"), exclusive=True)], reverse=True, hot=heat, **kw)
        d = with_key_totals(d, group, {"__top": F.max(F.struct(F.col("object_id").alias("m"), F.col("subgroup_id").alias("s")))}, heat)
        other = F.when(F.col("subgroup_id") != F.col("__top")["s"], F.col("object_id"))
        return with_key_totals(d, group, {"__second": F.max(other)}, heat)

    d = by_heat(objects, hot or find_hot(objects, [broadcast]), extremes)
    elsewhere = F.when(F.col("subgroup_id") == F.col("__top")["s"], F.col("__second")).otherwise(F.col("__top")["m"])

    def none_larger(c: Column) -> Column:
        return F.coalesce(c <= F.col("object_id"), F.lit(True))

    return d.select(
        *objects.columns,
        none_larger(F.col("__g")).alias("final_in_group"),
        none_larger(F.col("__s")).alias("final_in_subgroup"),
        none_larger(elsewhere).alias("contains_group_largest"),
    )


def object_id_delta(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index", **kw) -> DataFrame:
    keys = [broadcast, "track_name", "group_id", "subgroup_id"]
    d = running(objects, keys, [seq], [prev_row("__prev", F.col("object_id"))], **kw)
    return d.withColumn("id_delta", F.coalesce(F.col("object_id") - F.col("__prev") - 1, F.col("object_id"))).drop("__prev")


def group_transitions(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "plan_index", **kw) -> DataFrame:
    """Rows where a track's group changes, with the group that is closed by it (NULL at the first)."""
    d = running(objects, [broadcast, "track_name"], [seq], [prev_row("closed_group", F.col("group_id"))], **kw)
    return d.where(F.col("closed_group").isNull() | (F.col("closed_group") != F.col("group_id")))


def packetise(packets: DataFrame, psi: DataFrame | None = None, file: str = "file_id", seq: str = "packet_index",
              n: int = PACKETS_PER_OBJECT, **kw) -> DataFrame:
    """Packets to fixed-count objects; table packets (``psi``) are repeated each 50 objects.

    Table rows carry ``psi_order``; they precede the packets of the object they open.
    """
    d = row_index(packets, [file], [seq], "__pos", **kw)
    d = d.withColumns({
        "object_id": idiv("__pos", n),
        "is_psi": F.lit(False),
        "slot": F.col("__pos") % n,
    }).drop("__pos")
    if psi is not None:
        last = d.groupBy(file).agg(F.max("object_id").alias("__last"))
        ticks = last.select(file, F.explode(F.sequence(_zero(), F.col("__last"), F.lit(PSI_EVERY_OBJECTS).cast("bigint"))).alias("object_id"))
        injected = psi.join(ticks, [file]).withColumns({"is_psi": F.lit(True), "slot": F.col("psi_order").cast("bigint") - 1000000}).drop("psi_order")
        d = d.unionByName(injected, allowMissingColumns=True)
    return d.withColumn("media_time_us", F.col("object_id") * TS_OBJECT_US)


def renumber_continuity(packets: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, **kw) -> DataFrame:
    """Continuity counter of table packets as their occurrence number modulo 16."""
    d = row_index(packets, keys or ["file_id", "pid"], order or ["packet_index"], "__pos", **kw)
    return d.withColumn("continuity", F.col("__pos") % 16).drop("__pos")


def expand_audio_frames(pes: DataFrame, frame_count: str = "frame_count", pts: str = "pts90k", rate: str = "sample_rate") -> DataFrame:
    """One row per audio frame of a packet, with its own 90 kHz time."""
    r = F.when(F.col(rate) > 0, F.col(rate)).otherwise(48000).cast("bigint")
    d = pes.where(F.col(frame_count) > 0).withColumn(
        "frame_index", F.explode(F.sequence(_zero(), F.col(frame_count).cast("bigint") - 1)))
    shift = idiv(F.col("frame_index") * F.lit(AAC_FRAME_SAMPLES * CLOCK_90K) + idiv(r, 2), r)
    return d.withColumn("frame_pts90k", F.col(pts) + shift)


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence", **kw) -> DataFrame:
    return running(df, keys, order, [run_count(name)], **kw)


def pes_samples(packets: DataFrame, keys: list[str] | None = None, seq: str = "packet_index", flush_last: bool = False, **kw) -> DataFrame:
    """Packets to samples per (feed, pid): a unit start closes the sample before it.

    The last open sample comes out only with ``flush_last``. Sample numbers and
    closings are running values; only one sample's own packets are put together.
    """
    keys = keys or ["feed_id", "pid"]
    if "hot" not in kw:
        kw["hot"] = find_hot(packets, keys)
    p = packets.where(F.col("payload").isNotNull())
    d = running(p, keys, [seq], [run_sum("__unit", _flag(F.col("pusi")))], **kw).where("__unit > 0")
    last = with_key_totals(d.select(*keys, seq, "__unit", "pusi", "payload"), keys, {"__last": F.max("__unit")}, kw["hot"])
    done = last if flush_last else last.where("__unit < __last")
    head, body = be_uint("payload", 0, 3) == 1, F.col("payload")
    stamped = (F.length(body) >= 14) & has_bit(be_uint("payload", 7, 1), 0x80)
    bits = [(9, 1, 0x07, 30), (10, 0, 0xFF, 22), (11, 1, 0x7F, 15), (12, 0, 0xFF, 7), (13, 1, 0x7F, 0)]
    pts = sum((F.shiftleft(F.shiftright(be_uint("payload", at, 1), right).bitwiseAND(F.lit(mask).cast("bigint")), left) for at, right, mask, left in bits),
              F.lit(0).cast("bigint"))
    whole = (F.length(body) >= 9) & head
    start = 9 + be_uint("payload", 8, 1)
    rest = F.when(whole & (start < F.length(body)), slice_bytes("payload", start, F.length(body) - start)).otherwise(F.lit(b""))
    done = done.withColumns({
        "__data": F.when(F.col("pusi"), rest).otherwise(body),
        "__pts": F.when(F.col("pusi"), F.when(whole & stamped, pts).otherwise(0)),
    })
    s = done.groupBy(*keys, "__unit").agg(
        F.min(seq).alias(seq), F.max("__pts").alias("pts90k"), F.expr(f"listagg(__data) WITHIN GROUP (ORDER BY `{seq}`)").alias("payload"))
    return s.select(*keys, seq, "pts90k", "payload").where(F.length("payload") > 0)
