"""Every stream equals its batch twin, fed in several files and micro-batches."""

from __future__ import annotations

import time

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from medialake.operators import live, order, rollup, sequence, subscribe
from medialake.plans.views import Views
from medialake.sources.sinks import write_object_stream
from medialake.streaming import streams


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def feed(spark, df, folder, seq, files=3):
    """Write ``df`` as ordered files and read it back as a stream of one file per micro-batch."""
    parts = df.withColumn("__p", F.ntile(files).over(__import__("pyspark").sql.Window.partitionBy(F.lit(0)).orderBy(seq)))
    for i in range(1, files + 1):
        parts.where(f"__p = {i}").drop("__p").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def drain(spark, stream, folder, mode="append"):
    out = f"{folder}/out"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    q.awaitTermination(240)
    return spark.read.parquet(out)


def test_groups(spark, views, folder):
    s = drain(spark, streams.stream_groups(feed(spark, views.frags, folder + "/in", "arrival_seq")), folder)
    b = sequence.number_objects(sequence.assign_groups(views.frags))
    cols = ("feed_id", "arrival_seq", "group_id", "object_id")
    assert rows(s.where("NOT late"), *cols) == rows(b, *cols)


def test_shared_groups(spark, views, folder):
    s = drain(spark, streams.stream_shared_groups(feed(spark, views.shared, folder + "/in", "arrival_seq")), folder)
    cols = ("session_id", "arrival_seq", "group_id", "object_id")
    assert rows(s.where("NOT late"), *cols) == rows(sequence.assign_shared_groups(views.shared), *cols)


def test_clock(spark, views, folder):
    s = drain(spark, streams.stream_clock(feed(spark, views.es, folder + "/in", "arrival_seq")), folder)
    cols = ("feed_id", "track_name", "arrival_seq", "duration_us", "sample_ticks", "decode_time")
    assert rows(s, *cols) == rows(sequence.monotone_clock(sequence.estimate_durations(views.es)), *cols)


def test_retained_groups(spark, views, folder):
    f = sequence.assign_groups(views.frags).select("feed_id", "arrival_seq", "group_id")
    s = drain(spark, streams.stream_retain_groups(feed(spark, f, folder + "/in", "arrival_seq")), folder)
    evicted = s.where("NOT late").select("feed_id", "arrival_seq", "group_id")
    assert rows(f.exceptAll(evicted)) == rows(order.retain_latest_groups(f))


def test_newest(spark, views, folder):
    o = views.shared.select("session_id", "arrival_seq")
    s = drain(spark, streams.stream_retain_newest(feed(spark, o, folder + "/in", "arrival_seq"), 20), folder)
    assert rows(o.exceptAll(s.select("session_id", "arrival_seq"))) == rows(order.retain_newest(o, 20))


def test_late_rows_leave_state_alone(spark, folder):
    cols = "feed_id bigint, arrival_seq bigint, track_name string, handler_type string, is_sync boolean"
    first = spark.createDataFrame([(1, 5, "v", "vide", True), (1, 6, "v", "vide", False)], cols)
    second = spark.createDataFrame([(1, 4, "v", "vide", True), (1, 7, "v", "vide", False)], cols)
    for d in (first, second):
        d.coalesce(1).write.mode("append").parquet(folder + "/in")
        import time

        time.sleep(1.1)
    src = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    out = rows(drain(spark, streams.stream_groups(src), folder), "arrival_seq", "group_id", "object_id", "late")
    assert out == [(4, None, None, True), (5, 0, 0, False), (6, 0, 1, False), (7, 0, 2, False)]


def test_subscriptions(spark, folder):
    subs = spark.createDataFrame([(1, 0, 0, 0, 3, 128, 1), (2, 5, 0, 9, 4, 128, 0)],
                                 "request_id bigint, start_group bigint, start_object bigint, end_group bigint, filter_type bigint, priority bigint, forward bigint")
    ups = spark.createDataFrame(
        [(1, 1, 2, 0, 0, 10, 1), (1, 2, 1, 0, 0, 11, 1), (1, 3, 3, 0, 8, 12, 1), (1, 4, 4, 0, 0, 13, 1), (1, 5, 4, 0, 6, 14, 0),
         (2, 1, 5, 0, 11, 10, 1), (2, 2, 6, 1, 10, 9, 1), (3, 1, 0, 0, 0, 1, 1)],
        "request_id bigint, update_seq bigint, start_group bigint, start_object bigint, end_group_plus_one bigint, priority bigint, forward bigint")
    state, rejects = subscribe.fold_updates(subs, ups)
    assert rows(rejects) == [(1, 2), (1, 4), (2, 1), (3, 1)]
    assert rows(state, "request_id", "start_group", "start_object", "end_group", "filter_type", "priority", "forward") == [
        (1, 4, 0, 5, 4, 14, 0), (2, 6, 1, 9, 4, 9, 1)]
    events = subs.withColumns({"is_subscribe": F.lit(True), "update_seq": F.lit(-1).cast("bigint"), "end_group_plus_one": F.lit(0).cast("bigint")}).unionByName(
        ups.withColumns({"is_subscribe": F.lit(False), "end_group": F.lit(0).cast("bigint"), "filter_type": F.lit(0).cast("bigint")}))
    s = drain(spark, streams.stream_subscriptions(feed(spark, events, folder + "/in", "update_seq")), folder)
    assert rows(s.where("NOT accepted"), "request_id", "update_seq") == rows(rejects)
    last = s.where("accepted").groupBy("request_id").agg(F.max_by(F.struct("start_group", "end_group", "priority"), "update_seq").alias("s"))
    assert rows(last, "request_id", "s.*") == [(1, 4, 5, 14), (2, 6, 9, 9)]


def test_window_stats(spark, views, folder):
    o = views.objects.select("broadcast_id", "plan_index", "media_time_us", "payload_bytes")
    s = streams.stream_stats(feed(spark, o, folder + "/in", "plan_index"), "1 hour", "15 minutes", delay="2 hours")
    q = s.writeStream.outputMode("complete").format("memory").queryName("winstats").trigger(availableNow=True).start()
    q.awaitTermination(240)
    cols = ("broadcast_id", "window_start_us", "bytes", "objects")
    assert rows(spark.table("winstats"), *cols) == rows(live.window_stats(o, 3600_000_000, 900_000_000), *cols)


def test_live_stats(spark, views, folder):
    o = views.objects.select("broadcast_id", "track_name", "plan_index", "group_id", "payload_bytes")
    s = drain(spark, streams.stream_live_stats(feed(spark, o, folder + "/in", "plan_index")), folder)
    last = s.groupBy("broadcast_id", "track_name").agg(F.max(F.struct("objects", "bytes", "groups")).alias("m"))
    total = last.groupBy("broadcast_id").agg(F.sum("m.bytes").alias("bytes"), F.sum("m.objects").alias("objects"), F.sum("m.groups").alias("groups"))
    assert rows(total) == rows(rollup.live_stats(o))


def test_retained_catalog(spark, views, folder):
    o = views.objects.select("broadcast_id", F.col("plan_index").alias("arrival_seq"), "group_id", "object_id", F.col("track_name").alias("payload"))
    from medialake.operators.catalog import retained_catalog

    s = drain(spark, streams.stream_retained_catalog(feed(spark, o, folder + "/in", "arrival_seq")), folder)
    cols = ("broadcast_id", "arrival_seq", "group_id", "object_id", "payload")
    assert rows(retained_catalog(s.select(*cols)), *cols) == rows(retained_catalog(o), *cols)


def test_settle_sessions(spark, folder):
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 400_000), (1, "c", 2_000_000), (2, "x", 100_000), (2, "y", 10_000_000)],
                              "feed_id bigint, track string, announce_us bigint")
    batch = live.settle_tracks(a)
    assert rows(batch.where("settled"), "feed_id", "track") == [(1, "a"), (1, "b"), (2, "x")]
    kept = live.settle_tracks(a, first_wait_us=30_000_000)
    assert kept.where("NOT settled").count() == 0
    s = streams.settle_stream(feed(spark, a, folder + "/in", "announce_us", 1))
    q = s.writeStream.outputMode("complete").format("memory").queryName("settle").trigger(availableNow=True).start()
    q.awaitTermination(240)
    first = spark.table("settle").groupBy("feed_id").agg(F.min_by("tracks", "first_us").alias("tracks"))
    assert rows(first) == [(1, 2), (2, 1)]


def test_demand_gate_stream(spark, folder):
    o = spark.createDataFrame([("a", 0, 5), ("a", 1, 10), ("a", 2, 20), ("b", 3, 50), ("b", 4, 5), ("c", 5, 7)],
                              "track_name string, plan_index bigint, media_time_us bigint")
    iv = spark.createDataFrame([("a", 5, 10), ("a", 7, 9), ("a", 19, 21), ("b", 40, None), ("b", 45, None), ("c", 7, 7)],
                               "track_name string, subscribe_us bigint, unsubscribe_us bigint")
    want = [(0,), (2,), (3,)]
    assert rows(subscribe.demand_gate(o, iv, False), "plan_index") == want
    assert subscribe.demand_gate(o, iv, True).count() == 6
    s = drain(spark, streams.stream_demand(feed(spark, o, folder + "/in", "plan_index", 2), iv, bucket_us=4), folder)
    assert rows(s, "plan_index") == want


def test_object_sink_is_exactly_once(spark, folder):
    o = spark.createDataFrame([(1, "t", 0, i % 4, f"p{i}") for i in range(8)], "broadcast_id bigint, track_name string, group_id bigint, object_id bigint, payload string")
    seen = []
    src = feed(spark, o.withColumn("n", F.monotonically_increasing_id()), folder + "/in", "payload", 2)
    q = write_object_stream(src, folder + "/lake", folder + "/ck", on_batch=lambda d, i: seen.append((i, d.count())))
    q.awaitTermination(240)
    stored = spark.read.parquet(folder + "/lake")
    assert stored.count() == 4 and stored.select("object_id").distinct().count() == 4
    assert sum(n for _, n in seen) == 4


def test_object_sinks_share_a_lake(spark, folder):
    """Two queries, a lost checkpoint and epoch-millisecond groups: every row is stored once."""
    schema = "broadcast_id bigint, track_name string, group_id bigint, object_id bigint, payload string"
    first, second = [(1, "t", 1_700_000_000_000, i, f"p{i}") for i in range(3)], [(1, "t", 1_700_000_000_000 + i, 0, "q") for i in range(3)] + [(2, "t", 0, 0, "r"), (None, "t", None, 0, "s")]
    for n, (data, ck) in enumerate([(first, "a"), (second, "b"), (first, "c"), (first + [(1, "t", 5, 5, "new")], "a")]):
        src = feed(spark, spark.createDataFrame(data, schema), f"{folder}/in{ck}" if n < 3 else f"{folder}/ind", "payload", 1)
        write_object_stream(src, folder + "/lake", f"{folder}/ck{ck if n < 3 else 'd'}").awaitTermination(240)
    stored = spark.read.parquet(folder + "/lake")
    want = {r[:4] for r in first + second + [(1, "t", 5, 5)]}
    got = [tuple(r) for r in stored.select("broadcast_id", "track_name", "group_id", "object_id").collect()]
    assert {r for r in got if r[2] is not None} == {r for r in want if r[2] is not None} and len([r for r in got if r[2] is not None]) == len({r for r in want if r[2] is not None})


def test_republish_timer_and_ticks(spark, folder):
    log = spark.createDataFrame([(1, 0, 1000), (1, 1, 5500)], "broadcast_id bigint, version_seq bigint, published_ms bigint")
    ticks = spark.createDataFrame([(1, t) for t in (500, 1900, 2100, 2900, 3200, 6000, 6600)], "broadcast_id bigint, tick_ms bigint")
    assert rows(live.republish_ticks(log, ticks, 1000)) == [(1, 2100, 0), (1, 3200, 0), (1, 6600, 1)]
    assert live.republish_ticks(log, ticks, 0).count() == 0
    src = feed(spark, log, folder + "/in", "version_seq", 1)
    q = streams.stream_republish(src, 500).writeStream.format("memory").queryName("republish").outputMode("append").option(
        "checkpointLocation", folder + "/ck").trigger(processingTime="300 milliseconds").start()
    import time

    for _ in range(120):
        time.sleep(0.5)
        if spark.table("republish").where("again").count() >= 2:
            break
    q.stop()
    got = spark.table("republish")
    assert rows(got.where("NOT again"), "version_seq") == [(0,), (1,)]
    assert got.where("again").count() >= 2 and got.where("again AND version_seq <> 1").count() == 0


def test_liveness(spark, folder):
    o = spark.createDataFrame([(1, 0), (1, 100), (2, 50)], "feed_id bigint, arrival_us bigint")
    c = spark.createDataFrame([(2, 300)], "feed_id bigint, close_us bigint")
    t = spark.createDataFrame([(1, 150), (1, 400), (2, 100), (2, 350)], "feed_id bigint, tick_us bigint")
    assert rows(live.liveness(o, c, t, 200)) == [(1, 150, "live"), (1, 400, "gap"), (2, 100, "live"), (2, 350, "finished")]
    ev = spark.createDataFrame([(1, False), (2, False), (2, True)], "feed_id bigint, is_close boolean")
    q = streams.stream_liveness(feed(spark, ev, folder + "/in", "feed_id", 1), 400).writeStream.format("memory").queryName("liveness").outputMode(
        "append").option("checkpointLocation", folder + "/ck").trigger(processingTime="300 milliseconds").start()
    import time

    for _ in range(120):
        time.sleep(0.5)
        if spark.table("liveness").where("state = 'gap'").count():
            break
    q.stop()
    assert rows(spark.table("liveness"), "feed_id", "state") == [(1, "gap"), (1, "live"), (2, "finished")]


def test_live_source_rules(spark):
    tracks = spark.createDataFrame([(1, "v")], "feed_id bigint, track_name string")
    o = spark.createDataFrame([(1, 0, "v", b"x"), (1, 1, "ghost", b"x"), (2, 0, "catalog", b"{}")],
                              "feed_id bigint, arrival_seq bigint, track_name string, payload binary")
    ok, bad = streams.as_live_source(o, tracks, "source")
    assert rows(ok, "feed_id", "arrival_seq") == [(2, 0)]
    assert rows(bad, "arrival_seq", "violation") == [(0, "first object is not a catalog"), (1, "unknown track")]
    assert rows(streams.as_live_source(o, tracks)[0], "feed_id", "arrival_seq") == [(1, 0), (2, 0)]


def test_pull_callback_is_a_source(spark, folder):
    from medialake.sources.live_source import pulled_source, read_pulled

    def made(options, start, stop):  # defined here so that it travels by value
        for i in range(start, stop):
            yield int(options["feed"]), i, "v", "media", i // 4, 0, i % 4, i * 1000, 1000, f"p{i}".encode(), False

    source = pulled_source("pulled_test", lambda options: 10, made, rows_per_partition=4)
    q = (read_pulled(spark, source, feed="7").writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck")
         .trigger(processingTime="1 second").start())
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(folder + "/out")
    assert rows(got, "feed_id", "arrival_seq", "group_id", "payload") == [(7, i, i // 4, bytearray(f"p{i}".encode())) for i in range(10)]


def test_live_chain_is_its_batch_twin(spark, folder):
    """Bytes in uneven chunks to numbered groups in one streaming query, next to the file scan of the same bytes."""
    import build_bytes as bb

    from medialake.functions.timing import ticks_to_micros
    from medialake.operators import rollup, sequence
    from medialake.operators.ordered import bounded
    from medialake.sources import mp4

    head = bb.init(bb.trak(1, "vide", "avc1", 90000), bb.trak(2, "soun", "mp4a", 48000), trexes=bb.trex(1, 3000, 7, 0x10000) + bb.trex(2, 1024, 3, 0))
    body = b""
    for i in range(40):
        sync = 0x02000000 if i % 7 == 2 else 0x01010000
        body += bb.moof(1, i * 9000, [dict(duration=3000 + i, size=2, flags=sync if k == 0 else 0x01010000, offset=-4000 + 500 * k) for k in range(3)]) + bb.mdat(b"vv" * 3)
        if i % 3:
            body += bb.moof(2, i * 4800, 4, tfhd=0x8, tfhd_values=(1000 + i,)) + bb.mdat(b"snd" * 4)
        if i % 5 == 0:
            body += bb.moof(1, i * 9000 + 77, [dict(size=1), dict(size=1)], first_flags=0x02000000 if i % 2 else 0x10000) + bb.mdat(b"ab")
    data = head + body
    with open(f"{folder}/whole.mp4", "wb") as f:
        f.write(data)
    cuts = [0, 100, len(head) + 10, *range(len(head) + 300, len(data), 700), len(data)]
    rows_in = [("p", i, data[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows_in, "path string, chunk_seq bigint, bytes binary")
    for part in ("chunk_seq < 9", "chunk_seq >= 9"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder + "/in")
        time.sleep(1.1)

    def drain(build, out):
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
        q = build(src).writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/ck-{out}").trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.read.parquet(f"{folder}/{out}")

    frags = drain(streams.stream_fragments, "frags")
    boxes = mp4.scan_boxes(spark, folder, "whole.mp4")
    s = mp4.samples_of(boxes).join(mp4.tracks_of(boxes).select("path", "track_id", "handler_type", "timescale", "track_name"), ["path", "track_id"])
    twin = rollup.rollup_fragments(s, ["path", "fragment_index", "track_id", "track_name"])
    place = {r["fragment_index"]: (r["track_id"], r["start_time_us"], r["duration_us"], r["earliest_presentation_time_us"], r["sap_type"], r["track_name"]) for r in twin.collect()}
    got = [(r["track_id"], r["start_us"], r["duration_us"], r["earliest_presentation_time_us"], r["sap_type"], r["track_name"]) for r in frags.orderBy("arrival_seq").collect()]
    assert got == [place[i] for i in sorted(place)] and len(got) > 60
    assert frags.where("error IS NOT NULL").count() == 0
    groups = drain(streams.stream_live_groups, "groups")
    batch = twin.select(F.lit("p").alias("path"), F.col("fragment_index").alias("arrival_seq"), "track_name", "handler_type", ((F.col("handler_type") == "vide") & (F.col("sap_type") == 2)).alias("is_sync"))
    batch = sequence.number_objects(sequence.assign_groups(batch, "path", hot=bounded("path")), "path", hot=bounded("path"))
    want = [(r["track_name"], r["group_id"], r["object_id"]) for r in batch.orderBy("arrival_seq").collect()]
    assert [(r["track_name"], r["group_id"], r["object_id"]) for r in groups.orderBy("arrival_seq").collect()] == want
    assert max(g for _, g, _ in want) > 3


def test_live_fragments_of_odd_bytes(spark, folder):
    """Unknown tracks, tracks without a clock and bad boxes are rows with an error, and several track fragments of one box are rows of their own."""
    import build_bytes as bb

    head = bb.init(bb.trak(1, "vide", "avc1", 1000), bb.trak(2, "soun", "mp4a", 0), bb.trak(3, "soun", "mp4a", 1000), trexes=bb.trex(1, 40, 0, 0))

    def traf(track, base, *parts):
        return bb.box("traf", bb.full("tfhd", 0, bb.u32(track)), bb.full("tfdt", 0, bb.u32(base)), *parts)

    def run(n, duration=None):
        return bb.full("trun", 0x100 if duration is not None else 0, bb.u32(n), *([bb.u32(duration)] * n if duration is not None else []))

    both = bb.box("moof", bb.full("mfhd", 0, bb.u32(1)), traf(1, 100, run(2), run(1, 9)), traf(3, 700, run(3, 5)), traf(2, 0, run(1)), traf(9, 0, run(1)), traf(1, 500))
    data = head + both + bb.mdat(b"x" * 9)
    df = spark.createDataFrame([("p", 0, data), ("q", 0, data + bb.u32(3) + b"oops"), ("q", 1, both)], "path string, chunk_seq bigint, bytes binary")
    df.coalesce(1).write.parquet(folder + "/in")
    src = spark.readStream.schema(df.schema).parquet(folder + "/in")
    q = streams.stream_fragments(src, payload=True).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    out = spark.read.parquet(folder + "/out")
    assert rows(out.where("path = 'p'"), "arrival_seq", "track_name", "start_us", "duration_us", "sap_type", "error") == [
        (0, "vide_1", 100000, 89000, 2, None), (1, "soun_3", 700000, 15000, 1, None), (2, "vide_1", 500000, 0, 2, None),
        (None, None, None, None, None, "track without a clock"), (None, None, None, None, None, "unknown track")]
    assert {bytes(r["payload"]) for r in out.where("error IS NULL").collect()} == {both + bb.mdat(b"x" * 9)}
    assert rows(out.where("path = 'q' AND error IS NOT NULL"), "error") == [("chunk after a bad box",), ("impossible box size",), ("track without a clock",), ("unknown track",)]


def brute_keyframe(b: bytes, hevc: bool) -> bool:
    for i in range(len(b)):
        for code in (b"\0\0\1", b"\0\0\0\1"):
            unit = i + len(code)
            if b[i:unit] == code and i + 4 < len(b) and unit < len(b):
                if hevc and 16 <= (b[unit] >> 1 & 63) <= 23 or not hevc and b[unit] & 31 == 5:
                    return True
    return False


def test_keyframes_are_brute_force(spark):
    import random

    from medialake.operators.keyframes import with_keyframes

    draw = random.Random(5)
    bodies = [bytes(draw.choice([0, 0, 0, 1, 1, 0x65, 0x41, 0x26, 0x2E, 0x02, 0x30, 5]) for _ in range(draw.randrange(0, 14))) for _ in range(3000)]
    bodies += [b"", b"\0\0\1\x65", b"\0\0\1\x65x", b"\0\0\0\1\x65", b"\0\0\0\0\1\x65", b"\0\0\1"]
    data = [(i, [0x1B, 0x24, 0x02, 0x0F, None][i % 5], b if i % 97 else None) for i, b in enumerate(bodies * 2)]
    df = spark.createDataFrame(data, "id int, stream_type int, payload binary").repartition(3)
    got = {r["id"]: (r["is_video"], r["keyframe"]) for r in with_keyframes(df).collect()}
    assert got == {i: (k in (0x1B, 0x24, 0x02), k in (0x1B, 0x24, 0x02) and brute_keyframe(b or b"", k == 0x24)) for i, k, b in data}
    assert 20 < sum(k for _, k in got.values()) < 3000
    types = spark.createDataFrame([(1, 256, 0x1B), (1, 257, 0x0F)], "feed_id bigint, pid int, stream_type int")
    samples = spark.createDataFrame([(1, 256, b"\0\0\1\x65x"), (1, 257, b"\0\0\1\x65x"), (2, 256, b"\0\0\1\x65x")], "feed_id bigint, pid int, payload binary")
    assert rows(with_keyframes(samples, types), "feed_id", "pid", "is_video", "keyframe") == [(1, 256, True, True), (1, 257, False, False), (2, 256, False, False)]


def test_packets_to_groups_in_one_stream(spark, folder):
    """Packets, samples with key-frame flags and live groups in one query equal the batch operators."""
    import build_bytes as bb

    from medialake.operators import sequence
    from medialake.operators.keyframes import with_keyframes
    from medialake.operators.ordered import bounded

    idr, plain = b"\0\0\1\x65data", b"\0\0\1\x41data"
    packets, n = [], 0
    for k in range(30):
        for pid, body in ((256, idr if k % 6 == 3 else plain), (257, b"sound")):
            packets.append((1, pid, n, True, bb.pes(body, 3000 * k)))
            packets.append((1, pid, n + 1, False, b"more"))
            n += 2
    df = spark.createDataFrame(packets, "feed_id bigint, pid int, packet_index bigint, pusi boolean, payload binary")
    types = spark.createDataFrame([(1, 256, 0x1B), (1, 257, 0x0F)], "feed_id bigint, pid int, stream_type int")
    for part in ("packet_index < 50", "packet_index >= 50"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder + "/in")
        time.sleep(1.1)

    def frags(samples):
        d = with_keyframes(samples, types)
        return d.select("feed_id", F.col("packet_index").alias("arrival_seq"), F.col("pid").cast("string").alias("track_name"), F.when(F.col("is_video"), "vide").otherwise("soun").alias("handler_type"), F.col("keyframe").alias("is_sync"))

    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    q = streams.stream_groups(frags(streams.stream_pes(src))).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    batch = sequence.number_objects(sequence.assign_groups(frags(sequence.pes_samples(df)), hot=bounded("feed_id")), hot=bounded("feed_id"))
    got = rows(spark.read.parquet(folder + "/out").where("NOT late"), "track_name", "group_id", "object_id", "arrival_seq")
    assert got == rows(batch, "track_name", "group_id", "object_id", "arrival_seq") and len(got) > 30


def state_keys(spark, checkpoint) -> set:
    """Keys that still have a last sequence number in the state store."""
    return {r["key"][0] for r in spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint).select("key").collect()}


@pytest.mark.parametrize("idle_ms", [None, 1500])
def test_state_of_idle_keys_ends(spark, folder, idle_ms):
    """Without a time to live the keys keep their state; with one, nothing of them is left some batches later."""
    schema = "feed_id bigint, arrival_seq bigint"
    spark.createDataFrame([(1, 0), (2, 0), (1, 1)], schema).coalesce(1).write.parquet(folder + "/in")
    src = spark.readStream.schema(schema).parquet(folder + "/in").withColumn("session_id", F.col("feed_id"))
    q = streams.stream_retain_newest(src, 2, idle_ms=idle_ms).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck").start()
    try:
        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.5)
        time.sleep(8 if idle_ms else 1)
    finally:
        q.stop()
    assert state_keys(spark, folder + "/ck") == (set() if idle_ms else {1, 2})
