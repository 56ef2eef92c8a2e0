"""MP4 and transport-stream scans on hand-built bytes."""

from __future__ import annotations

import os

import build_bytes as bb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from medialake.operators import order, relate, rollup, sequence, sets
from medialake.sources import mp4, ts
from medialake.streaming import streams


def put(folder: str, name: str, data: bytes) -> str:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    return folder


VIDEO = dict(duration=90000, stts=((30, 3000),), width=1920, height=1080)


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("mp4"))
    video = bb.trak(1, "vide", "avc1", 90000, "eng", children=bb.box("btrt", bb.u32(0, 5000, 4000)), **VIDEO)
    audio = bb.trak(2, "soun", "mp4a", 48000, "und", 96000)
    init = bb.init(video, audio, trexes=bb.trex(1, 3000, 7, 0x01010000) + bb.trex(2, 1024, 3, 0x02000000))
    f1 = bb.moof(1, 9000, [dict(size=4, offset=1000), dict(size=5, offset=-20000)], tfhd=0x8, tfhd_values=(1500,), first_flags=0x02000000) + bb.mdat(b"AAAABBBBB")
    f2 = bb.moof(2, 1 << 33, 3, tfhd=0x10, tfhd_values=(2,), v1=True) + bb.mdat(b"aabbcc")
    f3 = bb.moof(1, 20000, [dict(duration=100, size=1, flags=0x00010000)], tfhd=0x20, tfhd_values=(5,)) + bb.mdat(b"Z")
    put(d, "good.mp4", init + f1 + f2 + f3)
    locked = bb.trak(1, "vide", "encv", 90000, "deu", children=bb.sinf("avc1"), **VIDEO)
    half = bb.trak(2, "soun", "enca", 48000, children=bb.box("sinf", bb.box("frma", b"mp4a")))
    put(d, "locked.mp4", bb.init(locked, half, pssh=True))
    put(d, "count.mp4", init + f1 + bb.mdat(b"extra"))
    put(d, "order.mp4", init + bb.mdat(b"x") + bb.moof(1, 0, 1))
    put(d, "nomoov.mp4", bb.box("ftyp", b"isom") + f1)
    put(d, "broken.mp4", init + bb.u32(4) + b"junk")
    return mp4.scan_boxes(spark, d).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1)), d


def test_tracks(media):
    t = mp4.tracks_of(media[0]).where("path = 'good.mp4'")
    cols = ("track_id", "track_name", "handler_type", "codec", "timescale", "width", "height", "channel_count", "sample_rate", "frame_rate",
            "max_bitrate", "avg_bitrate", "duration_ms", "language")
    assert rows(t, *cols) == [
        (1, "vide_1", "vide", "avc1", 90000, 1920, 1080, 0, 0, 30.0, 5000, 4000, 1000, "en"),
        (2, "soun_2", "soun", "mp4a", 48000, 0, 0, 2, 48000, 0.0, 0, 0, 2000, "")]


def test_protection(media):
    tracks, systems = mp4.protection_of(media[0])
    assert rows(tracks, "path", "track_name", "scheme", "default_kid", "original_format") == [
        ("locked.mp4", "vide_1", "cenc", "00010203-0405-0607-0809-0a0b0c0d0e0f", "avc1")]
    import base64

    raw = bb.full("pssh", 0, bb.SYSTEM, bb.u32(0))
    assert rows(systems, "path", "system_id", "pssh") == [("locked.mp4", "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", base64.b64encode(raw).decode())]
    t = mp4.tracks_of(media[0]).where("path = 'locked.mp4'")
    assert rows(t, "track_name", "codec", "width", "language") == [("soun_2", "enca", 0, "en"), ("vide_1", "avc1", 1920, "de")]


def test_fragments_and_rejects(media):
    frags, rejects = mp4.fragments_of(media[0])
    assert rows(frags.where("path = 'good.mp4'"), "fragment_index", "track_id", "base_decode_time") == [(0, 1, 9000), (1, 2, 1 << 33), (2, 1, 20000)]
    assert frags.where("path <> 'good.mp4'").count() == 0
    assert rows(rejects) == [
        ("broken.mp4", "invalid box size for type junk"), ("count.mp4", "moof and mdat counts differ"),
        ("nomoov.mp4", "ftyp or moov is missing"), ("order.mp4", "moof follows its mdat")]


def test_payload_is_read_last(spark, media):
    boxes = mp4.scan_boxes(spark, media[1])
    frags, _ = mp4.fragments_of(boxes)
    got = mp4.attach_payload(frags.select("path", "fragment_index", "mdat_offset", "mdat_size"), "mdat_offset", "mdat_size")
    assert rows(got.where("path like '%good.mp4'"), "fragment_index", "payload") == [
        (0, bytearray(bb.mdat(b"AAAABBBBB"))), (1, bytearray(bb.mdat(b"aabbcc"))), (2, bytearray(bb.mdat(b"Z")))]


def test_samples(media):
    s = mp4.samples_of(media[0]).where("path = 'good.mp4'")
    cols = ("fragment_index", "sample_index", "decode_time", "duration", "size", "flags", "composition_offset", "payload_offset")
    assert rows(s, *cols) == [
        (0, 0, 9000, 1500, 4, 0x02000000, 1000, 0), (0, 1, 10500, 1500, 5, 0x01010000, -20000, 4),
        (1, 0, 1 << 33, 1024, 2, 0x02000000, 0, 0), (1, 1, (1 << 33) + 1024, 1024, 2, 0x02000000, 0, 2), (1, 2, (1 << 33) + 2048, 1024, 2, 0x02000000, 0, 4),
        (2, 0, 20000, 100, 1, 0x00010000, 0, 0)]


def test_fragment_rollup_from_samples(media):
    s = mp4.samples_of(media[0]).where("path = 'good.mp4'")
    t = mp4.tracks_of(media[0]).select("path", "track_id", "handler_type", "timescale")
    f = rollup.rollup_fragments(s.join(t, ["path", "track_id"]), ["path", "fragment_index"])
    cols = ("fragment_index", "start_time_us", "duration_us", "earliest_presentation_time_us", "sap_type")
    assert rows(f, *cols) == [(0, 100000, 33333, 0, 2), (1, 178956970666, 64000, 178956970666, 1), (2, 222222, 1111, 222222, 0)]


def test_box_stream(spark, folder):
    init = bb.init(bb.trak(1, "vide", "avc1", 90000, **VIDEO))
    frag = bb.moof(1, 0, 1) + bb.mdat(b"one")
    ghost = bb.moof(9, 0, 1) + bb.mdat(b"two")
    wide = bb.u32(1) + b"free" + (20).to_bytes(8, "big") + b"data"
    data = bb.mdat(b"early") + init + bb.mdat(b"orphan") + frag + wide + ghost + frag
    cuts = [0, 5, 20, 21, 200, len(data) - 30, len(data) - 3, len(data)]
    chunks = [("p", i, data[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("bad", 0, init), ("bad", 1, bb.u32(3) + b"oops"), ("bad", 2, frag)]
    df = spark.createDataFrame(chunks, "path string, chunk_seq bigint, bytes binary")
    for part in ("chunk_seq < 3", "chunk_seq >= 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder + "/in")
        import time

        time.sleep(1.1)
    from medialake.sources.files import read_chunk_stream

    q = (streams.stream_boxes(read_chunk_stream(spark, folder + "/in", 1)).writeStream.format("parquet").option("path", folder + "/out")
         .option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start())
    q.awaitTermination(240)
    out = spark.read.parquet(folder + "/out")
    assert rows(out.where("path = 'p' AND kind = 'fragment'"), "track_id", "fragment") == [(1, bytearray(frag))] * 2
    assert rows(out.where("path = 'p' AND kind = 'init'"), "init_bytes") == [(bytearray(init),)]
    assert rows(out.where("path = 'p' AND kind = 'dropped'"), "error") == [("mdat before init",), ("mdat without moof",), ("unknown track",)]
    assert rows(out.where("path = 'bad'"), "kind", "error") == [("dropped", "chunk after a bad box"), ("error", "impossible box size"), ("init", None)]


def two_programs(m2ts: bool) -> bytes:
    kw = dict(m2ts=m2ts)
    return b"".join([
        bb.pat([(0, 0x10), (1, 0x100), (2, 0x110)], **kw), bb.pmt(0x100, 1, 0x101, [(0x1B, 0x101, b"")], **kw),
        bb.pmt(0x110, 2, 0x111, [(0x06, 0x112, b"xy"), (0x0F, 0x111, b"")], b"info", **kw),
        bb.packet(0x101, b"a", True, 0, **kw), bb.packet(0x111, b"b", True, 0, **kw), bb.packet(0x101, b"c", False, 2, 10, **kw), bb.packet(0x1FFF, **kw)])


@pytest.mark.parametrize("m2ts", [False, True])
def test_ts_programs(spark, folder, m2ts):
    put(folder, "good.ts", two_programs(m2ts))
    put(folder, "short.ts", two_programs(m2ts)[:-1])
    bad = bytearray(two_programs(m2ts))
    bad[-(192 if m2ts else 188) + (4 if m2ts else 0)] = 0
    put(folder, "lost.ts", bytes(bad))
    packets, rejects = ts.scan_ts_packets(spark, folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    packets, rejects = packets.withColumn("path", name), rejects.withColumn("path", name)
    assert rows(rejects) == [("lost.ts", "packet without sync byte"), ("short.ts", "partial or invalid packet alignment")]
    assert rows(packets, "path", "packet_index", "pid", "pusi", "afc", "continuity") == [
        ("good.ts", 0, 0, True, 1, 0), ("good.ts", 1, 0x100, True, 1, 0), ("good.ts", 2, 0x110, True, 1, 0), ("good.ts", 3, 0x101, True, 1, 0),
        ("good.ts", 4, 0x111, True, 1, 0), ("good.ts", 5, 0x101, False, 3, 2), ("good.ts", 6, 0x1FFF, False, 1, 0)]
    pat, pmt = ts.explode_psi(packets)
    assert rows(pat, "position", "program", "pmt_pid") == [(0, 0, 0x10), (1, 1, 0x100), (2, 2, 0x110)]
    assert rows(pmt, "program", "pcr_pid", "position", "stream_type", "elementary_pid") == [
        (1, 0x101, 0, 0x1B, 0x101), (2, 0x111, 0, 6, 0x112), (2, 0x111, 1, 0x0F, 0x111)]
    picked = order.pick_program(pat, file="path")
    assert rows(picked) == [("good.ts", 1, 0x100)]
    assert rows(order.pick_program(pat, 2, file="path")) == [("good.ts", 2, 0x110)]
    assert rows(order.pick_streams(pmt, "path"), "program", "video_pid", "audio_pid") == [(1, 0x101, None), (2, None, 0x111)]
    pids = sets.program_pids(picked, pmt, "path")
    kept = relate.select_program(packets.withColumn("pid", F.col("pid").cast("bigint")), pids, "path")
    assert rows(kept, "pid") == [(0,), (0x100,), (0x101,), (0x101,), (0x1FFF,)]
    assert rows(rollup.pid_inventory(packets, "path"), "pid", "packets", "unit_starts", "continuity_gaps") == [
        (0, 1, 1, 0), (0x100, 1, 1, 0), (0x101, 2, 1, 1), (0x110, 1, 1, 0), (0x111, 1, 1, 0), (0x1FFF, 1, 0, 0)]


def test_ts_resync(spark, folder):
    data = two_programs(False)
    put(folder, "cut.ts", b"junk" + data[:188 * 3] + b"noise!" + data[188 * 3:])
    packets, _ = ts.scan_ts_packets(spark, folder, resync=True)
    assert rows(packets, "packet_index", "pid") == [(0, 0), (1, 0x100), (2, 0x110), (3, 0x101), (4, 0x111), (5, 0x101), (6, 0x1FFF)]


def test_big_ts_is_split(spark, folder, monkeypatch):
    monkeypatch.setattr(ts, "PACKETS_PER_TASK_ROW", 16)
    put(folder, "many.ts", b"".join(bb.packet(32 + i % 3, continuity=i // 3) for i in range(100)))
    packets, _ = ts.scan_ts_packets(spark, folder)
    assert packets.count() == 100 and packets.select("packet_index").distinct().count() == 100


def test_pes_stream(spark, folder):
    rows_in = [
        (1, 256, 0, False, b"lost"), (1, 256, 1, True, bb.pes(b"one", 1 << 32)), (1, 256, 2, False, b"-two"), (1, 257, 3, True, bb.pes(b"snd", 90000)),
        (1, 256, 4, True, bb.pes(b"next", 3000)), (1, 257, 5, True, b"bad"), (1, 257, 6, False, b"tail"), (1, 257, 7, True, bb.pes(b"z")), (1, 256, 8, False, None)]
    df = spark.createDataFrame(rows_in, "feed_id bigint, pid int, packet_index bigint, pusi boolean, payload binary")
    for part in ("packet_index < 3", "packet_index >= 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder + "/in")
        import time

        time.sleep(1.1)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    q = (streams.stream_pes(src).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    out = spark.read.parquet(folder + "/out")
    want = [(256, 1, 1 << 32, bytearray(b"one-two")), (257, 3, 90000, bytearray(b"snd")), (257, 5, 0, bytearray(b"tail"))]
    assert rows(out, "pid", "packet_index", "pts90k", "payload") == want
    assert rows(sequence.pes_samples(df), "pid", "packet_index", "pts90k", "payload") == want
    assert rows(sequence.pes_samples(df, flush_last=True), "pid", "packet_index")[1] == (256, 4)


def test_every_run_of_every_track_fragment(spark):
    """Two track fragments of two runs and six samples; the reference mode reads the first run alone."""
    from build_bytes import box, full, init, mdat, trak, trex, u32

    def run(*sizes, first=None):
        return full("trun", 0x200 | 0x1 | (0x4 if first is not None else 0), u32(len(sizes), 0), u32(first) if first is not None else b"", u32(*sizes))

    def traf(track, base, *runs):
        return box("traf", full("tfhd", 0, u32(track)), full("tfdt", 0, u32(base)), *runs)

    head = init(trak(1, "vide", "avc1", 1000), trak(2, "soun", "mp4a", 1000), trexes=trex(1, 40, 0, 0x10000) + trex(2, 20, 0, 0))
    body = box("moof", full("mfhd", 0, u32(1)), traf(1, 100, run(5, 6, first=7), run(1)), traf(2, 900, run(2), run(3, 4, first=9)))
    files = spark.createDataFrame([("m.mp4", bytearray(head + body + mdat(bytes(21)))), ("junk.txt", bytearray(b"not a media file"))], "path string, content binary")
    boxes = mp4.boxes_of_files(files)
    got = rows(mp4.samples_of(boxes), "track_id", "run_index", "sample_index", "decode_time", "size", "payload_offset", "flags")
    assert got == [(1, 0, 0, 100, 5, 0, 7), (1, 0, 1, 140, 6, 5, 0x10000), (1, 1, 2, 180, 1, 11, 0x10000), (2, 0, 0, 900, 2, 12, 0), (2, 1, 1, 920, 3, 14, 9), (2, 1, 2, 940, 4, 17, 0)]
    assert mp4.samples_of(boxes, mode="reference").count() == 2
    frags, rejects = mp4.fragments_of(boxes)
    assert rows(frags, "fragment_index", "traf_index", "track_id", "base_decode_time") == [(0, 0, 1, 100), (0, 1, 2, 900)]
    assert [r["path"] for r in rejects.collect()] == ["junk.txt"]


def run_at(offset: int | None, *sizes: int) -> bytes:
    return bb.full("trun", 0x200 | (0x1 if offset is not None else 0), bb.u32(len(sizes)), (offset & 0xFFFFFFFF).to_bytes(4, "big") if offset is not None else b"", bb.u32(*sizes))


def traf_of(track: int, *runs: bytes, flags: int = 0, base: int | None = None) -> bytes:
    head = bb.full("tfhd", flags | (0x1 if base is not None else 0), bb.u32(track), base.to_bytes(8, "big") if base is not None else b"")
    return bb.box("traf", head, bb.full("tfdt", 0, bb.u32(0)), *runs)


def fragment_of(*trafs: bytes) -> bytes:
    return bb.box("moof", bb.full("mfhd", 0, bb.u32(1)), *trafs)


HEAD = bb.init(bb.trak(1, "vide", "avc1", 1000), bb.trak(2, "soun", "mp4a", 1000), trexes=bb.trex(1, 40, 0, 0) + bb.trex(2, 20, 0, 0))


def places(spark, folder, name, build, data, before=b""):
    """Bytes of the samples of (track, run) of one fragment; ``build`` gets the place of the data from the moof's start and the moof's place in the file."""
    size = len(build(0, 0))
    moof_at = len(HEAD) + len(before)
    put(folder, name, HEAD + before + build(size + 8, moof_at) + bb.mdat(data))
    s = mp4.scan_samples(spark, folder, name)
    got = mp4.attach_payload(s.select("path", "traf_index", "track_id", "run_index", "sample_index", "file_offset", "size", "payload_offset", "place_error"), "file_offset", "size", "body")
    return {(r["traf_index"], r["sample_index"]): (r["track_id"], bytes(r["body"]).decode() if r["body"] is not None else r["place_error"]) for r in got.collect()}


def test_interleaved_runs_get_their_own_bytes(spark, folder):
    # the second track fragment has no base of its own: its offset counts from the end of the first one's data
    back = places(spark, folder, "inter.mp4", lambda at, _: fragment_of(traf_of(1, run_at(at, 2), run_at(at + 4, 2)), traf_of(2, run_at(-4, 2))), b"A1b1A2")
    assert back == {(0, 0): (1, "A1"), (0, 1): (1, "A2"), (1, 0): (2, "b1")}
    moofs = places(spark, folder, "base.mp4", lambda at, _: fragment_of(traf_of(1, run_at(at, 2), run_at(at + 4, 2), flags=0x20000), traf_of(2, run_at(at + 2, 2), flags=0x20000)), b"A1b1A2")
    assert moofs == {(0, 0): (1, "A1"), (0, 1): (1, "A2"), (1, 0): (2, "b1")}


def test_places_by_every_kind_of_base(spark, folder):
    free = bb.box("free", bytes(50))
    # a base given by the header, with and without offsets of the runs
    given = places(spark, folder, "given.mp4", lambda at, moof: fragment_of(traf_of(1, run_at(2, 2), run_at(None, 1), base=moof + at), traf_of(2, run_at(None, 2), base=moof + at)), b"b1A2x", free)
    assert given == {(0, 0): (1, "A2"), (0, 1): (1, "x"), (1, 0): (2, "b1")}
    # no offsets at all: runs lie one after another
    plain = places(spark, folder, "plain.mp4", lambda at, _: fragment_of(traf_of(1, run_at(None, 1, 1), run_at(None, 1)), traf_of(2, run_at(None, 2), flags=0x20000)), b"abcde")
    assert plain == {(0, 0): (1, "a"), (0, 1): (1, "b"), (0, 2): (1, "c"), (1, 0): (2, "de")}
    # a run without offset follows the one before, also when that one has an offset
    follow = places(spark, folder, "follow.mp4", lambda at, _: fragment_of(traf_of(1, run_at(at + 3, 1), run_at(None, 1), run_at(at, 1))), b"xyzab")
    assert follow == {(0, 0): (1, "a"), (0, 1): (1, "b"), (0, 2): (1, "x")}
    # offsets that count from the end of the track fragment before
    after = places(spark, folder, "after.mp4", lambda at, _: fragment_of(traf_of(1, run_at(at, 2)), traf_of(2, run_at(1, 1), run_at(3, 1), run_at(None, 1), run_at(0, 1), run_at(2, 1))), b"AA0123456")
    # 0 counts as none: that run follows
    assert after == {(0, 0): (1, "AA"), (1, 0): (2, "1"), (1, 1): (2, "3"), (1, 2): (2, "4"), (1, 3): (2, "5"), (1, 4): (2, "2")}
    # bytes outside of the fragment's data are no guess
    out = places(spark, folder, "out.mp4", lambda at, _: fragment_of(traf_of(1, run_at(at + 4, 2), run_at(at, 1), run_at(-5, 1))), b"abcde")
    assert out == {(0, 0): (1, "outside its mdat"), (0, 1): (1, "a"), (0, 2): (1, "outside its mdat")}
    reference = mp4.scan_samples(spark, folder, "follow.mp4", mode="reference")
    assert rows(reference, "run_index", "payload_offset") == [(0, 0)]


def test_large_file_is_walked_by_many_tasks(spark, folder):
    """A sparse file of 5 GB with boxes of 250 MB that nobody reads."""
    n, hole = 20, 250 << 20
    with open(f"{folder}/large.mp4", "wb") as f:
        f.write(HEAD + bb.box("uuid", bytes(100)))
        for i in range(n):
            moof = bb.moof(1, i * 1000, [dict(size=5)])
            f.write(moof + bb.u32(1) + b"mdat" + (16 + hole).to_bytes(8, "big") + b"first")
            f.seek(hole - 5, 1)
        f.truncate(f.tell())
    boxes = mp4.scan_boxes(spark, folder, "large.mp4")
    assert boxes.where("tree = 'moof/traf/trun'").select(F.spark_partition_id()).distinct().count() > 2
    assert boxes.where("payload IS NOT NULL AND NOT split(tree, '/')[size(split(tree, '/')) - 1] IN " + str(mp4.USED)).count() == 0
    frags, rejects = mp4.fragments_of(boxes)
    assert frags.count() == n and rejects.count() == 0
    s = mp4.scan_samples(spark, folder, "large.mp4")
    got = mp4.attach_payload(s.select("path", "fragment_index", "file_offset", "size"), "file_offset", "size")
    assert {bytes(r["payload"]) for r in got.collect()} == {b"first"}


def test_init_segments_and_codec_text(spark, folder):
    avcc = bb.box("avcC", bytes([1, 0x64, 0x00, 0x1F, 0xFF]))
    init = bb.init(bb.trak(1, "vide", "avc1", 90000, children=avcc), bb.trak(2, "vide", "avc3", 90000), bb.trak(3, "soun", "Opus", 48000), bb.trak(4, "soun", "mp4a", 48000))
    put(folder, "a.mp4", init + bb.box("free", bytes(9)) + bb.moof(1, 0, 1) + bb.mdat(b"x"))
    put(folder, "none.mp4", bb.box("free", b""))
    assert [(r["init_size"], bytes(r["init"])) for r in mp4.scan_inits(spark, folder).collect()] == [(len(init), init)]
    assert rows(mp4.scan_tracks(spark, folder), "track_id", "codec", "codec_text") == [(1, "avc1", "avc1.64001f"), (2, "avc3", "avc1"), (3, "Opus", "opus"), (4, "mp4a", "mp4a")]
