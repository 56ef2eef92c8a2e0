"""Media operators on rows of known cases."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from medialake.operators import catalog, expand, live, project, relate, rollup, sequence, sets
from medialake.operators.catalog import Catalog
from medialake.operators.ordered import bounded

SAMPLE = "asset_id bigint, handler_type string, sample_index bigint, duration bigint, timescale bigint, sync boolean, composition_offset bigint, size bigint"


def track(n, sync, handler="vide", asset=1, duration=1000, timescale=25000):
    return [(asset, handler, i, duration, timescale, i + 1 in sync, 0, 10) for i in range(n)]


def test_eight_samples_two_gops(spark):
    o = sequence.coalesce_gops(spark.createDataFrame(track(8, {1, 5}), SAMPLE))
    assert rows(o, "object_id", "sample_count", "sap_type", "start_time_us", "duration_us") == [(0, 4, 2, 0, 160000), (1, 4, 2, 160000, 160000)]


def test_long_gop_is_capped(spark):
    o = sequence.coalesce_gops(spark.createDataFrame(track(520, {1}), SAMPLE))
    assert rows(o, "object_id", "sample_count", "sap_type") == [(0, 120, 2), (1, 120, 0), (2, 120, 0), (3, 120, 0), (4, 40, 0)]


def gops_by_hand(video, sound, cap=120):
    starts, t = [], 0
    for _, _, i, d, scale, sync, _, _ in video:
        if i == 0 or sync:
            starts.append(t * 1000000 // scale)
        t += d
    cuts, at, t = [0], 0, 0
    for _, _, i, d, scale, *_ in sound:
        us, moved = t * 1000000 // scale, False
        while at + 1 < len(starts) and us >= starts[at + 1]:
            at, moved = at + 1, True
        if moved and i:
            cuts.append(i)
        t += d
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(sound)]):
        out += [min(cap, b - c) for c in range(a, b, cap)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sound_follows_video_gops(spark, seed):
    rng = random.Random(seed)
    video = track(60, {1} | set(rng.sample(range(2, 61), 6)), duration=rng.choice([900, 1500]))
    sound = track(400, set(), "soun", duration=rng.choice([200, 317]), timescale=rng.choice([8000, 22050]))
    o = sequence.coalesce_gops(spark.createDataFrame(video + sound, SAMPLE), cap=50).where("handler_type = 'soun'").orderBy("object_id")
    assert [r.sample_count for r in o.collect()] == gops_by_hand(video, sound, 50)


def test_sound_without_video_is_one_group(spark):
    o = sequence.coalesce_gops(spark.createDataFrame(track(130, set(), "soun"), SAMPLE))
    assert rows(o, "object_id", "sample_count", "sap_type", "gop") == [(0, 120, 1, 0), (1, 10, 1, 0)]


def test_shared_groups_case(spark):
    data = [("a", "soun", 0, False, 0), ("v", "vide", 0, True, 1), ("v", "vide", 1000, False, 2), ("a", "soun", 1024, False, 3), ("v", "vide", 2000, True, 4), ("a", "soun", 2048, False, 5),
            ("w", "vide", 2100, False, 6), ("w", "vide", 2000, True, 7), ("w", "vide", 2200, False, 8), ("v", "vide", 1500, True, 9)]
    df = spark.createDataFrame([(1, "p", *r) for r in data], "session_id bigint, path string, track_name string, handler_type string, start_us bigint, is_sync boolean, arrival_seq bigint")
    got = rows(sequence.assign_shared_groups(df), "arrival_seq", "group_id", "object_id")
    assert got == [(1, 0, 0), (2, 0, 1), (3, 0, 0), (4, 1, 0), (5, 1, 0), (7, 1, 0), (8, 1, 1)]
    silent = df.where("handler_type = 'soun'")
    assert rows(sequence.assign_shared_groups(silent), "arrival_seq", "group_id", "object_id") == [(0, 0, 0), (3, 1, 0), (5, 2, 0)]


def test_sap_and_media_timelines(spark):
    f = spark.createDataFrame([(1, "v", 0, 0, 0, 0, 2), (1, "v", 0, 1, 500_000, 500_000, 0), (1, "a", 0, 0, 0, 0, None)],
                              "broadcast_id bigint, track_name string, group_id bigint, object_id bigint, media_time_us bigint, earliest_presentation_time_us bigint, sap_type int")
    f = f.withColumn("plan_index", F.col("object_id"))
    assert rows(rollup.sap_timeline(f), "track_name", "timeline") == [("v", '[{"l":[0,0],"data":[2,0]},{"l":[0,1],"data":[0,500]}]')]
    assert rows(rollup.media_timeline_text(f), "timeline") == [("[[0,[0,0],0],[500,[0,1],0]]",)]
    assert rows(rollup.sap_maxima(f)) == [(1, "a", None, None), (1, "v", 2, 2)]


def test_durations(spark):
    pts = [0, 20000, 10000, 900000, 920000]
    es = spark.createDataFrame([(1, "v", True, 90000, i, p) for i, p in enumerate(pts)], "feed_id bigint, track_name string, is_video boolean, timescale bigint, arrival_seq bigint, pts_us bigint")
    d = sequence.monotone_clock(sequence.estimate_durations(es))
    assert rows(d, "arrival_seq", "duration_us", "decode_time") == [(0, 33333, 0), (1, 33333, 2999), (2, 33333, 5998), (3, 33333, 8997), (4, 20000, 11996)]


def test_expand_runs_with_counts(spark):
    runs = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 3, -7), (2, 0, 1, 9)], "asset_id bigint, run_index bigint, run_count bigint, value bigint")
    counts = spark.createDataFrame([(1, 4), (2, 3), (3, 1)], "asset_id bigint, sample_count bigint")
    assert rows(expand.expand_runs(runs, sample_counts=counts)) == [(1, 0, 5), (1, 1, 5), (1, 2, -7), (1, 3, -7), (2, 0, 9), (2, 1, 0), (2, 2, 0), (3, 0, 0)]
    big = spark.createDataFrame([(1, 0, 25000, 1)], "asset_id bigint, run_index bigint, run_count bigint, value bigint")
    assert expand.expand_runs(big).agg(F.sum("value"), F.max("sample_index")).first()[:] == (25000, 24999)


def test_audio_frames_do_not_drift(spark):
    p = spark.createDataFrame([(1, 1000, 44100, 4)], "id bigint, pts90k bigint, sample_rate int, frame_count int")
    assert rows(sequence.expand_audio_frames(p), "frame_pts90k") == [(1000 + (k * 1024 * 90000 + 22050) // 44100,) for k in range(4)]


def test_bitrate_ladder(spark):
    t = spark.createDataFrame([(1, "a", "vide", 5), (1, "b", "vide", 0), (1, "c", "soun", 0), (1, "d", "soun", 0)], "asset_id bigint, track_name string, handler_type string, max_bitrate bigint")
    conf = spark.createDataFrame([(1, "b", 7)], "asset_id bigint, track_name string, configured_bitrate bigint")
    meas = spark.createDataFrame([(1, "b", 9), (1, "c", 11)], "asset_id bigint, track_name string, measured_bitrate bigint")
    assert rows(project.resolve_bitrate(t, conf, meas), "track_name", "bitrate", "estimated") == [("a", 5, False), ("b", 7, False), ("c", 11, False), ("d", 128000, True)]


def test_attach_track_without_match(spark):
    f = spark.createDataFrame([(1, 1), (1, 9)], "asset_id bigint, track_id bigint")
    t = spark.createDataFrame([(1, 1, "v", 90000)], "asset_id bigint, track_id bigint, track_name string, timescale bigint")
    assert rows(relate.attach_track(f, t), "track_id", "track_name", "timescale") == [(1, "v", 90000), (9, "media", 0)]
    assert rows(relate.attach_track(f, t, "drop"), "track_id") == [(1,)]


SNAP = "broadcast_id bigint, version_seq bigint, namespace string, name string, bitrate bigint"


def snap(version, *names, rate=1, broadcast=1):
    return [(broadcast, version, None, n, rate) for n in names]


def test_change_log_steps(spark):
    s = snap(0, "a") + snap(1, "a", "b") + snap(2, "a", "b") + snap(3, "b") + snap(4, "b", rate=2) + snap(5, "b", "c", rate=2)
    log = catalog.catalog_log(spark.createDataFrame(s, SNAP))
    assert rows(log, "version_seq", "kind", "group_id", "object_id", "added", "removed") == [
        (0, "independent", 0, 0, None, None), (1, "delta", 0, 1, 1, 0), (3, "delta", 0, 2, 0, 1), (4, "independent", 1, 0, None, None), (5, "delta", 1, 1, 1, 0)]
    once = catalog.catalog_log(spark.createDataFrame(s, SNAP), max_deltas=1)
    assert rows(once, "version_seq", "kind", "group_id", "object_id") == [
        (0, "independent", 0, 0), (1, "delta", 0, 1), (3, "independent", 1, 0), (4, "independent", 2, 0), (5, "delta", 2, 1)]


def log_by_hand(snaps, bound):
    out, last, group, obj, deltas = [], None, -1, 0, 0
    for v in sorted(snaps):
        now = snaps[v]
        if last is not None and now == last:
            continue
        moved = last is not None and (now.keys() - last.keys() or last.keys() - now.keys())
        changed = last is not None and any(now[k] != last[k] for k in now.keys() & last.keys())
        if last is None or changed or not moved or deltas >= bound:
            group, obj, deltas = group + 1, 0, 0
            out.append((v, "independent", group, 0))
        else:
            obj, deltas = obj + 1, deltas + 1
            out.append((v, "delta", group, obj))
        last = now
    return out


def test_change_log_against_simulation_and_replay(spark):
    rng = random.Random(4)
    snaps, data, state = {}, [], {"a": 1}
    for v in range(40):
        for n in "abcdefg":
            r = rng.random()
            if r < .07:
                state.pop(n, None)
            elif r < .14:
                state.setdefault(n, 1)
            elif r < .15 and n in state:
                state[n] += 1
        if not state:
            state["a"] = 1
        snaps[v] = dict(state)
        data += [(1, v, None, n, b) for n, b in state.items()]
    df = spark.createDataFrame(data, SNAP)
    log = catalog.catalog_log(df, max_deltas=3)
    assert rows(log, "version_seq", "kind", "group_id", "object_id") == log_by_hand(snaps, 3)
    ops = {}
    for r in catalog.delta_operations(log, catalog.version_changes(df)).collect():
        ops.setdefault(r.version_seq, []).append((r.op, r.name))
    current = None
    for v, kind, _, _ in log_by_hand(snaps, 3):
        if kind == "independent":
            current = set(snaps[v])
        else:
            for op, n in ops[v]:
                (current.add if op == "add" else current.remove)(n)
        assert current == set(snaps[v])


def test_log_flags_end_and_forced_copies(spark):
    s = spark.createDataFrame(snap(0, "a") + snap(1, "a", "b") + snap(2, "a", "b") + snap(3, "a"), SNAP)
    v = spark.createDataFrame([(1, 0, False, False), (1, 1, True, False), (1, 2, False, True), (1, 3, False, False)],
                              "broadcast_id bigint, version_seq bigint, other_changed boolean, ended boolean")
    log = catalog.catalog_log(s, versions=v)
    assert rows(log, "version_seq", "kind", "group_id") == [(0, "independent", 0), (1, "independent", 1), (2, "independent", 2)]
    assert rows(catalog.changes_after_end(v), "version_seq") == [(3,)]
    logged = log.join(v.select("broadcast_id", "version_seq", "ended"), ["broadcast_id", "version_seq"])
    asks = spark.createDataFrame([(1, 1), (1, 5), (2, 1)], "broadcast_id bigint, request_seq bigint")
    out, errors = catalog.force_independent(logged, asks)
    assert rows(out, "broadcast_id", "request_seq", "version_seq", "group_id") == [(1, 1, 1, 2)]
    assert rows(errors, "request_seq") == [(5,)]


def test_delta_documents(spark):
    df = spark.createDataFrame(snap(0, "a") + snap(1, "b", "c"), SNAP)
    log = catalog.catalog_log(df)
    docs = catalog.delta_json(catalog.delta_operations(log, catalog.version_changes(df)), df.withColumn("packaging", F.lit("cmaf")))
    assert rows(docs, "document") == [(
        '{"deltaUpdate":[{"op":"add","tracks":[{"name":"b","packaging":"cmaf","bitrate":1},{"name":"c","packaging":"cmaf","bitrate":1}]},{"op":"remove","tracks":[{"name":"a"}]}]}',)]


def test_convert_drops_protection_list_and_shows_it(spark):
    t = spark.createDataFrame([(1, 0, "v", "cmaf", "video", True, 5, ["1"])], "broadcast_id bigint, position bigint, name string, packaging string, role string, is_live boolean, bitrate bigint, content_protection_ref_ids array<string>")
    t = catalog.complete_tracks(t)
    p = spark.createDataFrame([(1, "1", ["00010203-0405-0607-0809-0a0b0c0d0e0f"], "cenc", "nope")], "broadcast_id bigint, ref_id string, default_kids array<string>, scheme string, system_id string")
    assert rows(catalog.validate_catalog(Catalog(t, protections=p)), "rule") == [("systemID is not a UUID",)]
    d = spark.createDataFrame([("v", 1234)], "name string, duration_ms bigint")
    out = catalog.end_broadcast(Catalog(t, protections=p), d, "convert")
    assert out.protections is None and rows(out.tracks, "is_live", "track_duration_ms") == [(False, 1234)]
    empty = p.limit(0)
    assert rows(catalog.validate_catalog(Catalog(out.tracks, protections=empty)), "rule") == [("protection reference has no entry",)]


def test_custom_field_rules(spark):
    t = spark.createDataFrame([(1, "v", "cmaf", {"codec": "1"}), (1, "w", "cmaf", {"mine": ""}), (1, "x", "cmaf", {"mine": "1"}), (1, "", "", {})],
                              "broadcast_id bigint, name string, packaging string, custom_fields map<string,string>")
    assert rows(catalog.validate_tracks(t), "track", "rule") == [
        ("", "name is empty"), ("", "packaging is empty"), ("v", "custom field name is reserved"), ("w", "custom field is empty")]


def test_catalog_equality_sections(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "broadcast_id bigint, position bigint, name string")
    h = spark.createDataFrame([(1, "1", None, 5), (2, "1", None, 5)], "broadcast_id bigint, version string, is_complete boolean, generated_at_ms bigint")
    swapped = t.withColumn("position", F.when(F.col("broadcast_id") == 1, 1 - F.col("position")).otherwise(F.col("position")))
    later = h.withColumn("generated_at_ms", F.lit(9))
    assert rows(catalog.catalogs_equal(Catalog(t, h), Catalog(t, later))) == [(1, True), (2, True)]
    assert rows(catalog.catalogs_equal(Catalog(t, h), Catalog(swapped, h))) == [(1, False), (2, True)]


def test_plan_ids(spark):
    t = spark.createDataFrame([(1, 3, "vide", "avc1", "v"), (1, 7, "soun", "mp4a", "s")], "asset_id bigint, track_id bigint, handler_type string, codec string, track_name string")
    assert rows(sets.plan_tracks(t), "track_id", "track_name", "depends_on") == [(0, "catalog", None), (3, "v", None), (7, "s", None), (8, "timeline", None), (9, "v_sap", "v"), (10, "s_sap", "s")]
    assert rows(rollup.track_summary(t), "summary") == [("v(vide:avc1), s(soun:mp4a)",)]
    assert rows(rollup.track_summary(t, max_items=1), "part_index", "summary") == [(0, "v(vide:avc1)"), (1, "s(soun:mp4a)")]


def test_protection_ranks(spark):
    refs = spark.createDataFrame([(1, 0, 0, "s1", "cenc", "k1", "p1"), (1, 0, 1, "s2", "cenc", "k1", "p2"), (1, 1, 0, "s1", "cenc", "k2", "px"), (1, 2, 0, "s1", "cbcs", "k1", "p3"), (1, 3, 0, "s1", "cenc", "k1", "p9")],
                                 "asset_id bigint, track_seq bigint, system_seq bigint, system_id string, scheme string, kid string, pssh string")
    assert rows(rollup.protection_entries(refs), "ref_id", "system_id", "scheme", "pssh") == [("1", "s1", "cenc", "p1"), ("2", "s2", "cenc", "p2"), ("3", "s1", "cbcs", "p3")]
    assert rows(rollup.protection_kids(refs).where("system_id = 's1' AND scheme = 'cenc'"), "kid_index", "kid") == [(0, "k1"), (1, "k2")]


def test_codec_window(spark):
    es = spark.createDataFrame([(1, True, 0, 0, None), (1, True, 1, 4_000_000, "h264"), (1, True, 2, 4_100_000, "hevc"), (1, False, 3, 6_000_000, "aac")],
                               "feed_id bigint, is_video boolean, arrival_seq bigint, arrival_us bigint, codec_params string")
    found, removed = live.discover_codecs(es)
    assert rows(found, "is_video", "codec_params", "found_seq") == [(True, "h264", 1)] and rows(removed, "is_video") == [(False,)]


def test_packets_with_tables(spark):
    p = spark.createDataFrame([(1, i, 257) for i in range(360)], "file_id bigint, packet_index bigint, pid int")
    psi = spark.createDataFrame([(1, 0, 0), (1, 256, 1)], "file_id bigint, pid int, psi_order bigint")
    d = sequence.packetise(p, psi, hot=bounded("file_id"))
    assert rows(d.where("is_psi"), "object_id", "pid", "media_time_us") == [(0, 0, 0), (0, 256, 0), (50, 0, 500000), (50, 256, 500000)]
    assert rows(d.where("NOT is_psi").groupBy("object_id").count().where("count <> 7"), "object_id", "count") == [(51, 3)]
    n = sequence.renumber_continuity(d.where("is_psi"), order=["object_id", "slot"])
    assert rows(n, "pid", "object_id", "continuity") == [(0, 0, 0), (0, 50, 1), (256, 0, 0), (256, 50, 1)]
