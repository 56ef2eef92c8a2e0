"""Configuration files, traces, sinks."""

from __future__ import annotations

import json
import os

from conftest import rows
from pyspark.sql import functions as F

from medialake.operators.catalog import Catalog, catalog_json
from medialake.operators.rollup import pacing_report, wire_overhead
from medialake.sources.files import read_drm_config, read_feed_config, read_send_trace
from medialake.sources.sinks import write_catalog_json, write_object_lake

TRACE = """event,send_seq,now_ms,target_ms,delta_ms,track,group_id,subgroup_id,object_id,media_time_us,stream_id,opened,payload_bytes,wire_bytes,fin
pacing_before,1,100,110,-10,v,0,0,0,0,,,,,
pacing_after,1,111,110,1,v,0,0,0,0,,,,,
enqueue,1,,,,v,0,0,0,0,7,1,100,112,0
enqueue,2,,,,v,0,0,1,33333,7,0,50,54,1
"""


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text if isinstance(text, str) else json.dumps(text))
    return folder


def test_trace(spark, folder):
    os.makedirs(folder, exist_ok=True)
    with open(folder + "/t.csv", "w") as f:
        f.write(TRACE)
    t = read_send_trace(spark, folder + "/t.csv")
    assert t.where("stream_id IS NULL").count() == 2
    assert rows(wire_overhead(t)) == [("v", 150, 166, 16, 1, 1)]
    assert rows(pacing_report(t, ["track"], exact=True), "sends", "min_delta_ms", "max_delta_ms", "late_share") == [(2, -10, 1, 0.5)]
    assert rows(pacing_report(t), "track", "event", "sends") == [("v", "pacing_after", 1), ("v", "pacing_before", 1)]


def test_drm_config(spark, folder):
    write(folder, good={"systems": [{"systemID": "a", "laURL": "https://x", "laURLType": None}, {"systemID": "b", "robustness": "HW"}]},
          none={"other": 1}, bad={"systems": [{"laURL": "https://x"}]})
    ok, rejects = read_drm_config(spark, folder)
    assert rows(ok, "position", "system_id", "la_url", "la_url_type", "robustness") == [(0, "a", "https://x", None, None), (1, "b", None, None, "HW")]
    assert rows(rejects, "reason") == [("systemID is missing",), ("systems is missing",)]


def test_feed_config(spark, folder):
    base = {"id": "f", "srt": {"mode": "caller", "host": "h", "port": 9000}}
    feeds = [base, {**base, "id": "g", "srt": {"mode": "listener", "host": "h", "port": 1}}, {**base, "id": "p", "srt": {"mode": "caller", "host": "h", "port": 65536}},
             {**base, "id": "full", "srt": {**base["srt"], "latency_ms": 50}, "mpegts": {"program_number": 2, "auto_detect_program": False},
              "cmaf": {"empty_moov": False, "target_fragment_duration_ms": 500}}]
    ok, rejects = read_feed_config(spark, write(folder, a={"srt_callers": feeds}, b={"nothing": 1}))
    assert rows(ok, "id", "port", "latency_ms", "auto_detect_program", "program_number", "empty_moov", "fragment_on_keyframe", "target_fragment_duration_ms") == [
        ("f", 9000, 120, True, None, True, True, 1000), ("full", 9000, 50, False, 2, False, True, 500)]
    assert rows(rejects, "id", "reason") == [("g", "srt.mode is not caller"), ("p", "srt.port is not 1 to 65535"), (None, "srt_callers is missing")]


def test_object_lake(spark, folder):
    o = spark.createDataFrame([(1, "catalog", 0, 0, "initialization", b"{}"), (1, "v", 0, 0, "media", b"m"), (1, "v_sap", 0, 0, "metadata", b"[]")],
                              "broadcast_id bigint, track_name string, group_id bigint, object_id bigint, kind string, payload binary")
    inits = spark.createDataFrame([(1, "v", b"init")], "broadcast_id bigint, track_name string, init_segment binary")
    write_object_lake(o, inits, folder)
    back = spark.read.parquet(folder)
    assert rows(back, "track_name", "object_filename") == [
        ("catalog", "catalog.json"), ("v", "v_g0_o0_media.mp4"), ("v", "v_init.mp4"), ("v_sap", "v_sap_g0_o0.json")]
    assert back.where("track_name = 'v'").inputFiles()


def test_catalog_documents(spark, folder):
    t = spark.createDataFrame([(1, i, f"t{i}", "cmaf", True, 30.0 if i else 29.97, {"x": '{"a":1}'} if i == 2 else {}, ["1"] if i == 2 else [], None if i else "n s")
                               for i in range(5)],
                              "broadcast_id bigint, position bigint, name string, packaging string, is_live boolean, framerate double, "
                              "custom_fields map<string,string>, content_protection_ref_ids array<string>, namespace string")
    header = spark.createDataFrame([(1, "1", 123, False)], "broadcast_id bigint, version string, generated_at_ms bigint, is_complete boolean")
    prot = spark.createDataFrame([(1, "1", ["k"], "cenc", "sys", "P", "https://l", None)],
                                 "broadcast_id bigint, ref_id string, default_kids array<string>, scheme string, system_id string, pssh string, la_url string, la_url_type string")
    one = catalog_json(Catalog(t, header=header, protections=prot)).collect()
    doc = json.loads(one[0].document)
    assert len(one) == 1 and list(doc) == ["version", "generatedAt", "contentProtections", "tracks"]
    assert doc["tracks"][0] == {"name": "t0", "namespace": "n s", "packaging": "cmaf", "isLive": True, "framerate": 29.97}
    assert '"framerate":30,' in one[0].document or '"framerate":30}' in one[0].document
    assert list(doc["tracks"][2]) == ["name", "packaging", "isLive", "framerate", "x", "contentProtectionRefIDs"]
    assert doc["contentProtections"] == [{"refID": "1", "defaultKID": ["k"], "scheme": "cenc", "drmSystem": {"systemID": "sys", "laURL": {"url": "https://l"}, "pssh": "P"}}]
    parts = catalog_json(Catalog(t, header=header), max_items=2)
    docs = [json.loads(r.document) for r in parts.orderBy("part_index").collect()]
    names = [x["name"] for x in docs[0]["tracks"]] + [x["name"] for d in docs[1:] for x in d["deltaUpdate"][0]["tracks"]]
    assert names == [f"t{i}" for i in range(5)] and len(docs) == 3
    write_catalog_json(parts, folder)
    assert spark.read.text(folder).where(F.col("value").startswith('{"deltaUpdate"')).count() == 2
