"""Link text, ranges and their round trips."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from medialake.functions import text
from medialake.operators.links import build_links, link_ranges, parse_links
from medialake.operators.sets import merge_ranges

GOOD = {
    "plain": "moqt://relay.example.com/path#msf:customer-livestream-123--catalog",
    "escaped": "MOQT://h#msf:a.2db--t",
    "dot": "moqt://h:4433?x=1#msf:a.2eb--t",
    "utf8": "moqt://h/#msf:.c3.a9--t",
    "params": "moqt://h:443/a?q=1&r=2#msf:a-b--t&connection=wt&wallclock-range=5-9&wallclock-range=1-6&mediatime-range=7&extra=a=b&location-range=3.1-4&location-range=4.9-6&c4m=tok",
}
BAD = {
    "http://h#msf:a--b": "scheme is not moqt", "moqt://h/x": "fragment is missing", "moqt://#msf:a--b": "host is empty", "moqt://:1#msf:a--b": "host is empty",
    "moqt://h:0#msf:a--b": "port is not 1 to 65535", "moqt://h:x#msf:a--b": "port is not 1 to 65535", "moqt://h:#msf:a--b": "port is not 1 to 65535",
    "moqt://h:70000#msf:a--b": "port is not 1 to 65535", "moqt://h#xyz:a--b": "fragment does not begin with msf:", "moqt://h#msf:a--b--c": "more than one '--'",
    "moqt://h#msf:ab": "no '--'", "moqt://h#msf:--b": "namespace is empty", "moqt://h#msf:a--": "track name is empty", "moqt://h#msf:-a--b": "namespace element is empty",
    "moqt://h#msf:a.2--b": "bad escape in namespace", "moqt://h#msf:a--b.zz": "bad escape in track name", "moqt://h#msf:a--b!": "bad escape in track name",
    "moqt://h#msf:a--b&": "blank parameter", "moqt://h#msf:a--b&x": "parameter has no '='", "moqt://h#msf:a--b&=x": "parameter name is empty",
    "moqt://h#msf:a--b&connection=q&connection=q": "connection is repeated", "moqt://h#msf:a--b&connection=z": "connection is not q or wt",
    "moqt://h#msf:a--b&c4m=1&c4m=2": "c4m is repeated", "moqt://h#msf:a--b&wallclock-range=9-5": "bad wallclock-range", "moqt://h#msf:a--b&wallclock-range=1-2-3": "bad wallclock-range",
    "moqt://h#msf:a--b&mediatime-range=": "bad mediatime-range", "moqt://h#msf:a--b&location-range=2.5-2.4": "bad location-range", "moqt://h#msf:a--b&location-range=2.": "bad location-range",
}


def test_parse(spark):
    df = spark.createDataFrame(list(GOOD.items()), "id string, url string")
    links, rejects = parse_links(df)
    assert rejects.count() == 0
    got = {r.id: r for r in links.collect()}
    assert (got["plain"].host, got["plain"].port, got["plain"].path, got["plain"].namespace, got["plain"].track_name) == (
        "relay.example.com", 443, "/path", ["customer", "livestream", "123"], "catalog")
    assert got["escaped"].namespace == ["a-b"] and got["dot"].namespace == ["a.b"] and got["utf8"].namespace == ["é"]
    assert (got["dot"].port, got["dot"].query, got["dot"].path_explicit) == (4433, "x=1", False)
    p = got["params"]
    assert (p.connection, p.c4m_token, [tuple(e) for e in p.extra_params]) == ("wt", "tok", [("extra", "a=b")])
    assert [tuple(r) for r in p.wallclock] == [(1, 9)] and [tuple(r) for r in p.mediatime] == [(7, None)]
    assert [(tuple(r.start), tuple(r.end)) for r in p.location] == [((3, 1), (6, None))]


def test_rejects(spark):
    df = spark.createDataFrame([(u,) for u in BAD], "url string")
    links, rejects = parse_links(df)
    assert links.count() == 0
    assert {r.url: r.error for r in rejects.collect()} == BAD


def test_round_trip(spark):
    df = spark.createDataFrame(list(GOOD.items()), "id string, url string")
    links, _ = parse_links(df)
    again, rejects = parse_links(build_links(links.drop("url")).select("id", "url"))
    assert rejects.count() == 0
    assert sorted(links.drop("url").collect()) == sorted(again.drop("url").collect())
    built = {r.id: r.url for r in build_links(links.drop("url")).collect()}
    assert built["plain"] == GOOD["plain"] and built["dot"] == GOOD["dot"] and built["utf8"] == GOOD["utf8"]
    assert built["params"] == ("moqt://h/a?q=1&r=2#msf:a-b--t&connection=wt&wallclock-range=1-9&mediatime-range=7&location-range=3.1-6&extra=a=b&c4m=tok")
    loc = rows(link_ranges(links, "location", "id"), "id", "start_group", "start_object", "end_group", "end_object")
    assert loc == [("params", 3, 1, 6, None)]


def test_track_key(spark):
    df = spark.createDataFrame([(["a-b", "c"], "t"), (["a", ""], "t"), ([], "t"), (["a"], ""), (["é"], "x y")], "ns array<string>, name string")
    assert [r[0] for r in df.select(text.track_key_encode(F.col("ns"), "name")).collect()] == ["a.2db-c--t", None, None, None, ".c3.a9--x.20y"]
    flat = spark.createDataFrame([("a//b/",), ("///",), ("",)], "f string").select(text.namespace_tuple("f").alias("t"))
    assert [r.t for r in flat.collect()] == [["a", "b"], ["///"], [""]]


def test_percent(spark):
    cases = {"%name%": True, "a%b": False, "%%": False, "%a b%": False, "%a-1_%x%y%": True, "plain": True, "%a%%": False}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.ok for r in df.select("v", text.percent_ok("v").alias("ok")).collect()} == cases


def merge_by_hand(ranges):
    out = []
    for a, b in sorted(ranges, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        if out and (out[-1][1] is None or a <= out[-1][1]):
            out[-1][1] = None if out[-1][1] is None or b is None else max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_merge_ranges(spark):
    rng = random.Random(2)
    data = [(k, a := rng.randrange(60), None if rng.random() < .04 else a + rng.randrange(6)) for k in range(30) for _ in range(12)]
    df = spark.createDataFrame(data, "k bigint, start_ms bigint, end_ms bigint")
    want = sorted((k, a, b) for k in range(30) for a, b in merge_by_hand([r[1:] for r in data if r[0] == k]))
    once = merge_ranges(df, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, merge_ranges(once, ["k"]).collect()), key=str) == sorted(want, key=str)
    touching = spark.createDataFrame([(1, 0, 4), (1, 5, 9), (1, 9, 12)], "k bigint, start_ms bigint, end_ms bigint")
    assert rows(merge_ranges(touching, ["k"])) == [(1, 0, 4), (1, 5, 12)]
