"""Chunked running values equal plain ones, with every key hot."""

from __future__ import annotations

import random

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from medialake.operators import order, relate, rollup, sequence, sets
from medialake.operators.ordered import (
    SPAN_CONF, bounded, find_hot, ordered_parts, prev_row, row_index, run_last, run_max, run_min, run_sum, running, with_key_totals,
)
from medialake.plans.views import Views


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


@pytest.fixture
def tiny(spark):
    """A span so small that nearly every key is hot and cut into several chunks."""
    spark.conf.set(SPAN_CONF, "7")
    yield
    spark.conf.unset(SPAN_CONF)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_runs_against_python(spark, tiny, reverse, exclusive):
    rng = random.Random(5)
    data = [(k, s, rng.randrange(50), rng.choice([None, rng.randrange(9)])) for k in range(3) for s in rng.sample(range(200), 5 + 20 * k)]
    df = spark.createDataFrame(data, "k bigint, s bigint, x bigint, y bigint")
    got = running(df, ["k"], ["s"], [
        run_sum("total", F.col("x"), exclusive), run_max("top", F.col("x"), exclusive), run_min("low", F.col("x"), exclusive),
        run_last("seen", F.col("y"), exclusive), prev_row("before", F.col("y"))], reverse=reverse)
    want = []
    for k in range(3):
        part = sorted((r for r in data if r[0] == k), key=lambda r: r[1], reverse=reverse)
        for i, r in enumerate(part):
            past = part[:i] if exclusive else part[:i + 1]
            xs, ys = [p[2] for p in past], [p[3] for p in past if p[3] is not None]
            want.append((k, r[1], sum(xs), max(xs, default=None), min(xs, default=None), ys[-1] if ys else None, part[i - 1][3] if i else None))
    cols = ("k", "s", "total", "top", "low", "seen", "before")
    assert rows(got, *cols) == sorted(want, key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


def test_hot_keys_are_found_and_split(spark, tiny):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, i) for i in range(3)], "k bigint, s bigint")
    hot = find_hot(df, ["k"])
    assert rows(hot.rows) == [(1,)]
    assert find_hot(df.where("k = 2"), ["k"]).rows is None
    assert rows(row_index(df, ["k"], ["s"], "n", hot=hot).where("n <> s")) == []
    assert rows(with_key_totals(df, ["k"], {"m": F.max("s")}, hot).select("k", "m").distinct()) == [(1, 29), (2, 2)]
    with pytest.raises(ValueError):
        row_index(df, ["s"], ["k"], "n", hot=hot)


def test_parts_are_bounded_and_whole(spark, tiny):
    df = spark.createDataFrame([(1, i) for i in range(25)], "k bigint, s bigint")
    parts = ordered_parts(df, ["k"], ["s"], F.col("s"), max_items=4).orderBy("part_index").collect()
    assert [len(p["items"]) for p in parts] == [4] * 6 + [1]
    assert [v for p in parts for v in p["items"]] == list(range(25))


def test_plain_plan_has_one_shuffle_for_groups_and_numbers(spark, views):
    f = views.frags.select("feed_id", "arrival_seq", "handler_type", "is_sync", "track_name")
    plan = sequence.number_objects(sequence.assign_groups(f, hot=bounded("feed_id")), hot=bounded("feed_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_newest_rows_are_limited_before_the_shuffle(spark, views):
    plan = order.retain_newest(views.shared, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit"), plan


OPERATORS = {
    "shared_groups": (lambda v, **k: sequence.assign_shared_groups(v.shared, **k), ["session_id", "arrival_seq", "group_id", "object_id"]),
    "groups": (lambda v, **k: sequence.number_objects(sequence.assign_groups(v.frags, **k), **k), ["feed_id", "arrival_seq", "group_id", "object_id"]),
    "clock": (lambda v, **k: sequence.monotone_clock(sequence.estimate_durations(v.es, **k), **k), ["feed_id", "track_name", "arrival_seq", "duration_us", "decode_time"]),
    "end_flags": (lambda v, **k: sequence.end_flags(v.objects, **k), ["broadcast_id", "plan_index", "final_in_group", "final_in_subgroup", "contains_group_largest"]),
    "gops": (lambda v, **k: sequence.coalesce_gops(v.samples, **k), ["asset_id", "handler_type", "object_id", "sample_count", "start_time_us", "duration_us", "sap_type"]),
    "merge": (lambda v, **k: sets.merge_ranges(v.links, ["link_id"], **{"span": 86_400_000, **k}), ["link_id", "start_ms", "end_ms"]),
    "stats": (lambda v, **k: rollup.live_stats(v.objects, **k), ["broadcast_id", "bytes", "objects", "groups"]),
    "latest": (lambda v, **k: order.retain_latest_groups(v.objects, feed="broadcast_id", **k), ["broadcast_id", "plan_index"]),
}
KEYS = {"shared_groups": "session_id", "groups": "feed_id", "clock": "feed_id", "gops": "asset_id", "merge": "link_id"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_do_not_change_when_keys_are_hot(spark, name):
    fn, cols = OPERATORS[name]
    v = Views(spark, SF)
    plain = rows(fn(v, hot=bounded(KEYS.get(name, "broadcast_id"))), *cols)
    spark.conf.set(SPAN_CONF, "30")
    try:
        w = Views(spark, SF)
        source = {"session_id": w.shared, "feed_id": w.frags, "asset_id": w.samples, "link_id": w.links}.get(KEYS.get(name), w.objects)
        hot = find_hot(source, [KEYS.get(name, "broadcast_id")], 3 if name == "merge" else 30)
        assert hot.rows is not None
        assert rows(fn(w, hot=hot), *cols) == plain
    finally:
        spark.conf.unset(SPAN_CONF)


def send_by_hand(plans, subs):
    """Serve the subscription whose head object is earliest, one object at a time."""
    queues = {r: [o for o in plans if o[0] == t] for r, t in subs}
    sent, seq, last = [], 0, None
    while any(queues.values()):
        heads = {r: q[0] for r, q in queues.items() if q}
        t, p = min((o[2], o[1]) for o in heads.values())
        seq += 1
        for r, o in heads.items():
            if (o[2], o[1]) == (t, p):
                sent.append((r, o[1], seq))
                queues[r].pop(0)
    return sent


def test_send_order_against_simulation(spark):
    rng = random.Random(3)
    for _ in range(3):
        plan = [(rng.choice("abc"), i, rng.randrange(12)) for i in range(30)]
        subs = [(1, "a"), (2, "b"), (3, "c"), (4, "a")]
        o = spark.createDataFrame(plan, "track_name string, plan_index bigint, media_time_us bigint")
        s = spark.createDataFrame(subs, "request_id bigint, track_name string")
        m = o.join(s, ["track_name"]).withColumn("broadcast_id", F.lit(1).cast("bigint"))
        got = order.send_order(m, hot=bounded("broadcast_id"))
        assert rows(got, "request_id", "plan_index", "send_seq") == sorted(send_by_hand(plan, subs))


def test_interval_join_spreads_and_keeps_all(spark):
    rng = random.Random(8)
    iv = [("k", i, a := rng.randrange(100), rng.choice([None, a + rng.randrange(40)])) for i in range(40)]
    pts = [("k", i, rng.randrange(120)) for i in range(60)]
    a = spark.createDataFrame(iv, "k string, i bigint, lo bigint, hi bigint")
    b = spark.createDataFrame(pts, "k string, p bigint, at bigint")
    want = sorted((i, p) for _, i, lo, hi in iv for _, p, at in pts if at >= lo and (hi is None or at <= hi))
    assert rows(relate.interval_join(a, b, ["k"], "lo", "hi", "at", 10), "i", "p") == want


def test_interval_join_on_sparse_points(spark):
    """Points far apart cost their own buckets, not those between them."""
    rng = random.Random(9)
    step = 1_700_000_000_000
    pts = [("k", i, step * (i % 5) + rng.randrange(300)) for i in range(50)] + [("o", 99, 7)]
    iv = [("k", i, step * rng.randrange(5) + rng.randrange(200), rng.choice([None, step * rng.randrange(6)])) for i in range(30)] + [("k", 98, None, 5), ("x", 97, 0, None)]
    a = spark.createDataFrame(iv, "k string, i bigint, lo bigint, hi bigint")
    b = spark.createDataFrame(pts, "k string, p bigint, at bigint")
    want = sorted((i, p) for k, i, lo, hi in iv for q, p, at in pts if k == q and lo is not None and at >= lo and (hi is None or at <= hi))
    assert rows(relate.interval_join(a, b, ["k"], "lo", "hi", "at", 10), "i", "p") == want


def passed(sub, o):
    kind, sg, so, eg = sub
    g, n = o
    if kind not in (3, 4):
        return True
    after = g is not None and sg is not None and (g > sg or (g == sg and n is not None and so is not None and n >= so))
    return after and (kind == 3 or (eg is not None and g <= eg))


@pytest.mark.parametrize("span", [None, "3"])
def test_served_totals_are_brute_force(spark, span):
    """Objects and streams of every filter, with nulls, ties, empty ranges and a hot track, and no join of subscriptions with objects."""
    rng = random.Random(12)

    def maybe(v):
        return v if rng.random() < 0.9 else None

    objects = [(rng.choice("ab"), maybe(rng.randrange(8)), maybe(rng.randrange(4)), rng.randrange(3)) for _ in range(300)] + [(None, 1, 1, 1)]
    subs = [(i, rng.choice(["a", "b", "c", None]), maybe(rng.randrange(1, 6)), maybe(rng.randrange(9)), maybe(rng.randrange(5)), maybe(rng.randrange(9))) for i in range(120)]
    o = spark.createDataFrame(objects, "track_name string, group_id bigint, object_id bigint, subgroup_id bigint")
    s = spark.createDataFrame(subs, "request_id bigint, track_name string, filter_type bigint, start_group bigint, start_object bigint, end_group bigint")
    if span:
        spark.conf.set("spark.medialake.sequence.span", span)
    try:
        found = relate.served_totals(s, o)
        got = {r["request_id"]: (r["objects"], r["streams"]) for r in found.collect()}
        left = {r["request_id"] for r in relate.unmatched_subscriptions(s, o).collect()}
    finally:
        spark.conf.unset("spark.medialake.sequence.span")
    for i, track, *sub in subs:
        mine = [x for x in objects if track is not None and x[0] == track and passed(sub, x[1:3])]
        assert got.get(i, (0, 0))[0] == len(mine), (i, sub)
        if all(x[2] is not None for x in objects if x[0] == track and x[1] is not None and (x[1] or 0) == sub[1]):
            assert got.get(i, (0, 0))[1] == len({(x[1], x[3]) for x in mine})
        assert (i in left) == (not mine)
    if not span:
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_updates_fold_alike_as_lists_and_rows(spark):
    from medialake.operators import subscribe

    rng = random.Random(13)
    subs = [(i, rng.randrange(5), rng.randrange(3), rng.randrange(9), rng.randrange(1, 5), 1, rng.randrange(2)) for i in range(40)]
    ups = [(i, n, rng.randrange(9), rng.randrange(4), rng.randrange(9), rng.randrange(2), rng.choice([0, 0, rng.randrange(12)])) for i in range(45) for n in range(rng.randrange(12))]
    s = spark.createDataFrame(subs, "request_id bigint, start_group bigint, start_object bigint, end_group bigint, filter_type bigint, priority bigint, forward bigint")
    u = spark.createDataFrame(ups, "request_id bigint, update_seq bigint, start_group bigint, start_object bigint, priority bigint, forward bigint, end_group_plus_one bigint")
    state = {r[0]: dict(zip(("start_group", "start_object", "end_group", "filter_type", "priority", "forward"), r[1:])) for r in subs}
    want = []
    for i, n, sg, so, pr, fw, end in ups:
        if i not in state:
            want.append((i, n, False, None, None))
            continue
        state[i], ok = subscribe.apply_update(state[i], {"start_group": sg, "start_object": so, "priority": pr, "forward": fw, "end_group_plus_one": end})
        want.append((i, n, ok, state[i]["start_group"], state[i]["filter_type"]))
    for limit in (1000, 5, 0):
        got = subscribe.update_outcomes(s, u, limit)
        assert rows(got, "request_id", "update_seq", "accepted", "start_group", "filter_type") == sorted(want)
    plan = subscribe.update_outcomes(s, u)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stream_demand_of_long_intervals(spark, folder):
    """Intervals of years beside intervals of seconds: an interval lies in three buckets at most."""
    from medialake.streaming import streams

    year = 365 * 86_400_000_000
    iv = [("a", 0, 30 * year), ("a", 40 * year, 40 * year + 5), ("b", 7, None), ("b", 3, 4), ("c", year, year)]
    pts = [(t, i, at) for i, (t, at) in enumerate([("a", 0), ("a", 29 * year), ("a", 30 * year), ("a", 40 * year + 4), ("a", 40 * year + 5), ("b", 3), ("b", 4), ("b", 7), ("b", 99 * year), ("c", year)])]
    i = spark.createDataFrame(iv, "track_name string, subscribe_us bigint, unsubscribe_us bigint")
    spark.createDataFrame(pts, "track_name string, plan_index bigint, media_time_us bigint").write.parquet(folder + "/in")
    src = spark.readStream.schema("track_name string, plan_index bigint, media_time_us bigint").parquet(folder + "/in")
    q = streams.stream_demand(src, i).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert rows(spark.read.parquet(folder + "/out"), "plan_index") == [(0,), (1,), (3,), (5,), (7,), (8,)]
