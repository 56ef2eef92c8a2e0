"""Queries next to their SQL on inputs larger than the fixture tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF, rows
from test_oracle import QUERIES, SQL, canon

from medialake.operators import catalog, order, relate
from medialake.operators.ordered import HotKeys, bounded, by_heat
from medialake.plans.views import Views


def both(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, cur = QUERIES[name](spark, folder), con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    return canon(df.collect(), df.columns), canon(cur.fetchall(), cols)


def customers(folder, rows, nations, names="lpad(CAST(i AS VARCHAR), 9, '0')"):
    duckdb.connect().execute(f"""COPY (SELECT i AS c_custkey, 'Customer#' || {names} AS c_name, CAST(i % {nations} AS INTEGER) AS c_nationkey,
      CAST(i % 7 - 3 AS DOUBLE) AS c_acctbal, 'FURNITURE' AS c_mktsegment FROM range({rows}) t(i)) TO '{folder}/customer.parquet'""")


def test_catalog_json_in_parts(spark, folder):
    customers(folder, 22001, 1)
    got, want = both(spark, "S10_catalog_json", folder, ["customer"])
    assert len(got) == 3 and got == want


def test_catalog_json_init_entries_of_one_position(spark, folder):
    customers(folder, 3000, 2, "CAST(i % 10 AS VARCHAR) || '_' || i")
    got, want = both(spark, "S10_catalog_json", folder, ["customer"])
    assert got == want


def test_location_ranges_sql_orders_distinct_ranges(folder):
    """Two windows over tied rows may order them differently, so a range must occur once."""
    duckdb.connect().execute(f"""COPY (SELECT i AS o_orderkey, i % 50 AS o_custkey, 'O' AS o_orderstatus, DATE '1995-01-01' AS o_orderdate
      FROM range(20000) t(i)) TO '{folder}/orders.parquet'""")
    con, sql = duckdb.connect(), SQL["U5_merge_location_ranges"]
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet')")
    ranges = sql[:sql.index("m AS (")].rstrip().rstrip(",")
    assert con.execute(f"{ranges} SELECT count(*) - count(DISTINCT (link_id, s, e)) FROM o").fetchone() == (0,)


def test_location_ranges_with_ties(spark, folder):
    duckdb.connect().execute(f"""COPY (SELECT (i * 7) % 9000 AS o_orderkey, i % 4000 AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '1995-01-01' AS o_orderdate
      FROM range(30000) t(i)) TO '{folder}/orders.parquet'""")
    got, want = both(spark, "U5_merge_location_ranges", folder, ["orders"])
    assert got == want


def shuffled_records(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, empty, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["O1_send_order", "U1_plan_to_send_order"])
def test_send_order_shuffles_inputs_not_matches(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, i % 2 AS user_id,
      CASE WHEN i < 4 THEN 'signup' ELSE 'view' END AS event_type, 1.5 AS value, '' AS props FROM range(200) t(i)) TO '{folder}/events.parquet'""")
    con.execute(f"""COPY (SELECT i AS o_orderkey, i % 20 AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '1995-01-01' AS o_orderdate
      FROM range(1200) t(i)) TO '{folder}/orders.parquet'""")
    con.execute(f"""COPY (SELECT i AS p_partkey, 'Brand#1' AS p_brand, 'LARGE' AS p_type, 5 AS p_size, 900.0 AS p_retailprice
      FROM range(8) t(i)) TO '{folder}/part.parquet'""")
    before = shuffled_records(spark)
    got, want = both(spark, name, folder, ["events", "orders", "part"])
    assert got == want and len(got) > 60000
    assert shuffled_records(spark) - before < 20000


def test_subscribed_send_order_of_hot_and_ordinary_broadcasts(spark):
    v = Views(spark, SF)
    subs = v.subs.select("request_id", "track_name", "filter_type", "start_group", "start_object", "end_group")
    objects = v.objects.select("track_name", "broadcast_id", "plan_index", "group_id", "object_id", "media_time_us")
    cols = ("broadcast_id", "request_id", "plan_index", "send_seq", "head_time_us", "head_index")
    want = rows(order.send_order(relate.match_subscriptions(subs, objects), hot=bounded("broadcast_id")), *cols)
    some = HotKeys(("broadcast_id",), objects.where("broadcast_id < 5").select("broadcast_id").distinct())
    for hot in (bounded("broadcast_id"), some, HotKeys(("broadcast_id",), every=True), None):
        assert rows(order.subscribed_send_order(subs, objects, hot=hot), *cols) == want
    assert rows(order.send_order(relate.match_subscriptions(subs, objects), hot=some), *cols) == want


def test_snapshots_send_no_customers_through_the_driver(spark):
    snapshots = Views(spark, SF).snapshots
    snapshots.collect()
    assert "Broadcast" not in snapshots._jdf.queryExecution().executedPlan().toString()


def test_tracks_of_a_hot_broadcast_with_few_versions_stay_plain(spark, monkeypatch):
    """A broadcast may have many rows, a track has one row a version."""
    v, seen = Views(spark, SF), []
    plain = rows(catalog.version_changes(v.snapshots, hot=bounded("broadcast_id")))
    monkeypatch.setattr(catalog, "by_heat", lambda df, hot, step: (seen.append(hot), by_heat(df, hot, step))[1])
    every = HotKeys(("broadcast_id",), v.snapshots.select("broadcast_id").distinct())
    assert rows(catalog.version_changes(v.snapshots, hot=every)) == plain
    assert len(seen) == 1 and seen[0].rows is None and not seen[0].every
