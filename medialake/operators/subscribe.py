"""Subscription state: updates, demand, dormant tracks, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.operators.fold import fold_sorted
from medialake.operators.ordered import HotKeys, find_hot, run_sum, running, split_hot
from medialake.operators.relate import served_totals

SUBSCRIPTION = ("start_group", "start_object", "end_group", "filter_type", "priority", "forward")
LISTED_UPDATES = 1000
_UPDATE = ("start_group", "start_object", "priority", "forward", "end_group_plus_one")
UPDATE_SCHEMA = (
    "request_id bigint, update_seq bigint, accepted boolean, start_group bigint, start_object bigint, "
    "end_group bigint, filter_type bigint, priority bigint, forward bigint"
)


def apply_update(state: dict, update: dict) -> tuple[dict, bool]:
    """One update against the current subscription: its start may not go back and a closed end may only shrink."""
    start = (int(update["start_group"]), int(update["start_object"]))
    end_plus_one = int(update["end_group_plus_one"])
    goes_back = start < (state["start_group"], state["start_object"])
    closed = state["filter_type"] == 4
    reopens = closed and (end_plus_one == 0 or end_plus_one - 1 > state["end_group"])
    if goes_back or reopens:
        return state, False
    new = dict(state, start_group=start[0], start_object=start[1], priority=int(update["priority"]), forward=int(update["forward"]))
    if end_plus_one:
        new.update(filter_type=4, end_group=end_plus_one - 1)
    elif not closed:
        new["end_group"] = 0
    return new, True


def update_outcomes(subs: DataFrame, updates: DataFrame, limit: int = LISTED_UPDATES) -> DataFrame:
    """Each update with accept/reject and the subscription after it; updates of unknown requests are rejected.

    The updates of a request are folded as a sorted list in Catalyst; a request with
    more than ``limit`` of them is streamed row by row.
    """
    base = subs.select("request_id", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in SUBSCRIPTION])
    ups = updates.select("request_id", F.col("update_seq").cast("bigint").alias("update_seq"),
                         *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in _UPDATE])
    few, many = split_hot(ups, find_hot(ups, ["request_id"], limit))
    if many is None:
        return _fold_lists(base, few)
    return _fold_lists(base, few).unionByName(_fold_rows(base.join(many.select("request_id").distinct(), "request_id", "left_semi"), many))


def _fold_lists(base: DataFrame, ups: DataFrame) -> DataFrame:
    state = ", ".join(f"{c}: bigint" for c in SUBSCRIPTION)
    outcome = f"struct<update_seq: bigint, accepted: boolean, {state}>"
    # a list holds at most the limit of updates
    listed = ups.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("update_seq", *_UPDATE))).alias("__u"))
    d = listed.join(base.withColumn("__known", F.lit(True)), "request_id", "left")

    def step(s: Column, u: Column) -> Column:
        closed, end = s["filter_type"] == 4, u["end_group_plus_one"]
        back = (u["start_group"] < s["start_group"]) | ((u["start_group"] == s["start_group"]) & (u["start_object"] < s["start_object"]))
        ok = ~(back | (closed & ((end == 0) | (end - 1 > s["end_group"]))))
        new = {
            "start_group": u["start_group"], "start_object": u["start_object"], "priority": u["priority"], "forward": u["forward"],
            "end_group": F.when(end != 0, end - 1).when(closed, s["end_group"]).otherwise(F.lit(0).cast("bigint")),
            "filter_type": F.when(end != 0, F.lit(4).cast("bigint")).otherwise(s["filter_type"]),
        }
        after = [F.when(ok, new[c]).otherwise(s[c]).alias(c) for c in SUBSCRIPTION]
        return F.struct(*after, F.concat(s["done"], F.array(F.struct(u["update_seq"].alias("update_seq"), ok.alias("accepted"), *after))).alias("done"))

    start = F.struct(*[F.col(c) for c in SUBSCRIPTION], F.expr(f"cast(array() as array<{outcome}>)").alias("done")).cast(f"struct<{state}, done: array<{outcome}>>")
    unknown = F.transform("__u", lambda u: F.struct(u["update_seq"].alias("update_seq"), F.lit(False).alias("accepted"), *[F.lit(None).cast("bigint").alias(c) for c in SUBSCRIPTION]))
    done = F.when(F.col("__known"), F.aggregate("__u", start, step, lambda s: s["done"])).otherwise(unknown)
    return d.select("request_id", F.inline(done))


def _fold_rows(base: DataFrame, ups: DataFrame) -> DataFrame:
    rows = base.withColumns({"update_seq": F.lit(-(1 << 62)), "end_group_plus_one": F.lit(0).cast("bigint")}).unionByName(ups, allowMissingColumns=True).na.fill(0)

    def step(state, row):
        if row["update_seq"] == -(1 << 62):
            return {c: int(row[c]) for c in SUBSCRIPTION}, None
        if state is None:
            return None, (row["request_id"], row["update_seq"], False, *[None] * len(SUBSCRIPTION))
        state, ok = apply_update(state, row)
        return state, (row["request_id"], row["update_seq"], ok, *[state[c] for c in SUBSCRIPTION])

    return fold_sorted(rows, ["request_id"], ["update_seq"], step, UPDATE_SCHEMA)


def fold_updates(subs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subscriptions after all accepted updates, and the rejected updates."""
    outcomes = update_outcomes(subs, updates)
    after = outcomes.where("accepted").groupBy("request_id").agg(
        F.max_by(F.struct(*SUBSCRIPTION), "update_seq").alias("__s"))
    kept = [c for c in subs.columns if c not in SUBSCRIPTION]
    state = subs.join(after, ["request_id"], "left").select(
        *kept, *[F.coalesce(F.col(f"__s.{c}"), F.col(c).cast("bigint")).alias(c) for c in SUBSCRIPTION])
    return state, outcomes.where("NOT accepted").select("request_id", "update_seq")


def demand_gate(objects: DataFrame, intervals: DataFrame, forward: bool, keys: list[str] | None = None,
                at: str = "media_time_us", seq: str = "plan_index", span_us: int = 3600_000_000) -> DataFrame:
    """Objects of tracks subscribed at the object's time (start included, end not).

    The intervals become +1/-1 steps on the object time line, so the test is one
    running sum per track and no (object, interval) pairs are formed.
    """
    if forward:
        return objects
    keys = keys or ["track_name"]
    starts = intervals.select(*keys, F.col("subscribe_us").alias("__at"), F.lit(1).alias("__step"))
    ends = intervals.where("unsubscribe_us IS NOT NULL").select(
        *keys, F.greatest("unsubscribe_us", "subscribe_us").alias("__at"), F.lit(-1).alias("__step"))
    steps = starts.unionByName(ends).groupBy(*keys, "__at").agg(F.sum("__step").alias("__step"))
    both = objects.withColumns({"__at": F.col(at), "__row": F.lit(1)}).unionByName(
        steps.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    d = running(both, keys, ["__at", "__row", seq], [run_sum("__open", F.coalesce(F.col("__step"), F.lit(0)).cast("bigint"))], span=span_us)
    return d.where("__row = 1 AND __open > 0").select(*objects.columns)


def activate_dormant(tracks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tracks accepted without forwarding become active on their first update with forward = 1."""
    first = updates.where("forward = 1").groupBy("request_id").agg(F.min("update_seq").alias("activated_by"))
    d = tracks.join(first, ["request_id"], "left")
    state = F.when(F.col("forward").cast("boolean"), "active").when(F.col("activated_by").isNotNull(), "activated").otherwise("dormant")
    return d.withColumns({
        "state": state,
        "activated_by": F.when(~F.col("forward").cast("boolean"), F.col("activated_by")),
    })


def completion(subs: DataFrame, objects: DataFrame, on: list[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Matched objects and streams of each subscription; those without a match are done at once with 0."""
    done = served_totals(subs, objects, on, hot)
    return subs.select("request_id", "track_name").join(done, ["request_id"], "left").na.fill(0, ["streams", "objects"])
