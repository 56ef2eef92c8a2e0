"""Send order, latest-first selections and first-of picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.timing import idiv
from medialake.operators.ordered import HotKeys, by_heat, find_hot, run_count, run_max, running, seq_span, split_hot, stage, with_key_totals
from medialake.operators.relate import match_subscriptions, receives

VIDEO_STREAM_TYPES = (0x1B, 0x24, 0x02)
AUDIO_STREAM_TYPES = (0x0F, 0x11, 0x03, 0x04)
QUEUE_DEPTH = 128
TIME_SPAN_US = 600_000_000
PAIRS = 1 << 21


def send_order(matched: DataFrame, broadcast: str = "broadcast_id", request: str = "request_id",
               time: str = "media_time_us", seq: str = "plan_index", cycle: str | None = None,
               hot: HotKeys | None = None, **kw) -> DataFrame:
    """Merge of the subscriptions' queues by head time.

    A queue keeps plan order, so a row's place is the running maximum of
    (time, plan index) within its subscription and cycle. Subscriptions at the
    same head share a ``send_seq``. The rows of an ordinary broadcast are
    shuffled once and ordered in one task; in a hot one ranks are given to its
    distinct places, so they cost these, whether it has one subscriber or a million.
    """
    d = matched if cycle else matched.withColumn("__cycle", F.lit(0).cast("bigint"))
    cyc = cycle or "__cycle"
    place = [cyc, "__t", "__p", seq]
    head = run_max("__head", F.struct(F.col(time).alias("t"), F.col(seq).alias("p")))

    def ranked(part: DataFrame, heat: HotKeys) -> DataFrame:
        p = part if heat.every else part.repartition(broadcast)
        p = running(p, [broadcast, request, cyc], [seq], [head], hot=heat, **kw)
        p = p.withColumns({"__t": F.col("__head.t"), "__p": F.col("__head.p")}).drop("__head")
        return _rank_places(p, broadcast, place) if heat.every else _dense_rank(p, broadcast, place)

    d = by_heat(d, hot or find_hot(matched, [broadcast]), ranked)
    return d.withColumns({"head_time_us": F.col("__t"), "head_index": F.col("__p")}).drop("__t", "__p", "__cycle")


def _dense_rank(d: DataFrame, broadcast: str, place: list[str]) -> DataFrame:
    return d.withColumn("send_seq", F.dense_rank().over(Window.partitionBy(broadcast).orderBy(*place)).cast("bigint"))


def _rank_places(d: DataFrame, broadcast: str, place: list[str]) -> DataFrame:
    # a place is one object at one head, however many subscriptions stand at it; ranks are given to places
    chunk = F.struct(F.col(place[0]).alias("c"), idiv("__t", TIME_SPAN_US).alias("b"))
    places = d.select(broadcast, *place).distinct()
    ranked = running(places, [broadcast], place, [run_count("send_seq")], chunk=chunk, hot=HotKeys((broadcast,), every=True))
    ranked = ranked.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate([broadcast, *place])], "send_seq")
    same = [F.col(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate([broadcast, *place])]
    return d.join(ranked, same).drop(*[f"__r{i}" for i in range(5)])


def subscribed_send_order(subs: DataFrame, objects: DataFrame, broadcast: str = "broadcast_id", request: str = "request_id",
                          time: str = "media_time_us", seq: str = "plan_index", on: list[str] | None = None,
                          hot: HotKeys | None = None) -> DataFrame:
    """:func:`send_order` of the matches of ``subs`` and ``objects``, without shuffling the matches.

    Subscriptions and objects of a broadcast meet in one task, which makes its
    matches and orders them: what is shuffled grows with the inputs, not with
    their matches. Tasks are as many as keep each at about ``PAIRS`` pairs; a
    broadcast with more pairs than one task should order is matched by buckets.
    ``hot`` lists these broadcasts.
    """
    on = on or ["track_name"]
    objects = stage(objects)  # read for its tracks, their sizes and the matches
    tracks = objects.groupBy(*on, broadcast).agg(F.count(F.lit(1)).alias("__n"))
    wanted = subs.join(tracks.select(*on, broadcast), on)
    if hot is None or not hot.every:
        pairs = F.sum("__n") * F.sum("__m")
        sizes = tracks.join(subs.groupBy(*on).agg(F.count(F.lit(1)).alias("__m")), on).groupBy(broadcast).agg(pairs.alias("__pairs"))
        if hot is None:
            big = sizes.where(F.col("__pairs") > seq_span(subs.sparkSession)).select(broadcast)
            hot = HotKeys((broadcast,), None if big.isEmpty() else stage(big))
        total = split_hot(sizes, hot)[0].agg(F.sum("__pairs")).first()[0] or 0

    def ordered(part: DataFrame, heat: HotKeys) -> DataFrame:
        if heat.every:
            return send_order(match_subscriptions(subs, part, on), broadcast, request, time, seq, hot=heat)
        count = 1 + int(total) // PAIRS
        asked = wanted.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([broadcast, *on])], *[c for c in subs.columns if c not in on])
        # only the broadcast is a join key, so that the matches stay where they are made: tracks are compared by order, which is no key
        same = [(F.col(c) >= F.col(f"__k{i}")) & (F.col(c) <= F.col(f"__k{i}")) for i, c in enumerate(on, 1)]
        met = part.repartition(count, broadcast).join(
            asked.repartition(count, "__k0"), [F.col(broadcast) == F.col("__k0"), *same, receives("group_id", "object_id")])
        p = met.drop(*[f"__k{i}" for i in range(len(on) + 1)])
        p = running(p, [broadcast, request], [seq], [run_max("__head", F.struct(F.col(time).alias("t"), F.col(seq).alias("p")))], hot=heat)
        p = _dense_rank(p, broadcast, ["__head", seq])
        return p.withColumns({"head_time_us": F.col("__head.t"), "head_index": F.col("__head.p")}).drop("__head")

    return by_heat(objects, hot, ordered)


def next_object(subs: DataFrame, objects: DataFrame, position: str = "position", on: list[str] | None = None) -> DataFrame:
    """Smallest matching plan index at or after each subscription's position; NULL when none is left."""
    found = (
        match_subscriptions(subs, objects, on).where(F.col("plan_index") >= F.col(position))
        .groupBy("request_id").agg(F.min("plan_index").alias("next_index"))
    )
    return subs.join(found, ["request_id"], "left")


def retain_latest_groups(frags: DataFrame, n: int = 2, feed: str = "feed_id", **kw) -> DataFrame:
    """Rows of the latest ``n`` groups of each feed."""
    d = with_key_totals(frags, [feed], {"__latest": F.max("group_id")}, **kw)
    return d.where(F.col("group_id") > F.col("__latest") - n).drop("__latest")


def retain_newest(objects: DataFrame, n: int = QUEUE_DEPTH, session: str = "session_id", seq: str = "arrival_seq") -> DataFrame:
    """The newest ``n`` rows of each session by arrival.

    Spark limits each group to ``n`` rows before the shuffle (WindowGroupLimit),
    so a hot session sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(session).orderBy(F.col(seq).desc())
    return objects.withColumn("__newest", F.row_number().over(w)).where(F.col("__newest") <= max(n, 1)).drop("__newest")


def pick_program(pat: DataFrame, requested: int | None = None, file: str = "file_id") -> DataFrame:
    """First table entry that is a program (and the requested one, if any)."""
    rows = pat.where("program <> 0")
    if requested is not None:
        rows = rows.where(F.col("program") == requested)
    return rows.groupBy(file).agg(F.min_by(F.struct("program", "pmt_pid"), "position").alias("p")).select(file, "p.program", "p.pmt_pid")


def pick_streams(pmt: DataFrame, file: str = "file_id", video_pid: int | None = None, audio_pid: int | None = None) -> DataFrame:
    """First video and first sound stream of each program; a configured pid wins."""
    def first(types: tuple[int, ...]):
        hit = F.col("stream_type").isin(*types)
        return F.min_by("elementary_pid", F.when(hit, F.col("position")))

    v, a = first(VIDEO_STREAM_TYPES), first(AUDIO_STREAM_TYPES)
    return pmt.groupBy(file, "program").agg(
        (F.lit(video_pid) if video_pid is not None else v).alias("video_pid"),
        (F.lit(audio_pid) if audio_pid is not None else a).alias("audio_pid"))
