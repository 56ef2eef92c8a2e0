"""Batch forms of live decisions: track settling, codec discovery, liveness, timed re-publication, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.functions.timing import idiv
from medialake.operators.fold import fold_sorted
from medialake.operators.ordered import prev_row, run_last, run_max, run_sum, running

SETTLE_GAP_US = 500_000
DISCOVERY_WINDOW_US = 5_000_000


def settle_tracks(announcements: DataFrame, gap_us: int = SETTLE_GAP_US, feed: str = "feed_id", at: str = "announce_us",
                  tie: str = "track", first_wait_us: int | None = None, span_us: int = 86_400_000_000,
                  **kw) -> DataFrame:
    """Announcements with ``settled``: true until the first quiet gap of their feed.

    ``first_wait_us`` keeps the set open for that long after the first track.
    """
    d = running(announcements, [feed], [at, tie], [prev_row("__prev", F.col(at))], span=span_us, **kw)
    if first_wait_us:
        start = announcements.groupBy(feed).agg(F.min(at).alias("__start"))
        d = d.join(start, [feed])
        d = d.withColumn("__prev", F.greatest("__prev", F.when(F.col("__prev").isNotNull(), F.col("__start") + (first_wait_us - gap_us))))
    gap = F.when(F.col(at) - F.col("__prev") > gap_us, 1).otherwise(0).cast("bigint")
    d = running(d, [feed], [at, tie], [run_sum("__session", gap)], span=span_us, **kw)
    return d.withColumn("settled", F.col("__session") == 0).drop("__prev", "__session", "__start")


def discover_codecs(es: DataFrame, window_us: int = DISCOVERY_WINDOW_US, feed: str = "feed_id", at: str = "arrival_us",
                    role: str = "is_video", seq: str = "arrival_seq") -> tuple[DataFrame, DataFrame]:
    """First non-NULL codec parameters per (feed, role) within ``window_us`` of the feed's start, and the roles without any."""
    start = es.groupBy(feed).agg(F.min(at).alias("__start"))
    inside = es.join(start, [feed]).where(F.col(at) <= F.col("__start") + window_us)
    found = inside.groupBy(feed, role).agg(
        F.min_by("codec_params", F.when(F.col("codec_params").isNotNull(), F.col(seq))).alias("codec_params"),
        F.min(F.when(F.col("codec_params").isNotNull(), F.col(seq))).alias("found_seq"))
    removed = es.select(feed, role).distinct().join(found.where("codec_params IS NOT NULL"), [feed, role], "left_anti")
    return found.where("codec_params IS NOT NULL"), removed


def window_stats(objects: DataFrame, window_us: int, slide_us: int | None = None, by: list[str] | None = None,
                 at: str = "media_time_us") -> DataFrame:
    """Bytes and objects per tumbling or sliding window of object time."""
    by = by or ["broadcast_id"]
    slide = slide_us or window_us
    last = idiv(at, slide) * slide
    # Partial sums per slide first, so a sliding window re-sends sums and not rows.
    per_slide = objects.groupBy(*by, last.alias("__slide")).agg(F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("objects"))
    slid = F.sequence(F.col("__slide"), F.col("__slide") - (window_us - slide), F.lit(-slide).cast("bigint")) if window_us > slide else F.array("__slide")
    return per_slide.withColumn("window_start_us", F.explode(slid)).groupBy(*by, "window_start_us").agg(
        F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects"))


def republish_ticks(log: DataFrame, ticks: DataFrame, interval_ms: int, broadcast: str = "broadcast_id") -> DataFrame:
    """Ticks at which the last catalog is published again: ``interval_ms`` after the last publication of any kind.

    A re-publication restarts the interval, so the due ticks form a chain; it is
    streamed per broadcast over time-sorted rows. Interval 0 is off.
    """
    schema = f"{broadcast} bigint, tick_ms bigint, version_seq bigint"
    rows = log.select(F.col(broadcast).cast("bigint").alias(broadcast), F.col("published_ms").alias("at"), F.col("version_seq").cast("bigint").alias("version_seq"),
                      F.lit(0).alias("side")).unionByName(
        ticks.select(F.col(broadcast).cast("bigint").alias(broadcast), F.col("tick_ms").alias("at"), F.lit(-1).cast("bigint").alias("version_seq"), F.lit(1).alias("side")))

    def step(state, row):
        if row["side"] == 0:
            return (row["at"], row["version_seq"]), None
        if state is None or interval_ms <= 0 or row["at"] - state[0] < interval_ms:
            return state, None
        return (row["at"], state[1]), (row[broadcast], row["at"], state[1])

    return fold_sorted(rows, [broadcast], ["at", "side"], step, schema)


def liveness(objects: DataFrame, closes: DataFrame, ticks: DataFrame, gap_us: int, feed: str = "feed_id") -> DataFrame:
    """State at each tick: ``finished`` once closed, ``gap`` when silent longer than ``gap_us`` but open, else ``live``."""
    rows = (
        objects.select(feed, F.col("arrival_us").alias("__at"), F.lit(0).alias("__side"))
        .unionByName(closes.select(feed, F.col("close_us").alias("__at"), F.lit(1).alias("__side")))
        .unionByName(ticks.select(feed, F.col("tick_us").alias("__at"), F.lit(2).alias("__side"))).distinct()
    )
    d = running(rows, [feed], ["__at", "__side"], [
        run_last("__seen", F.when(F.col("__side") == 0, F.col("__at"))),
        run_max("__closed", F.when(F.col("__side") == 1, 1).otherwise(0)),
    ], span=86_400_000_000)
    quiet = F.col("__seen").isNull() | (F.col("__at") - F.col("__seen") > gap_us)
    state = F.when(F.col("__closed") == 1, "finished").when(quiet, "gap").otherwise("live")
    return d.where("__side = 2").select(feed, F.col("__at").alias("tick_us"), state.alias("state"))
