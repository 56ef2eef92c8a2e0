"""Joins. Sides are left to AQE to broadcast by measured size; hot keys are split by time or group buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.text import namespace_equals
from medialake.functions.timing import idiv, location_matches
from medialake.operators.ordered import HotKeys, run_last, run_sum, running, stage

GROUP_BUCKET = 64
TIME_BUCKET_MS = 3600_000


def attach_track(frags: DataFrame, tracks: DataFrame, unmatched: str = "media", on: list[str] | None = None) -> DataFrame:
    """Track columns on fragments; unmatched rows keep the name ``media`` and zero timing, or drop out."""
    on = on or ["asset_id", "track_id"]
    extra = [c for c in tracks.columns if c not in on]
    frags = frags.drop(*extra)
    if unmatched == "drop":
        return frags.join(tracks, on)
    if unmatched != "media":
        raise ValueError(f"unknown mode {unmatched!r}")
    d = frags.join(tracks, on, "left")
    return d.withColumns({
        "track_name": F.coalesce("track_name", F.lit("media")),
        "timescale": F.coalesce("timescale", F.lit(0).cast("bigint")),
    })


def attach_init(objects: DataFrame, inits: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Playable probes: the track's init segment before each media payload; tracks without init have none."""
    on = on or ["track_name"]
    media = objects.where("kind = 'media'")
    return media.join(inits.select(*on, "init_segment"), on).withColumn("probe", F.concat("init_segment", "payload")).drop("init_segment")


def interval_join(intervals: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, width: int) -> DataFrame:
    """Pairs with ``lo <= at <= hi`` and equal keys; NULL ``hi`` is open.

    Both sides meet on (key, bucket of ``at``). The buckets that hold points are
    numbered per key and an interval is spread over the numbers between its ends,
    so it costs the buckets it meets and not the distance between them, however
    sparse the points are, and a hot key is spread over many tasks.
    """
    bounded_lo = intervals.where(F.col(lo).isNotNull()).withColumns({"__before": idiv(lo, width) - 1, "__until": idiv(hi, width)})
    placed = points.withColumn("__bucket", idiv(at, width))
    held = placed.select(*keys, "__bucket", F.lit(1).alias("__held")).where(F.col("__bucket").isNotNull()).distinct()
    ends = bounded_lo.select(*keys, F.explode(F.array("__before", "__until")).alias("__bucket"), F.lit(0).alias("__held")).where(F.col("__bucket").isNotNull()).distinct()
    marks = held.unionByName(ends).groupBy(*keys, "__bucket").agg(F.max("__held").alias("__held"))
    upto = marks.withColumns({"__n": F.sum("__held").over(Window.partitionBy(*keys).orderBy("__bucket")), "__all": F.sum("__held").over(Window.partitionBy(*keys))})
    upto = stage(upto)  # one row a bucket, read three times; what the points come from is computed once for it
    numbered = upto.where("__held = 1").select(*keys, "__n", "__bucket")
    spread = (
        bounded_lo
        .join(upto.select(*keys, F.col("__bucket").alias("__before"), F.col("__n").alias("__first"), "__all"), [*keys, "__before"])
        .join(upto.select(*keys, F.col("__bucket").alias("__until"), F.col("__n").alias("__last")), [*keys, "__until"], "left")
        .withColumn("__last", F.when(F.col(hi).isNull(), F.col("__all")).otherwise(F.col("__last")))
        .where("__first < __last")
        .withColumn("__n", F.explode(F.sequence(F.col("__first") + 1, F.col("__last"))))
        .select(*intervals.columns, "__n")
    )
    joined = spread.join(numbered, [*keys, "__n"]).drop("__n").join(placed, [*keys, "__bucket"]).drop("__bucket")
    return joined.where((F.col(at) >= F.col(lo)) & (F.col(hi).isNull() | (F.col(at) <= F.col(hi))))


def _group_ends() -> tuple[Column, Column]:
    """First and last group a subscription's filter may pass; a NULL last one is open."""
    ft = F.col("filter_type")
    return F.when(ft.isin(3, 4), F.col("start_group")).otherwise(0).cast("bigint"), F.when(ft == 4, F.col("end_group")).cast("bigint")


def receives(group: str = "group_id", obj: str = "object_id") -> Column:
    """Whether the subscription of a (subscription, object) row receives the object by its location filter."""
    low, high = _group_ends()
    within = (F.col(group) >= low) & (high.isNull() | (F.col(group) <= high))
    return within & location_matches("filter_type", "start_group", "start_object", "end_group", group, obj)


def match_subscriptions(subs: DataFrame, objects: DataFrame, on: list[str] | None = None, width: int = GROUP_BUCKET) -> DataFrame:
    """Objects each subscription receives by its location filter."""
    on = on or ["track_name"]
    low, high = _group_ends()
    wanted = subs.withColumns({"__lo": low, "__hi": high})
    pairs = interval_join(wanted, objects, on, "__lo", "__hi", "group_id", width).drop("__lo", "__hi")
    return pairs.where(location_matches("filter_type", "start_group", "start_object", "end_group", "group_id", "object_id"))


def location_totals(subs: DataFrame, points: DataFrame, names: list[str], on: list[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """``request_id`` and the sums of the columns ``names`` over the points that each subscription's filter passes.

    A filter passes what lies between two locations of its track, so its sum is the
    difference of two running sums: points and the ends of all filters are put in one
    order, and no (subscription, point) row is made. Subscriptions that pass nothing
    have sums of 0 or no row.
    """
    on = on or ["track_name"]
    ft, low, high = F.col("filter_type"), F.lit(-(1 << 63)).cast("bigint"), F.lit((1 << 63) - 1)
    located, closed = F.coalesce(ft.isin(3, 4), F.lit(False)), F.coalesce(ft == 4, F.lit(False))
    known = F.coalesce(~located | (F.col("start_group").isNotNull() & (~closed | (F.col("start_group") <= F.col("end_group")))), F.lit(False))
    named = [F.col(k).isNotNull() for k in on]
    start = F.struct(F.col("start_group").cast("bigint").alias("__g"), F.coalesce(F.col("start_object").cast("bigint"), high).alias("__o"),
                     F.when(F.col("start_object").isNull(), 2).otherwise(0).alias("__side"), F.lit(-1).alias("__sign"))
    until = F.struct(F.when(closed, F.col("end_group").cast("bigint")).otherwise(high).alias("__g"), high.alias("__o"), F.lit(2).alias("__side"), F.lit(1).alias("__sign"))
    ends = subs.where(reduce(lambda x, y: x & y, named, known)).select(*on, "request_id", F.inline(F.array_compact(F.array(until, F.when(located, start)))))
    where = [F.coalesce(F.col(c).cast("bigint"), low).alias(a) for c, a in (("group_id", "__g"), ("object_id", "__o"))]
    sums = points.where(reduce(lambda x, y: x & y, named)).groupBy(*on, *where).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    both = sums.withColumn("__side", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    zero = F.lit(0).cast("bigint")
    d = running(both, on, ["__g", "__o", "__side"], [run_sum(f"__upto_{n}", F.coalesce(F.col(n), zero)) for n in names], hot=hot)
    return d.where("__side <> 1").groupBy("request_id").agg(*[F.sum(F.col("__sign") * F.col(f"__upto_{n}")).alias(n) for n in names])


def served_totals(subs: DataFrame, objects: DataFrame, on: list[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """``request_id, objects, streams``: what each subscription is served, counted without pairs.

    A (group, subgroup) is served iff its last object is.
    """
    on = on or ["track_name"]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    heads = objects.groupBy(*on, "group_id", "subgroup_id").agg(F.max("object_id").alias("object_id"), F.count(F.lit(1)).alias("__n"))
    points = objects.select(*on, "group_id", "object_id", one.alias("objects"), zero.alias("streams")).unionByName(
        heads.select(*on, "group_id", "object_id", zero.alias("objects"), one.alias("streams")))
    return location_totals(subs, points, ["objects", "streams"], on, hot)


def unmatched_subscriptions(subs: DataFrame, objects: DataFrame, on: list[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Subscriptions without any matching object, which complete at once."""
    on = on or ["track_name"]
    # the last object of a group decides whether a filter passes any of it
    heads = objects.groupBy(*on, "group_id").agg(F.max("object_id").alias("object_id")).withColumn("__n", F.lit(1).cast("bigint"))
    hit = location_totals(subs, heads, ["__n"], on, hot).where("__n > 0").select("request_id")
    return subs.join(hit, ["request_id"], "left_anti")


def enrich_drm(protections: DataFrame, drm_cfg: DataFrame) -> DataFrame:
    """Overwrite URLs and robustness with the configured ones of the same system.

    A URL and its type change together; a system configured twice uses its first
    row by ``position``, or the least one where there is no position.
    """
    fields = ["la_url", "la_url_type", "cert_url", "cert_url_type", "robustness"]
    pick = F.min_by(F.struct(*fields), "position") if "position" in drm_cfg.columns else F.min(F.struct(*fields))
    cfg = drm_cfg.groupBy("system_id").agg(pick.alias("__cfg"))
    d = protections.join(cfg, ["system_id"], "left")
    leads = {"la_url_type": "la_url", "cert_url_type": "cert_url"}
    new = {}
    for c in fields:
        old = F.col(c) if c in protections.columns else F.lit(None).cast("string")
        new[c] = F.when(F.col(f"__cfg.{leads.get(c, c)}").isNotNull(), F.col(f"__cfg.{c}")).otherwise(old)
    return d.withColumns(new).drop("__cfg")


def overlay_defaults(samples: DataFrame, frag_defaults: DataFrame, init_defaults: DataFrame,
                     frag_on: list[str], init_on: list[str], precedence: str = "standard") -> DataFrame:
    """Sample value, then fragment default, then init default.

    ``precedence="init_flags"`` repeats the batch quirk in which init flags
    override the fragment's default flags.
    """
    names = ("duration", "size", "flags")

    def renamed(df: DataFrame, on: list[str], tag: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"__{tag}_{c}") for c in names])

    d = samples.join(renamed(frag_defaults, frag_on, "f"), frag_on, "left").join(renamed(init_defaults, init_on, "i"), init_on, "left")
    for c in names:
        chain = [F.col(c), F.col(f"__f_{c}"), F.col(f"__i_{c}")]
        if c == "flags" and precedence == "init_flags":
            chain[1], chain[2] = chain[2], chain[1]
        d = d.withColumn(c, F.coalesce(*chain))
    return d.drop(*[f"__{t}_{c}" for t in "fi" for c in names])


def attach_protection(tracks: DataFrame, systems: DataFrame, asset: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """Protected tracks with each DRM system of their asset, and the protected tracks that have none."""
    protected = tracks.where("is_protected")
    refs = protected.join(systems, [asset])
    violations = protected.join(systems.select(asset).distinct(), [asset], "left_anti").withColumn(
        "violation", F.lit("protected track without a DRM system"))
    return refs, violations


def admit(subs: DataFrame, tracks: DataFrame, namespace: str, alias: str = "track_alias") -> DataFrame:
    """Outcome of each subscription request: namespace mismatch, unknown track, or accepted with its alias."""
    t = tracks.select("track_name", F.col(alias).alias("__alias"))
    d = subs.join(t, ["track_name"], "left")
    same = namespace_equals("namespace", F.lit(namespace))
    outcome = F.when(~same, "namespace mismatch").when(F.col("__alias").isNull(), "track does not exist").otherwise("accepted")
    return d.withColumns({
        "outcome": outcome,
        "error_code": F.when(outcome == "track does not exist", 2),
        "accepted_alias": F.when(outcome == "accepted", F.col("__alias")),
    }).drop("__alias")


def extract_clips(objects: DataFrame, ranges: DataFrame, on: list[str], at: str, lo: str = "start_ms", hi: str = "end_ms",
                  width: int = TIME_BUCKET_MS) -> DataFrame:
    """Objects inside merged link ranges, both ends included; an open end runs on."""
    return interval_join(ranges, objects, on, lo, hi, at, width)


def extract_location_clips(objects: DataFrame, ranges: DataFrame, on: list[str], width: int = GROUP_BUCKET) -> DataFrame:
    """As :func:`extract_clips` on (group, object); a missing object opens at 0 and closes at the group's end."""
    pairs = interval_join(ranges, objects, on, "start_group", "end_group", "group_id", width)
    g, o = F.col("group_id"), F.col("object_id")
    after = (g > F.col("start_group")) | (o >= F.coalesce("start_object", F.lit(0)))
    until = F.col("end_group").isNull() | (g < F.col("end_group")) | F.col("end_object").isNull() | (o <= F.col("end_object"))
    return pairs.where(after & until)


def only_frozen_tracks(objects: DataFrame, announcements: DataFrame, freeze: DataFrame | Column, on: list[str],
                       feed: str = "feed_id", announced: str = "announce_us") -> DataFrame:
    """Objects of tracks announced no later than their feed's freeze time."""
    a = announcements
    if isinstance(freeze, Column):
        kept = a.where(F.col(announced) <= freeze)
    else:
        kept = a.join(freeze.select(feed, "freeze_us"), [feed]).where(F.col(announced) <= F.col("freeze_us"))
    return objects.join(kept.select(*on).distinct(), on, "left_semi")


def select_program(packets: DataFrame, pids: DataFrame, file: str = "file_id") -> DataFrame:
    """Null packets and packets of the program's pids."""
    listed = pids.select(file, "pid").distinct().withColumn("__listed", F.lit(True))
    return packets.join(listed, [file, "pid"], "left").where((F.col("pid") == 8191) | F.col("__listed")).drop("__listed")


def dangling_refs(tracks: DataFrame, inits: DataFrame, broadcast: str = "broadcast_id", ref: str = "init_ref", key: str = "id") -> DataFrame:
    """Tracks whose reference has no target row."""
    targets = inits.select(broadcast, F.col(key).alias(ref)).distinct()
    return tracks.where(F.col(ref).isNotNull()).join(targets, [broadcast, ref], "left_anti")


def dangling_protection_refs(tracks: DataFrame, protections: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    refs = tracks.select(broadcast, "namespace", "name", F.explode("content_protection_ref_ids").alias("ref_id"))
    return refs.join(protections.select(broadcast, "ref_id").distinct(), [broadcast, "ref_id"], "left_anti")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tie: str, span: int) -> DataFrame:
    """Latest ``value`` of ``right`` at or before each ``left`` row, by one union and a running last value."""
    r = right.select(*keys, at, F.struct(F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__side"))
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    d = running(both, keys, [at, "__side", tie], [run_last("__last", F.col("__v"))], span=span)
    return d.where("__side = 1").withColumn(value, F.col("__last")["v"]).drop("__last", "__v", "__side")
