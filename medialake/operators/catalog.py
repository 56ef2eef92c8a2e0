"""Catalogs as flat tables: validation, comparison, change log, end of broadcast, JSON documents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.functions.text import is_uuid, percent_ok
from medialake.functions.timing import idiv
from medialake.operators.ordered import (
    HotKeys, by_heat, find_hot, ordered_parts, prev_row, row_index, run_last, run_max, run_sum, running, stage, with_key_totals,
)
from medialake.operators.relate import dangling_protection_refs, dangling_refs
from medialake.operators.rollup import duplicate_keys

MAX_DELTAS = 8

# Catalog track column -> JSON field, in document order.
TRACK_FIELDS = {
    "name": "name", "namespace": "namespace", "packaging": "packaging", "event_type": "eventType", "role": "role",
    "is_live": "isLive", "target_latency_ms": "targetLatency", "buffers": "buffers", "label": "label",
    "render_group": "renderGroup", "alt_group": "altGroup", "init_ref": "initRef", "depends": "depends",
    "codec": "codec", "mime_type": "mimeType", "framerate": "framerate", "timescale": "timescale",
    "bitrate": "bitrate", "avg_bitrate": "avgBitrate", "max_gop_duration_ms": "maxGopDuration",
    "max_group_duration_ms": "maxGroupDuration", "width": "width", "height": "height", "samplerate": "samplerate",
    "channel_config": "channelConfig", "lang": "lang", "track_duration_ms": "trackDuration",
    "max_grp_sap_starting_type": "maxGrpSapStartingType", "max_obj_sap_starting_type": "maxObjSapStartingType",
    "content_protection_ref_ids": "contentProtectionRefIDs",
}
# Field names of the catalog format that producers may not redefine.
RESERVED_FIELDS = (
    "name", "namespace", "packaging", "eventType", "role", "isLive", "targetLatency", "buffers", "label",
    "renderGroup", "altGroup", "initRef", "depends", "codec", "mimeType", "framerate", "timescale", "bitrate",
    "avgBitrate", "maxGopDuration", "maxGroupDuration", "width", "height", "samplerate", "channelConfig", "lang",
    "trackDuration", "maxGrpSapStartingType", "maxObjSapStartingType", "temporalId", "spatialId", "displayWidth",
    "displayHeight", "parentName", "parentNamespace", "template", "authInfo", "accessibility", "encryptionScheme",
    "cipherSuite", "keyId", "trackBaseKey", "connectionUri", "token", "contentProtectionRefIDs",
)
_TYPES = {
    "is_live": T.BooleanType(), "framerate": T.DoubleType(), "depends": T.ArrayType(T.StringType()),
    "content_protection_ref_ids": T.ArrayType(T.StringType()), "custom_fields": T.MapType(T.StringType(), T.StringType()),
    "buffers": T.StructType([T.StructField(n, T.LongType()) for n in ("target", "min", "max")]),
}
_TEXT = ("name", "namespace", "packaging", "event_type", "role", "label", "init_ref", "codec", "mime_type", "channel_config", "lang")


@dataclass(frozen=True)
class Catalog:
    """The tables of a set of catalogs, each keyed by ``broadcast_id`` and ordered by ``position``."""

    tracks: DataFrame
    header: DataFrame | None = None
    publish_tracks: DataFrame | None = None
    inits: DataFrame | None = None
    protections: DataFrame | None = None
    deltas: DataFrame | None = None


def complete_tracks(df: DataFrame) -> DataFrame:
    """Add the catalog track columns that are not there as NULL."""
    for name in [*TRACK_FIELDS, "custom_fields"]:
        if name not in df.columns:
            kind = _TYPES.get(name, T.StringType() if name in _TEXT else T.LongType())
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _comparable(df: DataFrame, skip: set[str]) -> list[Column]:
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f.name)
        out.append((F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c).alias(f.name))
    return out


def _track_violation_rules(df: DataFrame) -> list[Column]:
    media = F.col("role").isin("audio", "video")
    event_track = F.col("packaging") == "eventtimeline"
    custom = F.coalesce("custom_fields", F.create_map().cast(T.MapType(T.StringType(), T.StringType())))
    rules = {
        "name is empty": F.coalesce(F.col("name"), F.lit("")) == "",
        "packaging is empty": F.coalesce(F.col("packaging"), F.lit("")) == "",
        "bitrate is missing": media & F.col("bitrate").isNull(),
        "eventType is missing": event_track & F.col("event_type").isNull(),
        "eventType is not allowed": ~event_track & F.col("event_type").isNotNull(),
        "trackDuration on a live track": F.col("is_live") & F.col("track_duration_ms").isNotNull(),
        "audio needs samplerate and channelConfig":
            (F.col("role") == "audio") & (F.col("samplerate").isNull() | F.col("channel_config").isNull()),
        "targetLatency and buffers": F.col("target_latency_ms").isNotNull() & F.col("buffers").isNotNull(),
        "custom field name is reserved": F.exists(F.map_keys(custom), lambda k: k.isin(*RESERVED_FIELDS)),
        "custom field is empty": F.exists(F.map_values(custom), lambda v: v.isNull() | (v == "")),
    }
    for name in _TEXT:
        rules[f"stray percent in {TRACK_FIELDS[name]}"] = ~percent_ok(name)
    for name in ("depends", "content_protection_ref_ids"):
        rules[f"stray percent in {TRACK_FIELDS[name]}"] = F.exists(F.coalesce(name, F.array().cast("array<string>")), lambda e: ~percent_ok(e))
    return [F.when(F.coalesce(test, F.lit(False)), rule) for rule, test in rules.items()]


def validate_tracks(tracks: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    """Row rules of one catalog track list: (broadcast, track, rule) rows."""
    d = complete_tracks(tracks)
    rules = F.array_compact(F.array(*_track_violation_rules(d)))
    return d.select(broadcast, F.col("name").alias("track"), F.explode(rules).alias("rule"))


def validate_protections(protections: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    kids = F.coalesce("default_kids", F.array().cast("array<string>"))
    rules = {
        "stray percent in refID": ~percent_ok("ref_id"),
        "scheme is not cenc or cbcs": ~F.coalesce(F.col("scheme").isin("cenc", "cbcs"), F.lit(False)),
        "defaultKID is missing": F.size(kids) == 0,
        "defaultKID is not a UUID": F.exists(kids, lambda k: ~is_uuid(k)),
        "systemID is not a UUID": ~is_uuid("system_id"),
    }
    for name, field in (("robustness", "robustness"), ("la_url_type", "laURL.type"), ("cert_url_type", "certURL.type")):
        if name in protections.columns:
            rules[f"stray percent in {field}"] = ~percent_ok(name)
    fired = F.array_compact(F.array(*[F.when(t, r) for r, t in rules.items()]))
    return protections.select(broadcast, F.col("ref_id").alias("track"), F.explode(fired).alias("rule"))


def validate_deltas(deltas: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    """``deltas``: one row per operation with its ``tracks`` names."""
    rules = [
        F.when(~F.coalesce(F.col("op").isin("add", "remove"), F.lit(False)), "operation is not add or remove"),
        F.when(F.coalesce(F.size("tracks"), F.lit(0)) <= 0, "operation has no tracks"),
    ]
    return deltas.select(broadcast, F.col("op").alias("track"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def validate_catalog(cat: Catalog, broadcast: str = "broadcast_id") -> DataFrame:
    """All rule violations of a set of catalogs as (broadcast, track, rule) rows."""
    def tag(df: DataFrame, track: str, rule: str) -> DataFrame:
        return df.select(broadcast, F.col(track).alias("track"), F.lit(rule).alias("rule"))

    published = complete_tracks(cat.tracks)
    if cat.publish_tracks is not None:
        published = published.unionByName(complete_tracks(cat.publish_tracks), allowMissingColumns=True)
    out = validate_tracks(published, broadcast)
    named = published.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    out = out.unionByName(tag(duplicate_keys(named, [broadcast, "namespace", "name"]), "name", "duplicate track name"))
    if cat.inits is not None:
        out = out.unionByName(tag(duplicate_keys(cat.inits, [broadcast, "id"]), "id", "duplicate init id"))
        stray = F.array_compact(F.array(F.when(~percent_ok("id"), "stray percent in id"), F.when(~percent_ok("type"), "stray percent in type")))
        out = out.unionByName(cat.inits.select(broadcast, F.col("id").alias("track"), F.explode(stray).alias("rule")))
        out = out.unionByName(tag(dangling_refs(published, cat.inits, broadcast), "name", "initRef has no init data"))
    if cat.protections is not None:
        out = out.unionByName(validate_protections(cat.protections, broadcast))
        out = out.unionByName(tag(duplicate_keys(cat.protections, [broadcast, "ref_id"]), "ref_id", "duplicate protection refID"))
        out = out.unionByName(tag(dangling_protection_refs(published, cat.protections, broadcast), "name", "protection reference has no entry"))
    if cat.header is not None and "version" in cat.header.columns:
        out = out.unionByName(tag(cat.header.where(~percent_ok("version")), "version", "stray percent in version"))
    if cat.deltas is not None:
        out = out.unionByName(validate_deltas(cat.deltas, broadcast))
    return out


def _keyed(df: DataFrame, keys: list[str], skip: set[str], tag: str) -> DataFrame:
    """One row per key: the first by position, as a comparable struct."""
    body = F.struct(*_comparable(df, {*keys, *skip})).alias("__b")
    order = [c for c in ("position",) if c in df.columns]
    d = df.withColumn("namespace", F.coalesce("namespace", F.lit(""))).select(*keys, *order, body)
    pick = F.min_by("__b", order[0] if order else F.to_json("__b"))
    return d.groupBy(*keys).agg(pick.alias(tag))


def catalog_diff(before: DataFrame, after: DataFrame, broadcast: str = "broadcast_id", keys: list[str] | None = None) -> DataFrame:
    """add / remove / changed / same per (broadcast, namespace, name), comparing every other column."""
    keys = keys or [broadcast, "namespace", "name"]
    b, a = _keyed(before, keys, {"position"}, "__before"), _keyed(after, keys, {"position"}, "__after")
    change = (
        F.when(F.col("__before").isNull(), "add").when(F.col("__after").isNull(), "remove")
        .when(F.col("__before").eqNullSafe(F.col("__after")), "same").otherwise("changed")
    )
    return b.join(a, keys, "full").select(*keys, change.alias("change"))


def _positions(df: DataFrame | None, broadcast: str, order: str) -> DataFrame | None:
    if df is None:
        return None
    d = row_index(df, [broadcast], [order], "__pos")
    return d.select(broadcast, "__pos", F.struct(*_comparable(df, {broadcast, order})).alias("__row"))


def catalogs_equal(a: Catalog, b: Catalog, broadcast: str = "broadcast_id", order: str = "position") -> DataFrame:
    """Per broadcast whether two catalogs are equal, position by position; ``generated_at_ms`` is ignored."""
    diffs = None
    for section in ("tracks", "publish_tracks", "inits", "protections"):
        left, right = _positions(getattr(a, section), broadcast, order), _positions(getattr(b, section), broadcast, order)
        if left is None and right is None:
            continue
        if left is None or right is None:
            one = left if right is None else right
            d = one.select(broadcast, F.lit(1).alias("__d"))
        else:
            j = left.withColumnRenamed("__row", "__l").join(right.withColumnRenamed("__row", "__r"), [broadcast, "__pos"], "full")
            d = j.select(broadcast, F.when(F.col("__l").eqNullSafe(F.col("__r")), 0).otherwise(1).alias("__d"))
        diffs = d if diffs is None else diffs.unionByName(d)
    if a.header is not None and b.header is not None:
        cols = [broadcast, "version", "is_complete"]
        h = a.header.select(broadcast, F.struct(*cols[1:]).alias("__l")).join(b.header.select(broadcast, F.struct(*cols[1:]).alias("__r")), [broadcast], "full")
        diffs = diffs.unionByName(h.select(broadcast, F.when(F.col("__l").eqNullSafe(F.col("__r")), 0).otherwise(1).alias("__d")))
    return diffs.groupBy(broadcast).agg((F.max("__d") == 0).alias("equal"))


# ---------------------------------------------------------------- change log

def _versions(snapshots: DataFrame, versions: DataFrame | None, broadcast: str, hot: HotKeys) -> DataFrame:
    """One row per version with its ordinal, its broadcast's last ordinal and the change flags."""
    flags = ("other_changed", "header_changed", "ended")
    source = snapshots if versions is None else versions
    given = [c for c in flags if versions is not None and c in versions.columns]
    v = source.select(broadcast, "version_seq", *given).distinct()
    v = v.withColumns({c: F.lit(False) for c in flags if c not in given})
    v = row_index(v, [broadcast], ["version_seq"], "version_no", hot=hot)
    # one row a version, read several times; what the snapshots come from is computed once for it
    return stage(with_key_totals(v, [broadcast], {"last_no": F.max("version_no")}, hot))


def _track_events(snapshots: DataFrame, versions: DataFrame, broadcast: str, hot: HotKeys) -> DataFrame:
    key = [broadcast, "namespace", "name"]
    s = snapshots.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    body = F.struct(*_comparable(s, {*key, "version_seq", "position"})).alias("__b")
    d = s.join(versions.select(broadcast, "version_seq", "version_no", "last_no"), [broadcast, "version_seq"])
    d = d.select(*key, "version_no", "last_no", body)

    def neighbours(part: DataFrame, heat: HotKeys) -> DataFrame:
        before = prev_row("__prev", F.struct(F.col("version_no").alias("n"), F.col("__b").alias("b")))
        p = running(part, key, ["version_no"], [before], hot=heat)
        return running(p, key, ["version_no"], [prev_row("__next_no", F.col("version_no"))], reverse=True, hot=heat)

    d = by_heat(d, hot, neighbours)
    contiguous = F.col("__prev").isNotNull() & (F.col("__prev.n") == F.col("version_no") - 1)
    here = (
        F.when(contiguous & ~F.col("__prev.b").eqNullSafe(F.col("__b")), "change")
        .when(~contiguous & (F.col("version_no") > 0), "add")
    )
    leaves = (F.col("version_no") < F.col("last_no")) & (F.col("__next_no").isNull() | (F.col("__next_no") > F.col("version_no") + 1))
    events = F.array_compact(F.array(
        F.when(here.isNotNull(), F.struct(F.col("version_no").alias("version_no"), here.alias("op"))),
        F.when(leaves, F.struct((F.col("version_no") + 1).alias("version_no"), F.lit("remove").alias("op")))))
    return d.select(*key, F.explode(events).alias("e")).select(*key, "e.version_no", "e.op")


def version_changes(snapshots: DataFrame, versions: DataFrame | None = None, broadcast: str = "broadcast_id",
                    hot: HotKeys | None = None) -> DataFrame:
    """Track-level changes of each version against the one before: (broadcast, version_seq, namespace, name, op).

    ``op`` is add, remove or change. A track's rows are compared with that
    track's own previous row, so neither a self-join of whole snapshots nor a
    list of a snapshot's tracks is needed.
    """
    hot = hot or find_hot(snapshots, [broadcast])
    v = _versions(snapshots, versions, broadcast, hot)
    # a track has at most one row a version, so versions say which keys are hot
    rows = _track_events(snapshots, v, broadcast, find_hot(v, [broadcast]))
    return rows.join(v.select(broadcast, "version_no", "version_seq"), [broadcast, "version_no"]).drop("version_no")


def catalog_log(snapshots: DataFrame, max_deltas: int = MAX_DELTAS, versions: DataFrame | None = None,
                broadcast: str = "broadcast_id", hot: HotKeys | None = None) -> DataFrame:
    """Published catalog objects of each broadcast: (version_seq, kind, group_id, object_id, added, removed).

    ``versions`` (optional) lists every version with flags: ``other_changed``
    (init data, publish tracks or protections differ), ``header_changed``
    (version or completeness differs), ``ended`` (the broadcast ended here).

    The bound on deltas needs no sequential fold: after an independent object
    forced by content, the p-th emitted version is independent again exactly
    when p is a multiple of ``max_deltas + 1``.
    """
    hot = hot or find_hot(snapshots, [broadcast])
    v = _versions(snapshots, versions, broadcast, hot)
    hot = find_hot(v, [broadcast])  # a track has at most one row a version
    key = [broadcast, "version_no"]

    def count_of(op: str) -> Column:
        return F.sum(F.when(F.col("op") == op, 1).otherwise(0)).cast("bigint")

    per = _track_events(snapshots, v, broadcast, hot).groupBy(*key).agg(
        count_of("add").alias("added"), count_of("remove").alias("removed"), count_of("change").alias("__changed"))
    d = v.join(per, key, "left").na.fill(0, ["added", "removed", "__changed"])
    moved = (F.col("added") + F.col("removed")) > 0
    first, changed = F.col("version_no") == 0, F.col("__changed") > 0
    emitted = first | moved | changed | F.col("other_changed") | F.col("header_changed") | F.col("ended")
    forced = first | changed | F.col("other_changed") | ~moved | F.col("ended")
    independent = F.col("object_id") == 0
    by, seq = [broadcast], ["version_seq"]

    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0).cast("bigint")

    def number(part: DataFrame, heat: HotKeys) -> DataFrame:
        p = running(part, by, seq, [run_max("__over", flag(F.col("ended")), exclusive=True)], hot=heat)
        p = p.where(emitted & (F.coalesce("__over", F.lit(0)) == 0))
        p = running(p, by, seq, [run_sum("__run", flag(forced))], hot=heat)
        p = row_index(p, [broadcast, "__run"], seq, "__p", hot=heat).withColumn("object_id", F.col("__p") % (max_deltas + 1))
        return running(p, by, seq, [run_sum("__ind", flag(independent))], hot=heat)

    live = by_heat(d, hot, number)
    return live.select(
        broadcast, "version_seq",
        F.when(independent, "independent").otherwise("delta").alias("kind"),
        (F.col("__ind") - 1).alias("group_id"), "object_id", F.lit(0).cast("bigint").alias("subgroup_id"),
        F.when(~independent, F.col("added")).alias("added"), F.when(~independent, F.col("removed")).alias("removed"))


def delta_operations(log: DataFrame, changes: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    """Track rows of each delta object: add before remove, by (namespace, name)."""
    deltas = log.where("kind = 'delta'").select(broadcast, "version_seq", "group_id", "object_id")
    return changes.where("op <> 'change'").join(deltas, [broadcast, "version_seq"])


def changes_after_end(versions: DataFrame, broadcast: str = "broadcast_id") -> DataFrame:
    """Versions published after the broadcast ended, as violations."""
    d = running(versions, [broadcast], ["version_seq"],
                [run_max("__over", F.when(F.col("ended"), 1).otherwise(0), exclusive=True)])
    return d.where("__over = 1").select(broadcast, "version_seq", F.lit("change after end of broadcast").alias("violation"))


def end_broadcast(cat: Catalog, durations: DataFrame, mode: str, broadcast: str = "broadcast_id") -> Catalog:
    """The catalog that ends a broadcast: ``terminate`` empties it, ``convert`` makes it on-demand.

    Conversion drops the protection list, as the original does; the tracks'
    references to it then show up as violations.
    """
    header = cat.header
    if mode == "terminate":
        return Catalog(tracks=cat.tracks.limit(0), header=None if header is None else header.select(
            broadcast, "version", F.lit(True).alias("is_complete")))
    if mode != "convert":
        raise ValueError(f"unknown mode {mode!r}")
    known = durations.select(*[c for c in (broadcast, "name") if c in durations.columns], F.col("duration_ms").alias("__ms"))
    on = [c for c in (broadcast, "name") if c in known.columns]
    tracks = cat.tracks.join(known, on, "left").withColumns({
        "is_live": F.lit(False),
        "track_duration_ms": F.coalesce("__ms", "track_duration_ms"),
    }).drop("__ms")
    if header is not None and "generated_at_ms" in header.columns:
        header = header.drop("generated_at_ms", "is_complete").withColumn("is_complete", F.lit(None).cast("boolean"))
    pub = None if cat.publish_tracks is None else cat.publish_tracks.withColumn("is_live", F.lit(False))
    return replace(cat, tracks=tracks, header=header, publish_tracks=pub, protections=None, deltas=None)


def force_independent(log: DataFrame, requests: DataFrame, broadcast: str = "broadcast_id") -> tuple[DataFrame, DataFrame]:
    """Re-publish the last catalog as an independent object in the next group.

    ``requests``: (broadcast, request_seq) in version order, and ``log`` may hold
    an ``ended`` column. Requests before any catalog give nothing; requests after
    the end are errors.
    """
    ended = F.col("ended") if "ended" in log.columns else F.lit(False)
    logged = log.select(broadcast, F.col("version_seq").alias("__at"), "group_id", ended.alias("__ended"), F.lit(0).alias("__side"))
    asked = requests.select(broadcast, F.col("request_seq").alias("__at"), F.lit(1).alias("__side"))
    both = logged.unionByName(asked, allowMissingColumns=True)
    d = running(both, [broadcast], ["__at", "__side"], [
        run_last("version_seq", F.when(F.col("__side") == 0, F.col("__at"))),
        run_last("__group", F.col("group_id")),
        run_max("__over", F.when(F.col("__ended"), 1).otherwise(0)),
        run_sum("__asked", F.col("__side").cast("bigint")),
    ]).where("__side = 1")
    errors = d.where("__over = 1").select(broadcast, F.col("__at").alias("request_seq"), F.lit("broadcast has ended").alias("violation"))
    ok = d.where("__over = 0 AND version_seq IS NOT NULL")
    out = ok.select(broadcast, F.col("__at").alias("request_seq"), "version_seq", F.lit("independent").alias("kind"),
                    (F.col("__group") + F.col("__asked")).alias("group_id"),
                    F.lit(0).cast("bigint").alias("object_id"))
    return out, errors


def retained_catalog(objects: DataFrame, broadcast: str = "broadcast_id", seq: str = "arrival_seq") -> DataFrame:
    """Latest catalog object per broadcast."""
    cols = [c for c in objects.columns if c != broadcast]
    return objects.groupBy(broadcast).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(broadcast, "r.*")


# ---------------------------------------------------------------- JSON

def track_struct() -> Column:
    """One catalog track as a struct in JSON field names; NULL fields are left out by ``to_json``."""
    depends = F.when(F.size("depends") > 0, F.col("depends"))
    refs = F.when(F.size("content_protection_ref_ids") > 0, F.col("content_protection_ref_ids"))
    rate = F.col("framerate")
    whole = F.abs(rate - F.round(rate)) < 0.0005
    shown = F.when(whole, F.round(rate).cast("bigint").cast("string")).otherwise(F.format_string("%.3f", rate))
    special = {"depends": depends, "content_protection_ref_ids": refs, "framerate": F.when(rate.isNotNull(), shown)}
    return F.struct(*[special.get(c, F.col(c)).alias(f) for c, f in TRACK_FIELDS.items()])


def track_json() -> Column:
    """Track as JSON text with the producer's raw custom fields before the protection references."""
    base = F.regexp_replace(F.to_json(track_struct()), '"framerate":"([-0-9.]+)"', '"framerate":$1')
    custom = F.array_join(F.transform(F.array_sort(F.map_entries("custom_fields")),
                                      lambda e: F.concat(F.lit(',"'), e["key"], F.lit('":'), e["value"])), "")
    refs = F.coalesce(F.when(F.size("content_protection_ref_ids") > 0, F.concat(
        F.lit(',"contentProtectionRefIDs":'), F.to_json("content_protection_ref_ids"))), F.lit(""))
    before_refs = F.substr(base, F.lit(1), F.length(base) - 1 - F.length(refs))
    return F.when(F.coalesce(custom, F.lit("")) == "", base).otherwise(F.concat(before_refs, custom, refs, F.lit("}")))


def _json_parts(df: DataFrame, item: Column, broadcast: str, order: list[str], max_items: int, name: str) -> DataFrame:
    parts = ordered_parts(df, [broadcast], order, item, max_items=max_items)
    return parts.select(broadcast, "part_index", F.array_join("items", ",").alias(name))


def catalog_json(cat: Catalog, broadcast: str = "broadcast_id", order: str = "position", max_items: int = 10000) -> DataFrame:
    """Catalog documents: (broadcast, part_index, kind, document).

    A catalog whose lists hold up to ``max_items`` entries is one independent
    document. Entries beyond follow in further documents, tracks in the format's
    own ``deltaUpdate`` form with operation ``add``, so no task gathers an
    unbounded list and nothing is left out.
    """
    key = [broadcast, "part_index"]
    t = complete_tracks(cat.tracks)
    parts = _json_parts(t, track_json(), broadcast, [order], max_items, "__tracks")
    header = cat.tracks.select(broadcast).distinct() if cat.header is None else cat.header
    d = header.withColumn("part_index", F.lit(0).cast("bigint")).join(parts, key, "full")
    listed: dict[str, Column] = {}
    for name, source in (("contentProtections", cat.protections), ("publishTracks", cat.publish_tracks), ("initDataList", cat.inits)):
        if source is None:
            continue
        by = [order]
        if name == "contentProtections":
            rows = source if order in source.columns else source.withColumn(order, F.col("ref_id").try_cast("bigint"))
            item = protection_json(source)
        elif name == "publishTracks":
            rows = complete_tracks(source)
            item = track_json()
        else:
            # entries at one position go by id
            rows, item, by = source, F.to_json(F.struct("id", "type", "data")), [order, "id"]
        d = d.join(_json_parts(rows, item, broadcast, by, max_items, f"__{name}"), key, "full")
        listed[name] = F.concat(F.lit(f'"{name}":['), F.col(f"__{name}"), F.lit("]"))
    cols = header.columns
    version = F.coalesce(F.col("version"), F.lit("1")) if "version" in cols else F.lit("1")
    head = [F.concat(F.lit('"version":"'), version, F.lit('"'))]
    if "generated_at_ms" in cols:
        head.append(F.concat(F.lit('"generatedAt":'), F.col("generated_at_ms").cast("string")))
    if "is_complete" in cols:
        head.append(F.when(F.col("is_complete"), '"isComplete":true'))
    protections = listed.pop("contentProtections", F.lit(None).cast("string"))
    track_list = F.concat(F.lit('"tracks":['), F.coalesce("__tracks", F.lit("")), F.lit("]"))
    added = F.concat(F.lit('"deltaUpdate":[{"op":"add","tracks":['), F.col("__tracks"), F.lit("]}]"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *head, protections, track_list, *listed.values()), F.lit("}"))
    more = F.concat(F.lit("{"), F.concat_ws(",", protections, added, *listed.values()), F.lit("}"))
    first = F.col("part_index") == 0
    return d.select(broadcast, "part_index", F.when(first, "independent").otherwise("delta").alias("kind"),
                    F.when(first, whole).otherwise(more).alias("document"))


def protection_json(df: DataFrame) -> Column:
    def opt(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def url(prefix: str) -> Column:
        return F.when(opt(f"{prefix}_url").isNotNull(), F.struct(opt(f"{prefix}_url").alias("url"), opt(f"{prefix}_url_type").alias("type")))

    system = F.struct(F.col("system_id").alias("systemID"), url("la").alias("laURL"), url("cert").alias("certURL"),
                      opt("pssh").alias("pssh"), opt("robustness").alias("robustness"))
    return F.to_json(F.struct(F.col("ref_id").alias("refID"), F.col("default_kids").alias("defaultKID"), "scheme", system.alias("drmSystem")))


def delta_json(operations: DataFrame, tracks: DataFrame, broadcast: str = "broadcast_id", max_items: int = 10000) -> DataFrame:
    """Delta documents of :func:`delta_operations`: add entries are whole tracks, remove entries name and namespace."""
    t = complete_tracks(tracks.withColumn("__ns", F.coalesce("namespace", F.lit(""))))
    full = t.select(broadcast, "version_seq", F.col("__ns").alias("namespace"), "name", track_json().alias("__json"))
    d = operations.join(full, [broadcast, "version_seq", "namespace", "name"], "left")
    short = F.to_json(F.struct("name", F.nullif(F.col("namespace"), F.lit("")).alias("namespace")))
    d = d.withColumn("__item", F.when(F.col("op") == "remove", short).otherwise(F.col("__json")))
    key = [broadcast, "group_id", "object_id"]
    numbered = row_index(d, [*key, "op"], ["namespace", "name"], "__pos", chunk=F.lit(0).cast("bigint"))
    parts = numbered.groupBy(*key, "op", idiv("__pos", max_items).alias("part_index")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__item"))), lambda e: e["__item"]), ",").alias("__list"))
    op = F.concat(F.lit('{"op":"'), F.col("op"), F.lit('","tracks":['), F.col("__list"), F.lit("]}"))
    ops = parts.groupBy(*key, "part_index").agg(F.sort_array(F.collect_list(F.struct("op", op.alias("__j")))).alias("__ops"))
    return ops.select(*key, "part_index", F.concat(F.lit('{"deltaUpdate":['), F.array_join(F.transform("__ops", lambda e: e["__j"]), ","), F.lit("]}")).alias("document"))
