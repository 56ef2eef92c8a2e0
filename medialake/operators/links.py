"""Track links: URL text to typed rows and back, with Catalyst string and array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions import text
from medialake.functions.text import OPEN_END

DEFAULT_PORT = 443


def _after(c: Column, mark: str) -> Column:
    """Text after the first ``mark``; NULL without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark)))


def _before(c: Column, mark: str) -> Column:
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)


def _merge_sorted(ranges: Column, start, end, build) -> Column:
    """Merge overlapping ranges of one link, an array that is already sorted by (start, end)."""
    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = build(start(last), F.greatest(end(last), end(r)))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
        return F.when((F.size(acc) > 0) & (start(r) <= end(F.get(acc, F.size(acc) - 1))), grown).otherwise(F.concat(acc, F.array(build(start(r), end(r)))))

    empty = F.slice(F.transform(ranges, lambda r: build(start(r), end(r))), 1, 0)
    return F.when(F.size(ranges) <= 1, ranges).otherwise(F.aggregate(ranges, empty, step))


def parse_links(urls: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """URL rows to (links, rejects); rejects carry the first failed rule in ``error``."""
    u = F.col(url)
    d = urls.withColumn("__rest", F.when(F.lower(F.substring(u, 1, 7)) == "moqt://", F.substr(u, F.lit(8))))
    d = d.withColumns({"__fragment": _after(F.col("__rest"), "#"), "__front": _before(F.col("__rest"), "#")})
    d = d.withColumns({"query": F.coalesce(_after(F.col("__front"), "?"), F.lit("")), "__place": _before(F.col("__front"), "?")})
    d = d.withColumns({
        "__authority": _before(F.col("__place"), "/"),
        "path_explicit": F.contains("__place", F.lit("/")),
        "path": F.coalesce(F.concat(F.lit("/"), _after(F.col("__place"), "/")), F.lit("")),
    })
    d = d.withColumns({
        "host": _before(F.col("__authority"), ":"),
        "__port": _after(F.col("__authority"), ":"),
        "__value": F.when(F.substring("__fragment", 1, 4) == "msf:", F.substr("__fragment", F.lit(5))),
    })
    d = d.withColumns({
        "port": F.when(F.col("__port").isNull(), DEFAULT_PORT).otherwise(
            F.when(F.col("__port").rlike("^[0-9]+$"), F.col("__port").try_cast("bigint"))).cast("int"),
        "__ident": _before(F.col("__value"), "&"),
        "__params": F.coalesce(F.split(_after(F.col("__value"), "&"), "&", -1), F.array().cast("array<string>")),
    })
    # One left-to-right scan for "--" pairs: splitting on the literal does the same.
    d = d.withColumn("__sides", F.split("__ident", "--", -1))
    d = d.withColumns({
        "__ns": F.split(F.get("__sides", F.lit(0)), "-", -1),
        "__track": F.get("__sides", F.lit(1)),
    })
    d = d.withColumns({
        "namespace": F.transform("__ns", text.unescape_element),
        "track_name": text.unescape_element("__track"),
        "__pairs": F.transform("__params", lambda p: F.struct(
            F.when(F.instr(p, "=") > 0, _before(p, "=")).alias("name"), _after(p, "=").alias("value"))),
    })

    def values(name: str) -> Column:
        return F.transform(F.filter("__pairs", lambda p: p["name"] == name), lambda p: p["value"])

    d = d.withColumns({
        "__connection": values("connection"), "__c4m": values("c4m"),
        "__wall": F.transform(values("wallclock-range"), text.parse_time_range),
        "__media": F.transform(values("mediatime-range"), text.parse_time_range),
        "__loc": F.transform(values("location-range"), text.parse_location_range),
    })
    known = ("connection", "c4m", "wallclock-range", "mediatime-range", "location-range")

    def any_null(c: str) -> Column:
        return F.exists(c, lambda e: e.isNull())

    error = (
        F.when(F.col("__rest").isNull(), "scheme is not moqt")
        .when(F.col("__fragment").isNull(), "fragment is missing")
        .when(F.col("__authority") == "", "host is empty")
        .when(F.col("host") == "", "host is empty")
        .when(F.col("port").isNull() | ~F.col("port").between(1, 65535), "port is not 1 to 65535")
        .when(F.col("__value").isNull(), "fragment does not begin with msf:")
        .when(F.size("__sides") > 2, "more than one '--'")
        .when(F.size("__sides") < 2, "no '--'")
        .when(F.get("__sides", F.lit(0)) == "", "namespace is empty")
        .when(F.col("__track") == "", "track name is empty")
        .when(F.exists("__ns", lambda e: e == ""), "namespace element is empty")
        .when(any_null("namespace"), "bad escape in namespace")
        .when(F.col("track_name").isNull(), "bad escape in track name")
        .when(F.exists("__params", lambda p: p == ""), "blank parameter")
        .when(F.exists("__pairs", lambda p: p["name"].isNull()), "parameter has no '='")
        .when(F.exists("__pairs", lambda p: p["name"] == ""), "parameter name is empty")
        .when(F.size("__connection") > 1, "connection is repeated")
        .when(F.exists("__connection", lambda v: ~v.isin("q", "wt")), "connection is not q or wt")
        .when(F.size("__c4m") > 1, "c4m is repeated")
        .when(any_null("__wall"), "bad wallclock-range")
        .when(any_null("__media"), "bad mediatime-range")
        .when(any_null("__loc"), "bad location-range")
    )
    d = d.withColumn("error", error)
    top = F.lit(OPEN_END)

    def times(c: str) -> Column:
        keyed = F.array_sort(F.transform(c, lambda r: F.struct(r["start_ms"].alias("s"), F.coalesce(r["end_ms"], top).alias("e"))))
        merged = _merge_sorted(keyed, lambda r: r["s"], lambda r: r["e"], lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        return F.transform(merged, lambda r: F.struct(r["s"].alias("start_ms"), F.when(r["e"] != OPEN_END, r["e"]).alias("end_ms")))

    def places(c: str) -> Column:
        zero = F.lit(0).cast("bigint")
        keyed = F.array_sort(F.transform(c, lambda r: F.struct(
            F.struct(r["start"]["group"].alias("g"), F.coalesce(r["start"]["object"], zero).alias("o")).alias("s"),
            F.struct(F.coalesce(r["end"]["group"], top).alias("g"),
                     F.when(r["end"].isNull(), top).otherwise(F.coalesce(r["end"]["object"], top)).alias("o")).alias("e"))))
        merged = _merge_sorted(keyed, lambda r: r["s"], lambda r: r["e"], lambda s, e: F.struct(s.alias("s"), e.alias("e")))

        def closed(v: Column) -> Column:
            return F.when(v != OPEN_END, v)

        return F.transform(merged, lambda r: F.struct(
            F.struct(r["s"]["g"].alias("group"), F.when(r["s"]["o"] != 0, r["s"]["o"]).alias("object")).alias("start"),
            F.when(r["e"]["g"] != OPEN_END, F.struct(r["e"]["g"].alias("group"), closed(r["e"]["o"]).alias("object"))).alias("end")))

    fields = F.struct(
        "host", "port", "path", "path_explicit", "query", "namespace", "track_name",
        F.get("__connection", F.lit(0)).alias("connection"), F.get("__c4m", F.lit(0)).alias("c4m_token"),
        times("__wall").alias("wallclock"), times("__media").alias("mediatime"), places("__loc").alias("location"),
        F.filter("__pairs", lambda p: ~p["name"].isin(*known)).alias("extra_params"), "error")
    # The generator keeps the filter on ``error`` above the parsed columns: pushed
    # down it would repeat the whole parse tree in the predicate.
    parsed = d.select(*urls.columns, F.inline(F.array(fields)))
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select(*urls.columns, "error")


def build_links(links: DataFrame, name: str = "url") -> DataFrame:
    """Typed link rows to URL text; NULL where a host is missing, holds ``#``, or the track has no key."""
    def each(field: str, c: Column) -> Column:
        return F.array_join(F.transform(c, lambda v: F.concat(F.lit(f"&{field}="), v)), "")

    cols = links.columns

    def ranges(field: str, c: str, fmt) -> Column:
        return F.coalesce(each(field, F.transform(c, fmt)), F.lit("")) if c in cols else F.lit("")

    extras = F.coalesce(F.array_join(F.transform("extra_params", lambda p: F.concat(F.lit("&"), p["name"], F.lit("="), p["value"])), ""),
                        F.lit("")) if "extra_params" in cols else F.lit("")

    def optional(field: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"&{field}="), F.col(c))).otherwise("") if c in cols else F.lit("")

    port = F.when(F.col("port") != DEFAULT_PORT, F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise("")
    path = F.when(F.col("path_explicit"), F.col("path")).otherwise("")
    query = F.when(F.coalesce(F.col("query"), F.lit("")) != "", F.concat(F.lit("?"), F.col("query"))).otherwise("") if "query" in cols else F.lit("")
    url = F.concat(
        F.lit("moqt://"), F.col("host"), port, path, query, F.lit("#msf:"), text.track_key_encode(F.col("namespace"), "track_name"),
        optional("connection", "connection"), ranges("wallclock-range", "wallclock", text.format_time_range),
        ranges("mediatime-range", "mediatime", text.format_time_range), ranges("location-range", "location", text.format_location_range),
        extras, optional("c4m", "c4m_token"))
    bad = (F.col("host") == "") | F.contains("host", F.lit("#")) | (F.col("path_explicit") & F.contains("path", F.lit("#")))
    return links.withColumn(name, F.when(~bad, url))


def link_ranges(links: DataFrame, column: str, key: str) -> DataFrame:
    """Ranges of a parsed link column, one row each."""
    d = links.select(key, "track_name", F.explode(column).alias("r"))
    if column == "location":
        return d.select(key, "track_name", F.col("r.start.group").alias("start_group"), F.col("r.start.object").alias("start_object"),
                        F.col("r.end.group").alias("end_group"), F.col("r.end.object").alias("end_object"))
    return d.select(key, "track_name", "r.start_ms", "r.end_ms")
