"""Column expressions for names, paths, languages, identifiers and range text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions.timing import col

# ISO 639-2 code (bibliographic and terminological forms) -> ISO 639-1 code.
LANGUAGES = {
    "ara": "ar", "ces": "cs", "chi": "zh", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl",
    "ell": "el", "eng": "en", "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el",
    "heb": "he", "hin": "hi", "hun": "hu", "ind": "id", "ita": "it", "jpn": "ja", "kor": "ko",
    "nld": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru",
    "spa": "es", "swe": "sv", "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh",
}

UUID_PATTERN = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
VARIABLE_PATTERN = "%[A-Za-z0-9_-]+%"


def escape_element(c: Column | str) -> Column:
    """Bytes outside ``[A-Za-z0-9_]`` become ``.`` and two lower-case hex digits.

    Form encoding already writes those bytes as ``%XX``, but for ``. - *`` and
    the blank; only texts that need escapes are taken apart.
    """
    form = F.url_encode(col(c))
    for plain, code in ((".", "%2E"), ("-", "%2D"), ("*", "%2A"), ("+", "%20")):
        form = F.replace(form, F.lit(plain), F.lit(code))
    pieces = F.transform(F.split(form, "%", -1), lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.lower(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))))
    return F.when(col(c).rlike("^[A-Za-z0-9_]*$"), col(c)).otherwise(F.array_join(pieces, "."))


def unescape_element(c: Column | str) -> Column:
    """Inverse of :func:`escape_element`; NULL when an escape or character is malformed."""
    plain = col(c).rlike("^[A-Za-z0-9_]+$")
    escaped = col(c).rlike("^([A-Za-z0-9_]|\\.[0-9A-Fa-f]{2})+$")
    return F.when(plain, col(c)).when(escaped, F.url_decode(F.replace(col(c), F.lit("."), F.lit("%"))))


def track_key_encode(namespace: Column, name: Column | str) -> Column:
    """``a-b--track`` text key of a namespace tuple and track name; NULL when any part is empty."""
    bad = (
        namespace.isNull()
        | (F.size(namespace) == 0)
        | F.exists(namespace, lambda e: e.isNull() | (e == ""))
        | col(name).isNull()
        | (col(name) == "")
    )
    key = F.concat(
        F.array_join(F.transform(namespace, escape_element), "-"), F.lit("--"), escape_element(name)
    )
    return F.when(~bad, key)


def namespace_tuple(flat: Column | str) -> Column:
    """Flat ``a/b`` namespace to its non-empty components; all-empty keeps the original text."""
    parts = F.filter(F.split(col(flat), "/"), lambda e: e != "")
    return F.when(F.size(parts) == 0, F.array(col(flat))).otherwise(parts)


def namespace_equals(a: Column | str, b: Column | str) -> Column:
    return namespace_tuple(a) == namespace_tuple(b)


def namespace_has_prefix(full: Column | str, prefix: Column | str, mode: str = "reference") -> Column:
    """Prefix test on namespace tuples.

    ``reference`` matches only the empty prefix and the exact tuple, as the
    original does; ``prefix`` is the ordinary leading-components test.
    """
    empty = col(prefix) == ""
    f, p = namespace_tuple(full), namespace_tuple(prefix)
    if mode == "reference":
        return empty | (f == p)
    if mode == "prefix":
        return empty | ((F.size(p) <= F.size(f)) & (F.slice(f, F.lit(1), F.size(p)) == p))
    raise ValueError(f"unknown mode {mode!r}")


def path_is_under(path: Column | str, prefix: str) -> Column:
    """``path`` equals ``prefix`` or continues it at a ``/`` boundary."""
    p = col(path)
    starts = p.startswith(prefix)
    if prefix.endswith("/"):
        return starts
    return starts & ((F.length(p) == len(prefix)) | (F.substring(p, len(prefix) + 1, 1) == "/"))


def percent_ok(c: Column | str) -> Column:
    """Every ``%`` belongs to a ``%name%`` variable; NULL passes."""
    return F.coalesce(~F.contains(F.regexp_replace(col(c), VARIABLE_PATTERN, ""), F.lit("%")), F.lit(True))


def path_slug(c: Column | str) -> Column:
    """Last path segment with every non-alphanumeric character as ``_``; empty is ``dash``."""
    last = F.substring_index(col(c), "/", -1)
    return F.when(last == "", F.lit("dash")).otherwise(F.regexp_replace(last, "[^A-Za-z0-9]", "_"))


def language_tag(c: Column | str) -> Column:
    """Three-letter language to its two-letter tag; ``und`` is empty, unknown is unchanged."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(col(c) == "und", F.lit("")).otherwise(F.coalesce(F.try_element_at(table, col(c)), col(c)))


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(UUID_PATTERN), F.lit(False))


def uuid_text(b: Column | str) -> Column:
    """16 bytes as lower-case 8-4-4-4-12 text; NULL for any other length."""
    h = F.lower(F.hex(col(b)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(F.length(h) == 32, F.concat_ws("-", *[F.substring(h, s, n) for s, n in cuts]))


def _number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def parse_time_range(c: Column | str) -> Column:
    """``start[-end]`` milliseconds to ``STRUCT<start_ms, end_ms>``; NULL when malformed."""
    parts = F.split(col(c), "-", -1)
    start, end = _number(F.get(parts, 0)), _number(F.get(parts, 1))
    single = F.size(parts) == 1
    ok = start.isNotNull() & (single | ((F.size(parts) == 2) & end.isNotNull() & (end >= start)))
    return F.when(ok, F.struct(start.alias("start_ms"), end.alias("end_ms")))


def _location(c: Column) -> tuple[Column, Column, Column]:
    parts = F.split(c, "\\.", -1)
    group, obj = _number(F.get(parts, 0)), _number(F.get(parts, 1))
    ok = group.isNotNull() & ((F.size(parts) == 1) | ((F.size(parts) == 2) & obj.isNotNull()))
    return F.coalesce(ok, F.lit(False)), group, obj


OPEN_END = 9223372036854775807


def parse_location_range(c: Column | str) -> Column:
    """``g[.o][-g[.o]]`` to ``STRUCT<start STRUCT<group, object>, end STRUCT<group, object>>``."""
    parts = F.split(col(c), "-", -1)
    ok1, g1, o1 = _location(F.get(parts, 0))
    ok2, g2, o2 = _location(F.get(parts, 1))
    single = F.size(parts) == 1
    zero, top = F.lit(0).cast("bigint"), F.lit(OPEN_END)
    ordered = (g2 > g1) | ((g2 == g1) & (F.coalesce(o2, top) >= F.coalesce(o1, zero)))
    ok = ok1 & (single | ((F.size(parts) == 2) & ok2 & ordered))
    return F.when(
        ok,
        F.struct(
            F.struct(g1.alias("group"), o1.alias("object")).alias("start"),
            F.when(~single, F.struct(g2.alias("group"), o2.alias("object"))).alias("end"),
        ),
    )


def format_time_range(r: Column) -> Column:
    return F.concat(
        r["start_ms"].cast("string"),
        F.coalesce(F.concat(F.lit("-"), r["end_ms"].cast("string")), F.lit("")),
    )


def _format_location(loc: Column) -> Column:
    return F.concat(
        loc["group"].cast("string"),
        F.coalesce(F.concat(F.lit("."), loc["object"].cast("string")), F.lit("")),
    )


def format_location_range(r: Column) -> Column:
    return F.concat(
        _format_location(r["start"]),
        F.coalesce(F.concat(F.lit("-"), _format_location(r["end"])), F.lit("")),
    )
