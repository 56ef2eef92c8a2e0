"""MP4 files as tables: boxes, tracks, fragments, samples, protection.

One small Python step lists the top-level boxes of each file by reading headers at
their offsets, a second one walks what lies in each ``moov`` and ``moof``; media
payloads are skipped and file size does not matter.
Everything after it is DataFrame work on the box table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialake.functions.binary import be_int32, be_uint, fourcc, has_bit, slice_bytes
from medialake.functions.text import language_tag, uuid_text
from medialake.functions.timing import idiv
from medialake.operators.expand import explode_count
from medialake.operators.ordered import bounded, row_index, run_last, run_sum, running, stage
from medialake.operators.relate import overlay_defaults

# Boxes whose payload is a list of boxes.
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl", "moof", "traf", "mvex", "edts", "dinf", "meta", "sinf", "schi")
# Offset of the first child box in a sample entry, from the entry's start.
VISUAL_CHILDREN, AUDIO_CHILDREN = 86, 36
VISUAL_ENTRIES = ("avc1", "avc3", "hvc1", "hev1", "encv")
SIZED_VIDEO = ("avc1", "avc3", "hvc1", "hev1")
SIZED_AUDIO = ("mp4a", "Opus", "opus")
DEFAULT_FLAGS = 0x02000000

#: Boxes whose payload some operator reads; the bytes of all others stay in the file.
USED = ("tkhd", "hdlr", "mdhd", "stsd", "stts", "btrt", "avcC", "frma", "schm", "tenc", "tfhd", "tfdt", "trun", "trex", "pssh")
READ_AHEAD = 1 << 15
PAYLOAD_BATCH = 1 << 23
TOP_SPAN = 1 << 26  # bytes of a file whose top-level boxes one task walks

BOX_SCHEMA = (
    "path string, box_id bigint, tree string, ordinal bigint, top_ordinal bigint, branch_ordinal bigint, "
    "box_offset bigint, box_size bigint, payload_offset bigint, payload binary, error string"
)


class _Bytes:
    """Random access to bytes in memory or to a file on any file system pyarrow knows.

    Small reads of a file come from blocks of ``READ_AHEAD`` bytes, so neighbouring box headers cost one request.
    """

    def __init__(self, path: str | None = None, content: bytes | None = None):
        self.content = content
        self.block_at, self.block = 0, b""
        if content is None:
            from pyarrow import fs

            uri = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
            if uri.startswith("file:/") and not uri.startswith("file://"):
                uri = "file://" + uri[5:]
            store, key = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(key)
            self.size = self.file.size()
        else:
            self.size = len(content)

    def read(self, offset: int, length: int) -> bytes:
        if self.content is not None:
            return self.content[offset:offset + length]
        if length > READ_AHEAD:
            return self.file.read_at(length, offset)
        at = offset - self.block_at
        if at < 0 or at + length > len(self.block):
            self.block_at, self.block, at = offset, self.file.read_at(max(0, min(READ_AHEAD, self.size - offset)), offset), 0
        return self.block[at : at + length]

    def close(self) -> None:
        if self.content is None:
            self.file.close()


def walk_boxes(src, begin: int, end: int, tree: str = "", deep: bool = True) -> Iterator[tuple]:
    """(tree, ordinal in parent, offset, size, payload offset, payload or None) of all boxes, parents first; with ``deep=False`` of one level."""
    seen: dict[str, int] = {}
    at = begin
    in_entries = tree.endswith("stsd") or tree.split("/")[-2:-1] == ["stsd"]
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", src.read(at, 8))
        name, header = kind.decode("latin-1"), 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated extended-size box")
            size, header = struct.unpack(">Q", src.read(at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < header or at + size > end:
            if in_entries:  # a broken child list of a sample entry only ends the list
                return
            raise ValueError(f"invalid box size for type {name}")
        here = f"{tree}/{name}" if tree else name
        n = seen.get(name, 0)
        seen[name] = n + 1
        body = at + header
        is_entry = tree.endswith("/stsd")
        yield here, n, at, size, body, src.read(body, size - header) if name in USED and deep else None
        if not deep:
            pass
        elif name in CONTAINERS:
            yield from walk_boxes(src, body, at + size, here)
        elif name == "stsd":
            yield from walk_boxes(src, min(body + 8, at + size), at + size, here)
        elif is_entry:
            first = VISUAL_CHILDREN if name in VISUAL_ENTRIES else AUDIO_CHILDREN
            yield from walk_boxes(src, min(at + first, at + size), at + size, here)
        at += size


_NAMES = [c.strip().split(" ")[0] for c in BOX_SCHEMA.split(",")]


def _box_rows(path: str, walked: Iterator[tuple], top: int = -1, above: int = 0) -> Iterator[tuple]:
    """Rows of the box table. Ids grow with the place in the file, parents first; ``top`` is the ordinal of the box that ``walked`` lies in."""
    branch = -1
    try:
        for tree, n, at, size, body, payload in walked:
            depth = tree.count("/")
            if depth == 0:
                top, branch = n, -1
            elif depth == 1:
                branch = n
            yield path, at * 16 + depth, tree, n, top, branch, at, size, body, payload, None
    except ValueError as e:
        yield path, -1 - above, "!error", 0, 0, 0, 0, 0, 0, None, str(e)


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of at most 4,096 rows and about ``PAYLOAD_BATCH`` bytes of payload."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r[9] or b"")
        if len(some) >= 4096 or held >= PAYLOAD_BATCH:
            yield pd.DataFrame(some, columns=_NAMES)
            some, held = [], 0
    if some:
        yield pd.DataFrame(some, columns=_NAMES)


def boxes_of_files(files: DataFrame) -> DataFrame:
    """The box table of ``files``: (path) for range reads, or (path, content).

    Of files that are read by ranges, one task lists the top-level boxes, headers
    only, and each ``moov`` and ``moof`` is then walked by the task it is dealt to, so
    one large file is the work of many tasks.
    """
    if "content" in files.columns:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    src = _Bytes(row.path, row.content)
                    yield from _frames(_box_rows(row.path, walk_boxes(src, 0, src.size)))

        return files.mapInPandas(whole, BOX_SCHEMA)

    def list_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                src = _Bytes(path)
                yield from _frames(_box_rows(path, walk_boxes(src, 0, src.size, deep=False)))
                src.close()

    def go_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf
            inner = pdf[pdf["tree"].isin(CONTAINERS) & pdf["error"].isna()]
            for path, part in inner.groupby("path", sort=False):
                src = _Bytes(path)
                for r in part.sort_values("box_offset").itertuples(index=False):
                    walked = walk_boxes(src, r.payload_offset, r.box_offset + r.box_size, r.tree)
                    yield from _frames(_box_rows(path, walked, r.top_ordinal, r.box_offset))
                src.close()

    top = files.mapInPandas(list_top, BOX_SCHEMA)
    return top.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path", idiv("box_offset", TOP_SPAN)).mapInPandas(go_in, BOX_SCHEMA)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of files; the content column is pruned and never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def scan_boxes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    files = list_files(spark, path, glob).select("path")
    return boxes_of_files(files.repartition(spark.sparkContext.defaultParallelism * 4, "path"))


def _payload_of(tree: str) -> Column:
    return F.max_by("payload", F.when((F.col("tree") == tree) & (F.col("ordinal") == 0), F.lit(1)))


def file_rejects(boxes: DataFrame) -> DataFrame:
    """Files that cannot be segmented, with the reason."""
    per = boxes.groupBy("path").agg(
        F.max("error").alias("error"),
        F.sum(F.when(F.col("tree") == "moof", 1).otherwise(0)).alias("moofs"),
        F.sum(F.when(F.col("tree") == "mdat", 1).otherwise(0)).alias("mdats"),
        F.max(F.col("tree") == "ftyp").alias("has_ftyp"), F.max(F.col("tree") == "moov").alias("has_moov"))
    pair = _pairs(boxes).where("moof_offset > mdat_offset").select("path").distinct().withColumn("crossed", F.lit(True))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~(F.col("has_ftyp") & F.col("has_moov")), "ftyp or moov is missing")
        .when((F.col("moofs") > 0) & (F.col("moofs") != F.col("mdats")), "moof and mdat counts differ")
        .when(F.col("crossed"), "moof follows its mdat")
    )
    return per.join(pair, ["path"], "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def _pairs(boxes: DataFrame) -> DataFrame:
    top = boxes.where(F.col("tree").isin("moof", "mdat"))
    return top.groupBy("path", F.col("ordinal").alias("fragment_index")).agg(
        *[F.max(F.when(F.col("tree") == t, F.col(c))).alias(f"{t}_{c[4:]}") for t in ("moof", "mdat") for c in ("box_offset", "box_size")],
        F.max(F.when(F.col("tree") == "mdat", F.col("payload_offset"))).alias("mdat_payload_offset"))


def _fragment_heads(boxes: DataFrame, mode: str = "all") -> DataFrame:
    """One row for each track fragment of a fragment: header, decode time and the payloads of its runs.

    ``mode="reference"`` keeps the first run of the first track fragment alone.
    """
    if mode not in ("all", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    inside = boxes.where("tree IN ('moof/traf/tfhd', 'moof/traf/tfdt', 'moof/traf/trun')")
    if mode == "reference":
        inside = inside.where("branch_ordinal = 0")
    run = F.when((F.col("tree") == "moof/traf/trun") & ((F.col("ordinal") == 0) | (mode == "all")), F.struct(F.col("ordinal").alias("run_index"), F.col("payload").alias("trun")))
    # a track fragment is one box, so its list of runs is bounded
    return inside.groupBy("path", F.col("top_ordinal").alias("fragment_index"), F.col("branch_ordinal").alias("traf_index")).agg(
        _payload_of("moof/traf/tfhd").alias("tfhd"), _payload_of("moof/traf/tfdt").alias("tfdt"), F.collect_list(run).alias("runs"))


def _base_decode_time() -> Column:
    version = be_uint("tfdt", 0, 1)
    return F.coalesce(F.when(version == 1, be_uint("tfdt", 4, 8)).otherwise(be_uint("tfdt", 4, 4)), F.lit(0).cast("bigint"))


def fragments_of(boxes: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """(fragments, rejects): one row per track fragment of each moof+mdat pair of the accepted files; ``mode`` as for samples."""
    rejects = file_rejects(boxes)
    heads = _fragment_heads(boxes, mode).select(
        "path", "fragment_index", "traf_index", be_uint("tfhd", 4, 4).alias("track_id"), _base_decode_time().alias("base_decode_time"))
    pairs = _pairs(boxes).where("moof_offset IS NOT NULL AND mdat_offset IS NOT NULL")
    frags = pairs.join(heads, ["path", "fragment_index"], "left").join(rejects, ["path"], "left_anti")
    return frags, rejects


def scan_fragments(spark: SparkSession, path: str, glob: str | None = None, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    return fragments_of(stage(scan_boxes(spark, path, glob)), mode)


def attach_payload(rows: DataFrame, offset: str, size: str, name: str = "payload") -> DataFrame:
    """Read the bytes [offset, offset+size) of each row's ``path`` last, after all pruning.

    Null where the place or the size is null. A task holds about ``PAYLOAD_BATCH`` bytes, or one row's, at a time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, part in pdf.groupby("path", sort=False):
                src = _Bytes(path)
                part = part.sort_values(offset)
                weight = part[size].fillna(0).cumsum().floordiv(PAYLOAD_BATCH)
                for _, some in part.groupby(weight, sort=False):
                    yield some.assign(**{name: [None if pd.isna(o) or pd.isna(n) else src.read(int(o), int(n)) for o, n in zip(some[offset], some[size])]})
                src.close()

    return rows.mapInPandas(run, schema)


def inits_of(boxes: DataFrame) -> DataFrame:
    """One row per file: the places of its ``ftyp`` and ``moov`` and the size of the init segment that they make."""
    tops = boxes.where(F.col("tree").isin("ftyp", "moov") & (F.col("ordinal") == 0))
    places = tops.groupBy("path").agg(*[F.max(F.when(F.col("tree") == t, F.col(c))).alias(f"{t}_{c[4:]}") for t in ("ftyp", "moov") for c in ("box_offset", "box_size")])
    return places.where("ftyp_size IS NOT NULL AND moov_size IS NOT NULL").withColumn("init_size", F.col("ftyp_size") + F.col("moov_size"))


def scan_inits(spark: SparkSession, path: str, glob: str | None = None, name: str = "init") -> DataFrame:
    """The init segment of every file, ``ftyp`` and ``moov`` bytes one after the other; read by ranges, last."""
    places = inits_of(scan_boxes(spark, path, glob))
    both = attach_payload(attach_payload(places, "ftyp_offset", "ftyp_size", "__ftyp"), "moov_offset", "moov_size", "__moov")
    return both.select("path", "init_size", F.concat("__ftyp", "__moov").alias(name))


def tracks_of(boxes: DataFrame) -> DataFrame:
    """Track inventory from the box table: one row per accepted track."""
    base = "moov/trak"
    want = {
        "tkhd": f"{base}/tkhd", "hdlr": f"{base}/mdia/hdlr", "mdhd": f"{base}/mdia/mdhd",
        "stsd": f"{base}/mdia/minf/stbl/stsd", "stts": f"{base}/mdia/minf/stbl/stts",
    }
    entry = f"^{base}/mdia/minf/stbl/stsd/[^/]+/"

    def under(suffix: str) -> Column:
        return F.max_by("payload", F.when(F.col("tree").rlike(entry + suffix + "$") & (F.col("ordinal") == 0), F.lit(1)))

    t = boxes.where(F.col("tree").startswith(base + "/")).groupBy("path", F.col("branch_ordinal").alias("trak")).agg(
        *[_payload_of(tree).alias(n) for n, tree in want.items()],
        under("btrt").alias("btrt"), under("avcC").alias("avcC"), under("sinf/frma").alias("frma"), under("sinf/schm").alias("schm"), under("sinf/schi/tenc").alias("tenc"))
    t = t.where("stsd IS NOT NULL AND length(hdlr) >= 12")
    t = row_index(t, ["path"], ["trak"], "__n", hot=bounded("path"))

    def versioned(box: str, old: int, new: int) -> Column:
        return F.when(be_uint(box, 0, 1) == 1, F.lit(new)).otherwise(F.lit(old))

    source = fourcc("stsd", 12)
    full = source.isin("encv", "enca") & (F.length("frma") >= 4) & (F.length("schm") >= 12) & (F.length("tenc") >= 24)
    t = t.withColumns({
        "handler_type": fourcc("hdlr", 8),
        "sample_entry_type": source,
        "track_id": F.when(F.length("tkhd") >= 20, be_uint("tkhd", versioned("tkhd", 12, 20), 4)),
        "timescale": F.coalesce(F.when(F.length("mdhd") >= 20, be_uint("mdhd", versioned("mdhd", 12, 20), 4)), F.lit(0)).cast("bigint"),
        "protection": F.when(full, F.struct(
            fourcc("schm", 4).alias("scheme"), uuid_text(slice_bytes("tenc", 8, 16)).alias("default_kid"),
            fourcc("frma").alias("original_format"), (be_uint("tenc", 6, 1) != 0).alias("is_protected"), be_uint("tenc", 7, 1).alias("iv_size"))),
    })
    t = t.withColumn("codec", F.coalesce("protection.original_format", "sample_entry_type"))
    kind = F.col("codec")
    avc = F.when(F.length("avcC") >= 4, F.concat(kind, F.lit("."), F.lower(F.hex(slice_bytes("avcC", 1, 3))))).otherwise(F.lit("avc1"))
    t = t.withColumn("codec_text", F.when(kind.isin("avc1", "avc3"), avc).when(F.lower(kind) == "opus", F.lit("opus")).otherwise(kind))
    sized, sound = F.col("codec").isin(*SIZED_VIDEO), F.col("codec").isin(*SIZED_AUDIO)

    def field(test: Column, offset: int) -> Column:
        return F.coalesce(F.when(test, be_uint("stsd", offset, 2)), F.lit(0)).cast("int")

    runs = F.transform(F.sequence(F.lit(0), F.coalesce(F.least(be_uint("stts", 4, 4), idiv(F.length("stts") - 8, 8)), F.lit(0)).cast("int")),
                       lambda i: F.struct(be_uint("stts", 8 + i * 8, 4).alias("n"), be_uint("stts", 12 + i * 8, 4).alias("d")))
    runs = F.filter(runs, lambda r: r["n"].isNotNull() & r["d"].isNotNull())
    zero = F.lit(0).cast("bigint")
    samples = F.aggregate(runs, zero, lambda a, r: a + r["n"])
    ticks = F.aggregate(runs, zero, lambda a, r: a + r["n"] * r["d"])
    rate = F.when(sized & (F.col("timescale") > 0) & (samples > 0) & (ticks > 0),
                  samples.cast("double") * F.col("timescale").cast("double") / ticks.cast("double"))
    packed = be_uint("mdhd", versioned("mdhd", 20, 32), 2)

    def letter(shift: int) -> Column:
        code = F.shiftright(packed, shift).bitwiseAND(F.lit(31).cast("bigint"))
        return F.when(code.between(1, 26), F.chr(code + 96))

    code = F.concat(letter(10), letter(5), letter(0))
    duration = F.when(be_uint("mdhd", 0, 1) == 1, be_uint("mdhd", 24, 8)).otherwise(be_uint("mdhd", 16, 4))
    scale = F.when(F.col("timescale") > 0, F.col("timescale"))
    return t.select(
        "path", "track_id", "handler_type", "codec", "codec_text", "sample_entry_type",
        F.concat("handler_type", F.lit("_"), (F.col("__n") + 1).cast("string")).alias("track_name"),
        F.lit("cmaf").alias("packaging"), "timescale",
        field(sized, 40).alias("width"), field(sized, 42).alias("height"),
        field(sound, 32).alias("channel_count"), field(sound, 40).alias("sample_rate"),
        F.coalesce(rate, F.lit(0.0)).alias("frame_rate"),
        F.coalesce(be_uint("btrt", 4, 4), zero).alias("max_bitrate"), F.coalesce(be_uint("btrt", 8, 4), zero).alias("avg_bitrate"),
        F.coalesce(F.when(duration <= 9223372036854775, idiv(duration * 1000, scale)), zero).alias("duration_ms"),
        F.coalesce(language_tag(code), F.lit("")).alias("language"),
        "protection")


def scan_tracks(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return tracks_of(scan_boxes(spark, path, glob))


def protection_of(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track protection rows, DRM system rows) of the files."""
    tracks = tracks_of(boxes).where("protection IS NOT NULL").select("path", "track_name", "protection.*")
    pssh = boxes.where("tree = 'moov/pssh' AND box_size >= 28")
    raw = F.concat(F.unhex(F.lpad(F.hex("box_size"), 8, "0")), F.encode(F.lit("pssh"), "UTF-8"), F.col("payload"))
    systems = pssh.select("path", F.col("ordinal").alias("system_seq"), uuid_text(slice_bytes("payload", 4, 16)).alias("system_id"),
                          F.regexp_replace(F.base64(raw), "[\r\n]", "").alias("pssh"))
    return tracks, systems


def scan_protection(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    return protection_of(scan_boxes(spark, path, glob))


def init_defaults(boxes: DataFrame) -> DataFrame:
    p = boxes.where("tree = 'moov/mvex/trex'")
    return p.groupBy("path", be_uint("payload", 4, 4).alias("track_id")).agg(
        F.min_by(be_uint("payload", 12, 4), "box_id").alias("duration"), F.min_by(be_uint("payload", 16, 4), "box_id").alias("size"),
        F.min_by(be_uint("payload", 20, 4), "box_id").alias("flags"))


def samples_of(boxes: DataFrame, precedence: str = "standard", mode: str = "all") -> DataFrame:
    """Samples of all track fragments and runs with defaults filled in and decode times accumulated.

    ``sample_index`` counts over the runs of a track fragment. ``file_offset`` is the
    place of a sample's bytes and ``payload_offset`` that place within the payload of the
    fragment's ``mdat``, both by :func:`_places`; a sample whose bytes would not lie
    there has nulls and a ``place_error``. ``mode="reference"`` reads the first run of
    the first track fragment alone and takes its data to begin with the ``mdat``.
    """
    heads = _fragment_heads(boxes, mode).withColumns({
        "track_id": be_uint("tfhd", 4, 4), "base_decode_time": _base_decode_time(), "__hf": be_uint("tfhd", 1, 3)})

    def width(flags: str, masks: dict[int, int]) -> Column:
        return sum((F.when(has_bit(flags, m), n).otherwise(0) for m, n in masks.items()), F.lit(0))

    skip = {0x1: 8, 0x2: 4}
    frag_default = {}
    for name, mask in (("duration", 0x8), ("size", 0x10), ("flags", 0x20)):
        frag_default[name] = F.when(has_bit("__hf", mask), be_uint("tfhd", 8 + width("__hf", skip), 4))
        skip = {**skip, mask: 4}
    traf = ["path", "fragment_index", "traf_index"]
    defaults = heads.select(*traf, *[c.alias(n) for n, c in frag_default.items()])

    fields = {"duration": 0x100, "size": 0x200, "flags": 0x400, "offset": 0x800}
    record = width("__rf", {m: 4 for m in fields.values()})
    start = 8 + width("__rf", {0x1: 4, 0x4: 4})
    first_flags = F.when(has_bit("__rf", 0x4), be_uint("trun", 8 + width("__rf", {0x1: 4}), 4))
    h = heads.select(*traf, "track_id", "base_decode_time", F.when(has_bit("__hf", 0x1), be_uint("tfhd", 8, 8)).alias("__base"), has_bit("__hf", 0x20000).alias("__in_moof"), F.inline("runs"))
    h = h.withColumn("__rf", be_uint("trun", 1, 3)).withColumns({
        "__w": record, "__start": start, "__count": be_uint("trun", 4, 4), "__first": first_flags, "__offset": F.when(has_bit("__rf", 0x1), be_int32("trun", 8)).cast("bigint")})
    # Records are cut out once per run; the run payload is not copied per sample.
    there = F.greatest(F.least(F.col("__count"), idiv(F.length("trun") - F.col("__start"), F.when(F.col("__w") > 0, F.col("__w")))), F.lit(0))
    place = ["__base", "__in_moof", "__offset"]
    keep = [*traf, "run_index", "track_id", "base_decode_time", "__rf", "__first", *place]
    cut = F.transform(F.sequence(F.lit(1), F.greatest(there, F.lit(1)).cast("int")),
                      lambda i: slice_bytes("trun", F.col("__start") + (i - 1) * F.col("__w"), F.col("__w")))
    listed = h.where("__w > 0").where(there > 0).select(*keep, F.posexplode(cut).alias("__at", "__rec"))
    listed = listed.withColumn("__at", F.col("__at").cast("bigint"))
    plain = explode_count(h.where("__w = 0").select(*keep, "__count"), "__count", "__at").select(
        *keep, "__at", F.lit(None).cast("binary").alias("__rec"))
    s = listed.unionByName(plain)
    values, skip = {}, {}
    for name, mask in fields.items():
        read = be_int32 if name == "offset" else (lambda d, o: be_uint(d, o, 4))
        values[name] = F.when(has_bit("__rf", mask), read("__rec", width("__rf", skip)))
        skip = {**skip, mask: 4}
    own_flags = F.coalesce(values["flags"], F.when(F.col("__at") == 0, F.col("__first")))
    s = s.select(*traf, "run_index", "track_id", "base_decode_time", *place, "__at", values["duration"].alias("duration"),
                 values["size"].alias("size"), own_flags.alias("flags"), F.coalesce(values["offset"], F.lit(0)).cast("int").alias("composition_offset"))
    s = overlay_defaults(s, defaults, init_defaults(boxes), traf, ["path", "track_id"], precedence)
    s = s.na.fill({"duration": 0, "size": 0, "flags": DEFAULT_FLAGS})
    if mode == "reference":
        s = s.withColumns({"__base": F.lit(None).cast("bigint"), "__in_moof": F.lit(False), "__offset": F.lit(None).cast("bigint")})
    s = _places(s, boxes)
    s = running(s, traf, ["run_index", "__at"], [run_sum("__t", F.col("duration"), exclusive=True), run_sum("sample_index", F.lit(1).cast("bigint"), exclusive=True)], hot=bounded(*traf))
    return s.withColumn("decode_time", F.col("base_decode_time") + F.col("__t")).drop("__t", "__at")


def _places(s: DataFrame, boxes: DataFrame) -> DataFrame:
    """Samples with ``file_offset``, ``payload_offset`` and ``place_error``.

    A run with a data offset begins at its track fragment's base plus that offset; the
    base is the one its header gives, else the ``moof`` (for the first track fragment,
    and where the header says so), else the end of the track fragment before. Any other
    run follows the one before, the first begins with the ``mdat`` payload; a base
    given by a header is where a first run without offset begins. An offset of 0 from
    any other base, which some writers leave to be filled in, counts as none.
    """
    key, order = ["path", "fragment_index"], ["traf_index", "run_index", "__at"]
    traf = [*key, "traf_index"]
    pairs = _pairs(boxes).select(*key, F.col("moof_offset").alias("__moof"), F.col("mdat_payload_offset").alias("__data"), (F.col("mdat_offset") + F.col("mdat_size")).alias("__end"))
    s = s.join(pairs, key, "left")
    first = F.col("__at") == 0
    from_moof = F.col("__base").isNull() & (F.col("__in_moof") | (F.col("traf_index") == 0))
    s = s.withColumn("__offset", F.when(first & (F.col("__base").isNotNull() | (F.col("__offset") != 0)), F.col("__offset")))
    base = F.coalesce("__base", F.when(from_moof, F.col("__moof")))
    fixed = F.when(first, F.coalesce(base + F.col("__offset"), F.when(F.col("run_index") == 0, F.col("__base"))))
    # One fragment is one box: its samples are a bounded group, and one clustering by fragment serves all of these sums.
    fragment, piece = bounded(*key), bounded(*traf)
    s = running(s, key, order, [run_sum("__before", F.col("size"), exclusive=True)], hot=fragment)
    s = running(s, traf, order[1:], [run_sum("__own", F.col("size"), exclusive=True)], hot=piece)
    # a base that is the end of the track fragment before: offsets count from there, not from the run before
    s = running(s, traf, order[1:], [run_last("__from", F.col("__offset") - F.col("__own"), exclusive=True)], hot=piece)
    jump = F.when(base.isNull() & F.col("__offset").isNotNull(), F.col("__offset") - F.col("__own") - F.coalesce("__from", F.lit(0)))
    s = running(s.withColumns({"__fixed": fixed, "__jump": F.coalesce(jump, F.lit(0))}), key, order, [run_sum("__jumps", F.col("__jump"))], hot=fragment)
    s = s.withColumn("__before", F.col("__before") + F.col("__jumps"))
    s = running(s, key, order, [run_last("__anchor", F.col("__fixed") - F.col("__before"))], hot=fragment)
    at = F.coalesce("__anchor", "__data") + F.col("__before")
    inside = (at >= F.col("__data")) & (at + F.col("size") <= F.col("__end"))
    s = s.withColumn("__place", at).withColumns({
        "file_offset": F.when(inside, F.col("__place")), "payload_offset": F.when(inside, F.col("__place") - F.col("__data")),
        "place_error": F.when(F.col("__data").isNull(), "no mdat").when(~inside, "outside its mdat")})
    return s.drop("__moof", "__data", "__end", "__base", "__in_moof", "__offset", "__before", "__own", "__from", "__fixed", "__jump", "__jumps", "__anchor", "__place")


def scan_samples(spark: SparkSession, path: str, glob: str | None = None, precedence: str = "standard", mode: str = "all") -> DataFrame:
    return samples_of(stage(scan_boxes(spark, path, glob)), precedence, mode)
