"""State processors for byte streams: MP4 boxes from chunks and PES samples from packets."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from medialake.streaming.processors import LONG, Ordered, struct_of

BYTES = T.BinaryType()
DEFAULT_FLAGS = 0x02000000
ARRIVAL_BITS = 24  # fragments that one chunk completes are numbered within its sequence number


def cut_boxes(data: bytes) -> tuple[list[tuple[str, bytes]], bytes, str | None]:
    """Complete boxes at the front of ``data``, the unread tail, and an error text for an impossible size.

    A box that runs to the end of the stream (size 0) waits for more bytes.
    """
    out, at = [], 0
    while len(data) - at >= 8:
        size, kind = struct.unpack_from(">I4s", data, at)
        if size == 1:
            if len(data) - at < 16:
                break
            size = struct.unpack_from(">Q", data, at + 8)[0]
            if size < 16:
                return out, b"", "impossible extended box size"
        elif size == 0:
            break
        elif size < 8:
            return out, b"", "impossible box size"
        if len(data) - at < size:
            break
        out.append((kind.decode("latin-1"), data[at:at + size]))
        at += size
    return out, data[at:], None


def child_boxes(data: bytes, begin: int, end: int):
    at = begin
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8 or at + size > end:
            return
        yield kind.decode("latin-1"), at, size
        at += size


def find_path(data: bytes, begin: int, end: int, *names: str) -> tuple[int, int] | None:
    """(payload offset, end) of the first box along ``names``."""
    for name in names:
        hit = next(((at, size) for kind, at, size in child_boxes(data, begin, end) if kind == name), None)
        if hit is None:
            return None
        begin, end = hit[0] + 8, hit[0] + hit[1]
    return begin, end


def fragment_track_id(moof: bytes) -> int | None:
    tfhd = find_path(moof, 8, len(moof), "traf", "tfhd")
    if tfhd is None or tfhd[1] - tfhd[0] < 8:
        return None
    return struct.unpack_from(">I", moof, tfhd[0] + 4)[0]


@dataclass(frozen=True)
class InitTrack:
    """What a live fragment needs of its track: name, handler, clock and default sample values."""

    track_id: int
    track_name: str
    handler_type: str
    timescale: int
    duration: int | None = None
    flags: int | None = None


def init_tracks(init: bytes) -> dict[int, InitTrack]:
    """Tracks of an init segment by id; names count the tracks with a handler and sample descriptions, as in the batch inventory."""
    moov = find_path(init, 0, len(init), "moov")
    if moov is None:
        return {}
    found, n = {}, 0
    for kind, at, size in child_boxes(init, *moov):
        tkhd = find_path(init, at + 8, at + size, "tkhd") if kind == "trak" else None
        if tkhd is None:
            continue
        track_id = struct.unpack_from(">I", init, tkhd[0] + (20 if init[tkhd[0]] == 1 else 12))[0]
        hdlr, mdhd = find_path(init, at + 8, at + size, "mdia", "hdlr"), find_path(init, at + 8, at + size, "mdia", "mdhd")
        handler, scale = "", 0
        if hdlr and hdlr[1] - hdlr[0] >= 12:
            handler = init[hdlr[0] + 8 : hdlr[0] + 12].decode("latin-1")
            if find_path(init, at + 8, at + size, "mdia", "minf", "stbl", "stsd"):
                n += 1
        if mdhd and mdhd[1] - mdhd[0] >= 20:
            scale = struct.unpack_from(">I", init, mdhd[0] + (20 if init[mdhd[0]] == 1 else 12))[0]
        found[track_id] = InitTrack(track_id, f"{handler}_{n}", handler, scale)
    mvex = find_path(init, *moov, "mvex")
    for kind, at, size in child_boxes(init, *mvex) if mvex else ():
        if kind == "trex" and size >= 32:
            track_id, _, duration, _, flags = struct.unpack_from(">5I", init, at + 12)
            if track_id in found and found[track_id].duration is None:
                t = found[track_id]
                found[track_id] = InitTrack(t.track_id, t.track_name, t.handler_type, t.timescale, duration, flags)
    return found


def init_track_ids(init: bytes) -> list[int]:
    return list(init_tracks(init))


_PRESENT = {"duration": 0x100, "size": 0x200, "flags": 0x400, "offset": 0x800}


def run_table(trun: bytes) -> tuple[dict[str, np.ndarray], int, int | None]:
    """Columns of a run's samples by name, their number, and the flags of its first sample; a short table ends early."""
    flags = struct.unpack_from(">I", trun)[0] & 0xFFFFFF
    count, at = struct.unpack_from(">I", trun, 4)[0], 8 + (4 if flags & 0x1 else 0)
    first = None
    if flags & 0x4 and at + 4 <= len(trun):
        first, at = struct.unpack_from(">I", trun, at)[0], at + 4
    names = [n for n, bit in _PRESENT.items() if flags & bit]
    if not names:
        return {}, count, first
    count = min(count, max(0, len(trun) - at) // (4 * len(names)))
    table = np.frombuffer(trun, ">u4", count * len(names), at).reshape(count, len(names)).astype(np.int64)
    columns = {n: table[:, k] for k, n in enumerate(names)}
    if "offset" in columns:
        columns["offset"] = np.where(columns["offset"] >= 1 << 31, columns["offset"] - (1 << 32), columns["offset"])
    return columns, count, first


def fragment_timing(moof: bytes, traf: tuple[int, int], track: InitTrack) -> dict:
    """Timing of one track fragment: base decode time, summed duration, earliest presentation, flags of its first sample.

    A value comes from the run, else from the fragment's header, else from the init segment.
    """
    duration, flags, base = track.duration or 0, track.flags, 0
    tfhd, tfdt = find_path(moof, *traf, "tfhd"), find_path(moof, *traf, "tfdt")
    if tfhd and tfhd[1] - tfhd[0] >= 8:
        bits, at = struct.unpack_from(">I", moof, tfhd[0])[0] & 0xFFFFFF, tfhd[0] + 8
        at += (8 if bits & 0x1 else 0) + (4 if bits & 0x2 else 0)
        for bit, name in ((0x8, "duration"), (0x10, "size"), (0x20, "flags")):
            if bits & bit and at + 4 <= tfhd[1]:
                value, at = struct.unpack_from(">I", moof, at)[0], at + 4
                duration, flags = (value if name == "duration" else duration), (value if name == "flags" else flags)
    if tfdt and tfdt[1] - tfdt[0] >= 8:
        wide = moof[tfdt[0]] == 1 and tfdt[1] - tfdt[0] >= 12
        base = struct.unpack_from(">Q" if wide else ">I", moof, tfdt[0] + 4)[0]
    usual = DEFAULT_FLAGS if flags is None else flags
    total, earliest, first = 0, None, None
    for kind, at, size in child_boxes(moof, *traf):
        if kind != "trun" or size < 16:
            continue
        columns, count, head = run_table(moof[at + 8 : at + size])
        if not count:
            continue
        if first is None:
            own = int(columns["flags"][0]) if "flags" in columns else head
            first = usual if own is None else own
        times = columns.get("duration")
        if times is None and "offset" not in columns:
            starts, spent = np.zeros(1, np.int64), count * duration
        else:
            times = times if times is not None else np.full(count, duration, np.int64)
            starts, spent = np.cumsum(times) - times, int(times.sum())
        shown = int((starts + columns.get("offset", 0)).min()) + base + total
        earliest = max(0, shown) if earliest is None else min(earliest, max(0, shown))
        total += spent
    return {"base": base, "duration": total, "earliest": base if earliest is None else earliest, "flags": usual if first is None else first}


def wanted(tail: bytes) -> int:
    """Bytes that must be there before the next box of ``tail`` can be cut."""
    if len(tail) < 8:
        return 8
    size = struct.unpack_from(">I", tail)[0]
    if size == 1:
        return struct.unpack_from(">Q", tail, 8)[0] if len(tail) >= 16 else 16
    return size or 1 << 62  # a box without an end


class Boxes(Ordered):
    """Chunks of one path to init segments, fragments, drops and errors, in order.

    With ``timed`` a fragment is a row for each of its track fragments, with the
    track's name, handler and clock and the times of its samples; ``arrival_seq``
    grows over all of them.
    """

    order = "chunk_seq"
    columns = ("path", "chunk_seq", "kind", "track_id", "init_bytes", "fragment", "error")
    timing = ("arrival_seq", "track_name", "handler_type", "timescale", "base_ticks", "duration_ticks", "earliest_ticks", "first_flags", "payload_bytes")

    def __init__(self, timed: bool = False, keep_bytes: bool = True):
        self.timed, self.keep_bytes = timed, keep_bytes
        if timed:
            self.columns = (*self.columns, *self.timing)

    def open(self, handle):
        self.state = handle.getValueState("boxes", struct_of(tail=BYTES, moof=BYTES, init=BYTES, ready=LONG, failed=LONG))

    def begin(self):
        s = self.state.get() if self.state.exists() else (b"", b"", b"", 0, 0)
        tail, self.moof, self.init_bytes = bytes(s[0]), bytes(s[1]), bytes(s[2])
        self.parts, self.held, self.need = [tail], len(tail), wanted(tail)
        self.at, self.nth = None, 0
        self.ready, self.failed = s[3], s[4]
        self.tracks = init_tracks(self.init_bytes) if self.ready else {}
        self.ids = list(self.tracks)

    def step(self, row):
        head = {"path": row["path"], "chunk_seq": row["chunk_seq"]}
        if self.failed:
            yield {**head, "kind": "dropped", "error": "chunk after a bad box"}
            return
        data = bytes(row["bytes"])
        self.parts.append(data)
        self.held += len(data)
        if self.held < self.need:  # a large box is put together once, when it is complete
            return
        boxes, tail, error = cut_boxes(b"".join(self.parts))
        self.parts, self.held, self.need = [tail], len(tail), wanted(tail)
        for kind, data in boxes:
            if kind in ("ftyp", "moov"):
                self.init_bytes += data
                if kind == "moov" and not self.ready:
                    self.ready, self.tracks = 1, init_tracks(self.init_bytes)
                    self.ids = list(self.tracks)
                    yield {**head, "kind": "init", "init_bytes": self.init_bytes}
            elif not self.ready:
                yield {**head, "kind": "dropped", "error": f"{kind} before init"}
            elif kind == "moof":
                self.moof = data
            elif kind == "mdat":
                if not self.moof:
                    yield {**head, "kind": "dropped", "error": "mdat without moof"}
                    continue
                track = fragment_track_id(self.moof)
                track = self.ids[0] if track is None and len(self.ids) == 1 else track
                if self.timed:
                    yield from self._timed(head, data)
                elif track in self.ids:
                    yield {**head, "kind": "fragment", "track_id": int(track), "fragment": self.moof + data}
                else:
                    yield {**head, "kind": "dropped", "error": "unknown track"}
                self.moof = b""
        if error:
            self.failed = 1
            yield {**head, "kind": "error", "error": error}

    def _timed(self, head: dict, data: bytes):
        whole = self.moof + data if self.keep_bytes else None
        for kind, at, size in child_boxes(self.moof, 8, len(self.moof)):
            if kind != "traf":
                continue
            tfhd = find_path(self.moof, at + 8, at + size, "tfhd")
            track = struct.unpack_from(">I", self.moof, tfhd[0] + 4)[0] if tfhd and tfhd[1] - tfhd[0] >= 8 else self.ids[0] if len(self.ids) == 1 else None
            known = self.tracks.get(track)
            if known is None or not known.timescale:
                yield {**head, "kind": "dropped", "error": "unknown track" if known is None else "track without a clock"}
                continue
            t = fragment_timing(self.moof, (at + 8, at + size), known)
            self.nth = self.nth + 1 if head["chunk_seq"] == self.at else 0
            self.at = head["chunk_seq"]
            yield {**head, "kind": "fragment", "track_id": int(track), "fragment": whole, "arrival_seq": (int(self.at) << ARRIVAL_BITS) + self.nth, "track_name": known.track_name,
                   "handler_type": known.handler_type, "timescale": known.timescale, "base_ticks": t["base"], "duration_ticks": t["duration"], "earliest_ticks": t["earliest"],
                   "first_flags": t["flags"], "payload_bytes": len(self.moof) + len(data)}

    def end(self):
        self.state.update((b"".join(self.parts), self.moof, self.init_bytes, int(self.ready), int(self.failed)))


def pes_start(payload: bytes) -> tuple[int, bytes]:
    """(33-bit time, data) of a payload that starts a packet; no data when its header is malformed."""
    if len(payload) < 9 or payload[:3] != b"\x00\x00\x01":
        return 0, b""
    pts = 0
    if payload[7] & 0x80 and len(payload) >= 14:
        a, b, c, d, e = payload[9:14]
        pts = (a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1
    return pts, payload[9 + payload[8]:]


class PesSamples(Ordered):
    """Packets of one (feed, pid) to samples; a sample comes out when the next one starts."""

    order = "packet_index"
    columns = ("feed_id", "pid", "packet_index", "pts90k", "payload")

    def open(self, handle):
        self.state = handle.getValueState("pes", struct_of(active=LONG, pts=LONG, first=LONG, data=BYTES))

    def begin(self):
        s = self.state.get() if self.state.exists() else (0, 0, 0, b"")
        self.active, self.pts, self.first, self.parts = s[0], s[1], s[2], [bytes(s[3])]

    def step(self, row):
        payload = row["payload"]
        if payload is None:
            return
        payload = bytes(payload)
        if row["pusi"]:
            data = b"".join(self.parts)
            if self.active and data:
                yield {"feed_id": row["feed_id"], "pid": row["pid"], "packet_index": int(self.first), "pts90k": int(self.pts), "payload": data}
            self.pts, start = pes_start(payload)
            self.active, self.first, self.parts = 1, row["packet_index"], [start]
        elif self.active:
            self.parts.append(payload)

    def end(self):
        self.state.update((int(self.active), int(self.pts), int(self.first), b"".join(self.parts)))
