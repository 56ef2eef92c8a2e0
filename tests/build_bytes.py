"""Tiny MP4 and transport-stream bytes for tests."""

from __future__ import annotations

import struct

KID = bytes(range(16))
SYSTEM = bytes.fromhex("edef8ba979d64acea3c827dcd51d21ed")


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind.encode() + body


def full(kind: str, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def u32(*v: int) -> bytes:
    return struct.pack(f">{len(v)}I", *v)


def u16(*v: int) -> bytes:
    return struct.pack(f">{len(v)}H", *v)


def language(code: str) -> bytes:
    a, b, c = (ord(x) - 0x60 for x in code)
    return u16(a << 10 | b << 5 | c)


def sinf(original: str, scheme: str = "cenc") -> bytes:
    return box("sinf", box("frma", original.encode()), full("schm", 0, scheme.encode(), u32(0x10000)),
               box("schi", full("tenc", 0, bytes([0, 0, 1, 8]), KID)))


def trak(track_id: int, handler: str, entry: str, timescale: int, lang: str = "eng", duration: int = 0, stts=(), children: bytes = b"",
         width: int = 0, height: int = 0, channels: int = 2, rate: int = 48000) -> bytes:
    if handler == "vide":
        body = bytes(24) + u16(width, height) + bytes(50)
    else:
        body = bytes(16) + u16(channels, 16) + bytes(4) + u16(rate, 0)
    stsd = full("stsd", 0, u32(1), box(entry, body, children))
    table = full("stts", 0, u32(len(stts)), *[u32(n, d) for n, d in stts])
    return box("trak", full("tkhd", 0, u32(0, 0, track_id, 0, duration), bytes(60)),
               box("mdia", full("mdhd", 0, u32(0, 0, timescale, duration), language(lang), u16(0)),
                   full("hdlr", 0, u32(0), handler.encode(), bytes(13)),
                   box("minf", box("stbl", stsd, table))))


def trex(track_id: int, duration: int, size: int, flags: int) -> bytes:
    return full("trex", 0, u32(track_id, 1, duration, size, flags))


def init(*traks: bytes, trexes: bytes = b"", pssh: bool = False) -> bytes:
    extra = full("pssh", 0, SYSTEM, u32(0)) if pssh else b""
    return box("ftyp", b"isom", u32(0)) + box("moov", *traks, box("mvex", trexes), extra)


def moof(track_id: int, base: int, samples, tfhd: int = 0, tfhd_values=(), first_flags: int | None = None, v1: bool = False) -> bytes:
    """``samples``: dicts with any of duration, size, flags, offset, the same keys in each; or an int count."""
    masks = {"duration": 0x100, "size": 0x200, "flags": 0x400, "offset": 0x800}
    rows = [{}] * samples if isinstance(samples, int) else samples
    trun = sum(m for k, m in masks.items() if rows and k in rows[0]) | 0x1 | (0x4 if first_flags is not None else 0)
    body = u32(len(rows), 0) + (u32(first_flags) if first_flags is not None else b"")
    for r in rows:
        for k in masks:
            if k in r:
                body += struct.pack(">i" if k == "offset" else ">I", r[k])
    tfdt = full("tfdt", 0, struct.pack(">Q", base), version=1) if v1 else full("tfdt", 0, u32(base))
    return box("moof", full("mfhd", 0, u32(1)), box("traf", full("tfhd", tfhd, u32(track_id, *tfhd_values)), tfdt, full("trun", trun, body)))


def mdat(data: bytes) -> bytes:
    return box("mdat", data)


def packet(pid: int, payload: bytes = b"", pusi: bool = False, continuity: int = 0, adaptation: int | None = None, m2ts: bool = False) -> bytes:
    afc = 1
    head = b""
    if adaptation is not None:
        afc, head = 3, bytes([adaptation]) + bytes(adaptation)
    body = (head + payload).ljust(184, b"\xff")[:184]
    p = bytes([0x47, (0x40 if pusi else 0) | pid >> 8, pid & 0xFF, afc << 4 | continuity & 15]) + body
    return (bytes(4) if m2ts else b"") + p


def section(table: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    return bytes([0, table]) + u16(0xB000 | length, ident) + bytes([0xC1, 0, 0]) + body + bytes(4)


def pat(programs, **kw) -> bytes:
    return packet(0, section(0, 1, b"".join(u16(n, 0xE000 | pid) for n, pid in programs)), pusi=True, **kw)


def pmt(pid: int, program: int, pcr: int, streams, info: bytes = b"", **kw) -> bytes:
    body = u16(0xE000 | pcr, 0xF000 | len(info)) + info
    for kind, es, extra in streams:
        body += bytes([kind]) + u16(0xE000 | es, 0xF000 | len(extra)) + extra
    return packet(pid, section(2, program, body), pusi=True, **kw)


def pes(data: bytes, pts: int | None = None) -> bytes:
    if pts is None:
        return b"\x00\x00\x01\xe0" + u16(0) + bytes([0x80, 0, 0]) + data
    field = bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, (pts >> 15 & 0x7F) << 1 | 1, pts >> 7 & 0xFF, (pts & 0x7F) << 1 | 1])
    return b"\x00\x00\x01\xe0" + u16(0) + bytes([0x80, 0x80, 5]) + field + data
