"""Measures of one photo or video file, read by ranges inside a task: size, orientation, time taken, place, duration."""

from __future__ import annotations

import calendar
import struct
import time
from collections.abc import Iterator
from typing import Any

from shoebox.sources.ranged import Bytes, Held, Part

# Numbers of the tags in a photo's metadata, bytes of their types, and the seconds from 1904 to 1970.
ORIENTATION, EXIF, GPS = 0x0112, 0x8769, 0x8825
DATE_ORIGINAL, DATE_CREATED = 0x9003, 0x9004
LAT_REF, LAT, LNG_REF, LNG = 1, 2, 3, 4
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
SINCE_1904 = 2_082_844_800
TIFF_SIGNS, PNG_SIGN, MARK = (b"II*\0", b"MM\0*"), b"\x89PNG\r\n\x1a\n", b"Exif\0\0"
#: Bytes of one metadata value, and of one box of small parts, that are read at most; what claims to be longer is damaged.
LONGEST = 1 << 20


def _bytes(content: bytes | Bytes) -> Bytes:
    return Held(content) if isinstance(content, bytes) else content


def _segments(jpeg: Bytes) -> Iterator[tuple[int, Part]]:
    """Markers of a JPEG file before its picture data, with what they hold."""
    at = 2
    while len(head := jpeg.read(at, 4)) == 4 and head[0] == 0xFF:
        marker, size = head[1], int.from_bytes(head[2:], "big")
        if marker == 0xDA or size < 2:
            return
        yield marker, Part(jpeg, at + 4, size - 2)
        at += 2 + size


def _tags(tiff: Bytes, order: str, at: int) -> dict[int, Any]:
    """Values of one directory: text, or a tuple of numbers."""
    out: dict[int, Any] = {}
    if at <= 0 or at + 2 > tiff.size:
        return out
    n = struct.unpack(order + "H", tiff.read(at, 2))[0]
    entries = tiff.read(at + 2, 12 * n)
    for i in range(len(entries) // 12):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
        size = TYPE_BYTES.get(kind, 0) * count
        if not size or size > LONGEST:
            continue
        raw = entries[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else tiff.read(struct.unpack_from(order + "I", entries, 12 * i + 8)[0], size)
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("ascii", "ignore")
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
        else:
            out[tag] = struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, raw)
    return out


def _millis(text: Any) -> int | None:
    """A time written ``YYYY:MM:DD HH:MM:SS``, which names no zone, taken as UTC."""
    try:
        return calendar.timegm(time.strptime(str(text)[:19], "%Y:%m:%d %H:%M:%S")) * 1000
    except ValueError:
        return None


def _degrees(ref: Any, parts: Any) -> float | None:
    if not isinstance(parts, tuple) or len(parts) != 3:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -value if ref in ("S", "W") else value


def _metadata(tiff: Bytes) -> dict[str, Any]:
    """Orientation, time taken and place that a block of tagged metadata tells."""
    out: dict[str, Any] = {}
    head = tiff.read(0, 8)
    if len(head) < 8 or head[:4] not in TIFF_SIGNS:
        return out
    order = "<" if head[:2] == b"II" else ">"
    main = _tags(tiff, order, struct.unpack_from(order + "I", head, 4)[0])
    shot, place = (_tags(tiff, order, main.get(tag, (0,))[0]) for tag in (EXIF, GPS))
    taken = _millis(shot.get(DATE_ORIGINAL))
    taken = _millis(shot.get(DATE_CREATED)) if taken is None else taken
    lat, lng = _degrees(place.get(LAT_REF), place.get(LAT)), _degrees(place.get(LNG_REF), place.get(LNG))
    out["orientation"] = main.get(ORIENTATION, (1,))[0]
    if taken is not None:
        out["taken_ms"] = taken
    if lat is not None and lng is not None:
        out |= {"lat": lat, "lng": lng}
    return out


def _jpeg(file: Bytes) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for marker, held in _segments(file):
        if marker == 0xE1 and held.read(0, 6) == MARK:
            out |= _metadata(Part(held, 6, held.size - 6))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and held.size >= 5:
            out["height"], out["width"] = struct.unpack(">HH", held.read(1, 4))
    return out


def _png(file: Bytes) -> dict[str, Any]:
    out: dict[str, Any] = {}
    at = 8
    while len(head := file.read(at, 8)) == 8:
        size, name = struct.unpack(">I4s", head)
        if name == b"IHDR" and size >= 8:
            out["width"], out["height"] = struct.unpack(">II", file.read(at + 8, 8))
        elif name == b"eXIf":
            out |= _metadata(Part(file, at + 8, size))
        elif name == b"IEND":
            break
        at += size + 12
    return out


def _webp(file: Bytes) -> dict[str, Any]:
    out: dict[str, Any] = {}
    at = 12
    while len(head := file.read(at, 8)) == 8:
        name, size = struct.unpack("<4sI", head)
        held = Part(file, at + 8, size)
        first = held.read(0, 10)
        if name == b"VP8X" and len(first) == 10:
            out |= {"width": 1 + int.from_bytes(first[4:7], "little"), "height": 1 + int.from_bytes(first[7:10], "little")}
        elif name == b"VP8 " and first[3:6] == b"\x9d\x01\x2a" and "width" not in out:
            w, h = struct.unpack("<HH", first[6:])
            out |= {"width": w & 0x3FFF, "height": h & 0x3FFF}
        elif name == b"VP8L" and first[:1] == b"/" and "width" not in out:
            bits = int.from_bytes(first[1:5], "little")
            out |= {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1}
        elif name == b"EXIF":
            marked = 6 if first[:6] == MARK else 0
            out |= _metadata(Part(held, marked, held.size - marked))
        at += 8 + size + size % 2
    return out


def _boxes(file: Bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Boxes of one level: name, and where its content begins and ends."""
    while at + 8 <= end and len(start := file.read(at, 16)) >= 8:
        size, name = struct.unpack_from(">I4s", start)
        head = 8
        if size == 1 and len(start) == 16 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", start, 8)[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def _number(data: bytes, at: int, n: int) -> tuple[int, int]:
    if at + n > len(data):
        raise ValueError("a table ends early")
    return int.from_bytes(data[at : at + n], "big"), at + n


def _exif_item(data: bytes) -> int | None:
    """The number of the item that holds metadata, from a table of items."""
    entries = Held(data)
    for name, a, b in _boxes(entries, 6 if data[:1] == b"\0" else 8, len(data)):
        if name == b"infe" and data[a] >= 2:
            item, at = _number(data, a + 4, 2 if data[a] == 2 else 4)
            if data[at + 2 : min(at + 6, b)] == b"Exif":
                return item
    return None


def _extent(data: bytes, wanted: int) -> tuple[int, int, int] | None:
    """Of one item, from a table of places: how it is stored, where its first stretch begins, and its length."""
    version, sizes = data[0], int.from_bytes(data[4:6], "big")
    offset_n, length_n, base_n, index_n = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    count, at = _number(data, 6, 2 if version < 2 else 4)
    for _ in range(count):
        item, at = _number(data, at, 2 if version < 2 else 4)
        stored = 0
        if version:
            stored, at = _number(data, at, 2)
        base, at = _number(data, at + 2, base_n)
        extents, at = _number(data, at, 2)
        for i in range(extents):
            offset, at = _number(data, at + index_n, offset_n)
            length, at = _number(data, at, length_n)
            if item == wanted and not i:
                return stored & 15, base + offset, length
    return None


def _heif(file: Bytes) -> dict[str, Any]:
    """A picture in boxes: its size is the largest that a part of it has, its metadata are an item of their own."""
    out: dict[str, Any] = {}
    small = lambda a, b: file.read(a, min(b - a, LONGEST))
    for name, a, b in _boxes(file, 0, file.size):
        if name != b"meta":
            continue
        item = places = None
        inner = 0
        for part, c, d in _boxes(file, a + 4, b):
            if part == b"iinf":
                item = _exif_item(small(c, d))
            elif part == b"iloc":
                places = small(c, d)
            elif part == b"idat":
                inner = c
            elif part == b"iprp":
                sizes = [struct.unpack(">II", file.read(g + 4, 8)) for held, e, f in _boxes(file, c, d) if held == b"ipco" for kind, g, h in _boxes(file, e, f) if kind == b"ispe" and h - g >= 12]
                if sizes:
                    out["width"], out["height"] = max(sizes, key=lambda s: s[0] * s[1])
        found = _extent(places, item) if places and item is not None else None
        if found and found[0] < 2:
            held = Part(file, found[1] + (inner if found[0] else 0), found[2])
            skip = int.from_bytes(held.read(0, 4), "big") + 4
            out |= _metadata(Part(held, skip, held.size - skip))
    return out


def photo_measures(content: bytes | Bytes) -> dict[str, Any]:
    """Width, height, orientation, time taken and place of a JPEG, TIFF, DNG, HEIC, PNG or WebP file, and the size of a GIF or BMP; what it does not say is left out.

    The time is that of the shot, else that of the file's creation.  Only headers and tables are read.
    """
    file = _bytes(content)
    head = file.read(0, 26)
    if head[:2] == b"\xff\xd8":
        return _jpeg(file)
    if head[:4] in TIFF_SIGNS:
        return _metadata(file)
    if head[:8] == PNG_SIGN:
        return _png(file)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp(file)
    if head[4:8] == b"ftyp":
        return _heif(file)
    if head[:4] == b"GIF8" and len(head) >= 10:
        return dict(zip(("width", "height"), struct.unpack("<HH", head[6:10]), strict=True))
    if head[:2] == b"BM" and len(head) == 26:
        return dict(zip(("width", "height"), map(abs, struct.unpack("<ii", head[18:])), strict=True))
    return {}


def video_measures(content: bytes | Bytes) -> dict[str, Any]:
    """Width, height, duration and creation time of an MP4 or QuickTime file; what it does not say is left out.  Frames are passed over unread."""
    out: dict[str, Any] = {}
    file = _bytes(content)
    for name, a, b in _boxes(file, 0, file.size):
        if name != b"moov":
            continue
        for part, c, d in _boxes(file, a, b):
            if part == b"mvhd" and d - c >= 20:
                held = file.read(c, 32)
                created, scale, length = struct.unpack_from(">QxxxxxxxxIQ", held, 4) if held[0] == 1 else struct.unpack_from(">IxxxxII", held, 4)
                if scale:
                    out["duration_ms"] = round(length * 1000 / scale)
                if created > SINCE_1904:
                    out["taken_ms"] = (created - SINCE_1904) * 1000
            elif part == b"trak" and "width" not in out:
                for inner, e, f in _boxes(file, c, d):
                    if inner == b"tkhd" and f - e >= 84:
                        w, h = struct.unpack(">II", file.read(f - 8, 8))
                        if w and h:
                            out |= {"width": w >> 16, "height": h >> 16}
    return out
