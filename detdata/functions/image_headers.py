"""Sizes of images from their headers: what a format states about width and height, without decoding a pixel."""

import struct
import zlib
from collections.abc import Iterator

#: (format, width, height)
Header = tuple[str, int, int]


def _png(b: memoryview) -> Header | None:
    """The first chunk; all chunks up to the end chunk must be whole and have the right checksum, and one must hold pixels."""
    at, size, pixels = 8, None, False
    while at + 12 <= len(b):
        length, kind = struct.unpack(">I4s", b[at : at + 8])
        end = at + 8 + length
        if end + 4 > len(b) or zlib.crc32(b[at + 4 : end]) != int.from_bytes(b[end : end + 4]):
            return None
        if size is None:
            if kind != b"IHDR" or length < 8:
                return None
            size = struct.unpack(">II", b[at + 8 : at + 16])
        pixels |= kind == b"IDAT"
        if kind == b"IEND":
            return ("png", *size) if pixels else None
        at = end + 4
    return None


#: Markers of JPEG frames (baseline to lossless, without the tables that share their range), and markers without a length.
JPEG_FRAMES = frozenset({0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF})
JPEG_BARE = frozenset({0x01, *range(0xD0, 0xD9)})


def _jpeg(b: memoryview) -> Header | None:
    """The first frame before the scan: segments are stepped over by their lengths, thumbnails inside them never seen."""
    at, size = 2, None
    while at + 1 < len(b):
        if b[at] != 0xFF:
            return None
        marker = b[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xDA:
            return ("jpeg", *size) if size else None
        if marker in JPEG_BARE:
            at += 2
            continue
        if at + 4 > len(b) or marker in (0x00, 0xD9):
            return None
        length = int.from_bytes(b[at + 2 : at + 4])
        if length < 2 or at + 2 + length > len(b):
            return None
        if marker in JPEG_FRAMES and size is None:
            if length < 8:
                return None
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            size = width, height
        at += 2 + length
    return None


def _gif(b: memoryview) -> Header | None:
    """The screen, or what the first picture needs if that is more."""
    if len(b) < 13:
        return None
    width, height, flags = struct.unpack("<HHB", b[6:11])
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x2C:
            if at + 10 > len(b):
                return None
            x, y, w, h = struct.unpack("<HHHH", b[at + 1 : at + 9])
            return "gif", max(width, x + w), max(height, y + h)
        if b[at] != 0x21:
            return None
        at += 2
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return None


def _bmp(b: memoryview) -> Header | None:
    if len(b) < 26:
        return None
    head = int.from_bytes(b[14:18], "little")
    if head == 12:
        return ("bmp", *struct.unpack("<HH", b[18:22]))
    width, height = struct.unpack("<ii", b[18:26])
    return ("bmp", width, abs(height)) if head in (40, 52, 56, 64, 108, 124) else None  # a negative height is read from the top


def _tiff(b: memoryview) -> Header | None:
    """Width and height of the first directory, wherever it stands."""
    order = "little" if b[0] == 0x49 else "big"
    number = lambda at, n: int.from_bytes(b[at : at + n], order)
    wide = number(2, 2) == 43
    at = number(8, 8) if wide else number(4, 4)
    count, first, step, held = (number(at, 8), at + 8, 20, 12) if wide else (number(at, 2), at + 2, 12, 8)
    if at < 8 or first + count * step > len(b):
        return None
    size = {}
    for i in range(count):
        entry = first + i * step
        tag, kind = number(entry, 2), number(entry + 2, 2)
        if tag in (256, 257) and kind in (3, 4, 16):
            size[tag] = number(entry + held, {3: 2, 4: 4, 16: 8}[kind])
    return ("tiff", size[256], size[257]) if len(size) == 2 else None


def _webp(b: memoryview) -> Header | None:
    kind = bytes(b[12:16])
    if kind == b"VP8X" and len(b) >= 30:
        return "webp", int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(b) >= 30 and bytes(b[23:26]) == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", b[26:30])
        return "webp", width & 0x3FFF, height & 0x3FFF
    return None


#: How files of each format begin.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8\xff", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff), (b"II+\0", _tiff), (b"MM\0+", _tiff))


def header(content: bytes | memoryview) -> Header | None:
    """Format, width and height that an image file states; None if it is of no known format, is broken off before its size
    is known, has a side of 0, or (PNG) has a chunk that isn't as its checksum says. The file's name takes no part."""
    b = memoryview(content).cast("B")
    for begin, parse in SIGNATURES:
        if b[: len(begin)] == begin:
            found = parse(b)
            break
    else:
        found = _webp(b) if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else None
    return found if found and found[1] > 0 and found[2] > 0 else None


def headers(contents) -> Iterator[Header]:
    """header() of each Arrow binary value, (None, None, None) where there is none."""
    for c in contents:
        raw = c.as_buffer() if c.is_valid else None
        yield (header(raw) if raw is not None else None) or (None, None, None)
