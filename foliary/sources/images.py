"""Image headers: kind and size from the first bytes, as Columns; whole-file checks in Python."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of some bytes (0-based place)."""
    part = F.hex(F.substring(content, at + 1, size))
    if little:
        part = F.concat(*(F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(part, 16, 10).cast("long")


def sniff(content: Column) -> Column:
    """The media type behind a file's first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(F.substring(head, 9, 16) == "6674797061766966", "image/avif")
        .when(F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1")).rlike(r"^\s*(?:<\?xml[^>]*>\s*)?<svg"), "image/svg+xml")
    )


def size_of(content: Column) -> Column:
    """(width, height) of PNG and GIF files from their headers."""
    kind = sniff(content)
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(kind == "image/png", pair(_number(content, 16, 4), _number(content, 20, 4))).when(kind == "image/gif", pair(_number(content, 6, 2, True), _number(content, 8, 2, True)))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An eight-bit colour PNG."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")

    rows = b"".join(b"\0" + rgb[i * width * 3 : (i + 1) * width * 3] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def check_png(content: bytes, max_side: int = 100_000) -> str | None:
    """The first reason why a PNG file is refused."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return "images/png-signature"
    at, seen = 8, []
    while at < len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        data, crc = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if len(data) < size or len(crc) < 4:
            return "images/png-chunk"
        if zlib.crc32(name + data) != int.from_bytes(crc, "big"):
            return "images/png-crc"
        if not seen and name != b"IHDR":
            return "images/png-order"
        if name == b"IHDR" and (size != 13 or not 0 < int.from_bytes(data[:4], "big") <= max_side or not 0 < int.from_bytes(data[4:8], "big") <= max_side):
            return "images/png-header"
        if name == b"acTL":
            return "images/png-apng"
        seen.append(name)
        at += 12 + size
        if name == b"IEND":
            return None if at == len(content) and b"IDAT" in seen else "images/png-end"
    return "images/png-end"


def decode_png(content: bytes):
    """(width, height, channels, samples) of an eight-bit PNG without interlacing or palette; None if it isn't one."""
    import numpy as np

    if check_png(content) is not None:
        return None
    width, height = int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    depth, kind, _, _, interlace = content[24:29]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or channels is None or interlace:
        return None
    packed, at = b"", 8
    while at < len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        packed += content[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(packed)
    stride = width * channels
    if len(raw) != height * (stride + 1):
        return None
    out = np.zeros((height + 1, stride + channels), np.int64)  # a row and a pixel of zeros before
    for y in range(height):
        mode, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        row, above = out[y + 1], out[y]
        if mode == 0:
            row[channels:] = line
        elif mode == 2:
            row[channels:] = (line + above[channels:]) & 255
        elif mode == 1:
            for c in range(channels):
                row[channels + c :: channels] = np.cumsum(line[c::channels]) & 255
        elif mode in (3, 4):
            for x in range(stride):
                a, b, c = int(row[x]), int(above[x + channels]), int(above[x])
                if mode == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x + channels] = (int(line[x]) + guess) & 255
        else:
            return None
    return width, height, channels, out[1:, channels:].astype(np.uint8).tobytes()


def split_alpha(channels: int, samples: bytes) -> tuple[bytes, bytes | None]:
    """Colour samples and, if there is one, the plane of transparency."""
    import numpy as np

    if channels in (1, 3):
        return samples, None
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, channels)
    return pixels[:, :-1].tobytes(), pixels[:, -1].tobytes()


def check_jpeg(content: bytes) -> tuple[int, int] | str:
    """(width, height) of a baseline or progressive JPEG, or the first reason why it is refused."""
    if content[:2] != b"\xff\xd8":
        return "images/jpeg-signature"
    at, size = 2, None
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            return "images/jpeg-marker"
        marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker in (0xC0, 0xC1, 0xC2):
            if content[at + 4] != 8:
                return "images/jpeg-depth"
            size = int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
            if content[at + 9] not in (1, 3, 4):
                return "images/jpeg-components"
        elif marker == 0xDA:
            if size is None:
                return "images/jpeg-scan"
            return size if content.rstrip(b"\0").endswith(b"\xff\xd9") else "images/jpeg-end"
        at += 2 + length
    return "images/jpeg-end"
