"""Byte functions on columns: container magic, little-endian numbers, frames."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The carrier frame's magic and version, its largest payload; magic of version 3 payloads.
FRAME_MAGIC, FRAME_VERSION, FRAME_MAX = "5347", "01", 16 << 20
V3_MAGIC = "534503"


def container_format(content: Column) -> Column:
    """png, jpeg, webp by their first bytes; null for others."""
    start = lambda x: F.startswith(F.hex(F.substring(content, 1, 12)), F.lit(x))
    webp = start("52494646") & (F.substring(F.hex(F.substring(content, 1, 12)), 17, 8) == "57454250")
    return F.when(start("89504E47"), "png").when(start("FFD8FF"), "jpeg").when(webp, "webp")


def format_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext == "png", "png").when(ext.isin("jpg", "jpeg"), "jpeg").when(ext == "webp", "webp")


def le(n: Column, width: int) -> Column:
    """A number's low bytes, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


def unsigned(content: Column, offset: int, width: int, big: bool = False) -> Column:
    """Number at an offset (from 0); eight bytes as decimal, others as long. Null if the bytes end before."""
    digits = F.hex(F.substring(content, offset + 1, width))
    ordered = digits if big else F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)])
    value = F.conv(ordered, 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(content) >= offset + width, value if width > 7 else value.cast("long"))


def frame(payload: Column) -> Column:
    """Magic, version, length, CRC-32 and payload; null beyond the largest payload."""
    size = F.octet_length(payload)
    return F.when(size <= FRAME_MAX, F.concat(F.unhex(F.lit(FRAME_MAGIC + FRAME_VERSION)), le(size, 4), le(F.crc32(payload), 4), payload))


def unframe(data: Column) -> Column:
    """struct(status, payload): ok, or the first thing wrong in the order too_short, bad_magic, bad_version, bad_length, bad_crc."""
    size, crc = unsigned(data, 3, 4), unsigned(data, 7, 4)
    payload = F.substring(data, F.lit(12), size.cast("int"))
    status = (
        F.when(F.octet_length(data) < 11, "too_short")
        .when(F.hex(F.substring(data, 1, 2)) != FRAME_MAGIC, "bad_magic")
        .when(F.hex(F.substring(data, 3, 1)) != FRAME_VERSION, "bad_version")
        .when((size > FRAME_MAX) | (F.octet_length(data) < 11 + size), "bad_length")
        .when(F.crc32(payload) != crc, "bad_crc")
        .otherwise("ok")
    )
    return F.struct(status.alias("status"), F.when(status == "ok", payload).alias("payload"))


# ---- the same frames over Python bytes, for kernels

FRAME_HEAD = 11


def frame_bytes(payload: bytes) -> bytes:
    if len(payload) > FRAME_MAX:
        raise ValueError(f"a frame holds {FRAME_MAX} bytes at most")
    return bytes.fromhex(FRAME_MAGIC + FRAME_VERSION) + len(payload).to_bytes(4, "little") + zlib.crc32(payload).to_bytes(4, "little") + payload


def frame_size(head: bytes) -> tuple[str, int]:
    """ok and the payload's length, or what is wrong with a frame's head."""
    if len(head) < FRAME_HEAD:
        return "too_short", 0
    if head[:2] != bytes.fromhex(FRAME_MAGIC):
        return "bad_magic", 0
    if head[2:3] != bytes.fromhex(FRAME_VERSION):
        return "bad_version", 0
    size = int.from_bytes(head[3:7], "little")
    return ("bad_length", 0) if size > FRAME_MAX else ("ok", size)


def unframe_bytes(data: bytes) -> tuple[str, bytes | None]:
    status, size = frame_size(data)
    if status != "ok":
        return status, None
    payload = data[FRAME_HEAD : FRAME_HEAD + size]
    if len(payload) < size:
        return "bad_length", None
    return ("ok", payload) if zlib.crc32(payload) == int.from_bytes(data[7:11], "little") else ("bad_crc", None)
