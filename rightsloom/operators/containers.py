"""Container parsers: one blob to many rows. Hostile bytes are expected: every length is checked, all counts are limited."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binary import container_format
from ..session import prepare
from .limits import LIMITS

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed value: chunks read of one image at most.
MAX_CHUNKS = 500


def png_chunks(data: bytes) -> Iterator[tuple[int, str, int, int, bytes, bool]]:
    """(index, type, offset, length, data, crc_ok) up to IEND or the first chunk that isn't all there."""
    at, i = 8, 0
    if data[:8] != PNG_SIGNATURE:
        return
    while at + 12 <= len(data) and i < MAX_CHUNKS:
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            return
        body = data[at + 8 : at + 8 + size]
        ok = zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + size)[0]
        yield i, kind.decode("latin-1"), at, size, body, ok
        if kind == b"IEND":
            return
        at, i = at + 12 + size, i + 1


def jpeg_segments(data: bytes) -> Iterator[tuple[int, str, int, int, bytes, bool]]:
    """Marker segments up to the first scan or the end of image; ok tells that the declared length is there."""
    if data[:2] != b"\xff\xd8":
        return
    at, i = 2, 0
    while at + 2 <= len(data) and i < MAX_CHUNKS:
        if data[at] != 0xFF:  # resynchronise at the next marker
            at = data.find(b"\xff", at)
            if at < 0:
                return
            continue
        marker = data[at + 1]
        if marker in (0x00, 0xFF) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        name = f"{marker:02X}"
        if marker == 0xD9:
            yield i, name, at, 0, b"", True
            return
        if at + 4 > len(data):
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        ok = size >= 2 and at + 2 + size <= len(data)
        yield i, name, at, max(size - 2, 0), data[at + 4 : at + 2 + size], ok
        if not ok or marker == 0xDA:
            return
        at, i = at + 2 + size, i + 1


def riff_chunks(data: bytes) -> Iterator[tuple[int, str, int, int, bytes, bool]]:
    """Chunks of a WebP file; nothing if the declared size isn't the physical one. ok tells that the chunk is all there."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP" or struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        return
    at, i = 12, 0
    while at + 8 <= len(data) and i < MAX_CHUNKS:
        kind, size = struct.unpack_from("<4sI", data, at)
        ok = at + 8 + size <= len(data)
        yield i, kind.decode("latin-1"), at, size, data[at + 8 : at + 8 + size], ok
        if not ok:
            return
        at, i = at + 8 + size + (size & 1), i + 1


PARSERS: dict[str, Callable] = {"png": png_chunks, "jpeg": jpeg_segments, "webp": riff_chunks}
_FIELDS = pa.schema([("path", pa.string()), ("format", pa.string()), ("idx", pa.int32()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary()), ("ok", pa.bool_())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, kind, content in zip(*[batch.column(c).to_pylist() for c in ("path", "format", "content")], strict=True):
            rows = [(path, kind, *r) for r in PARSERS[kind](content)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def chunks(files: DataFrame, max_bytes: int = LIMITS["max_input_bytes"]) -> DataFrame:
    """path, format, idx, type, offset, length, data, ok for files (path, content). Size and magic are tested before any
    Python code sees a file; files of no known format, or above the limit, give no rows."""
    prepare(files.sparkSession)
    known = files.where(F.octet_length("content") <= max_bytes).withColumn("format", container_format(F.col("content"))).where("format is not null")
    return known.select("path", "format", "content").mapInArrow(_walk, "path string, format string, idx int, type string, offset long, length long, data binary, ok boolean")


def text_pairs(found: DataFrame) -> DataFrame:
    """path, pos, container, key, value of PNG text chunks and JPEG comments.

    tEXt: key, NUL, value up to a NUL. iTXt as its specification has it: two flags, language and translated key come
    before the text; compressed text is left out. Bytes that are no UTF-8 are replaced in PNG, and a comment with
    such bytes is skipped.
    """
    utf = lambda b: F.make_valid_utf8(b.cast("string"))
    digits = F.hex("data")
    after = lambda c: F.regexp_extract(c, "(?s)^(?:[^0].|.[^0])*?00((?:..)*)$", 1)  # noqa: E731  hex digits after the first zero byte
    key = F.unhex(F.regexp_extract(digits, "^((?:[^0].|.[^0])+?)00", 1))
    plain = F.unhex(F.regexp_extract(after(digits), "^((?:[^0].|.[^0])*)", 1))
    international = F.unhex(after(after(F.substring(after(digits), 5, 1 << 30))))
    compressed = F.substring(after(digits), 1, 2) != "00"
    png = found.where((F.col("format") == "png") & F.col("type").isin("tEXt", "iTXt") & digits.rlike("^(?:[^0].|.[^0])+?00"))
    png = png.where((F.col("type") == "tEXt") | ~compressed)
    png = png.select("path", F.col("idx").alias("pos"), F.col("type").alias("container"), utf(key).alias("key"), utf(F.when(F.col("type") == "tEXt", plain).otherwise(international)).alias("value"))
    com = found.where((F.col("format") == "jpeg") & (F.col("type") == "FE")).withColumn("t", F.col("data").cast("string")).where(F.is_valid_utf8("t") & F.col("t").contains(": "))
    com = com.select("path", F.col("idx").alias("pos"), F.lit("COM").alias("container"), F.substring_index("t", ": ", 1).alias("key"), F.expr("substring(t, instr(t, ': ') + 2)").alias("value"))
    return png.unionByName(com)


def xmp_packets(found: DataFrame) -> DataFrame:
    """path, pos, xmp: packets of all formats."""
    marker = "http://ns.adobe.com/xap/1.0/\0"
    text = F.make_valid_utf8(F.col("data").cast("string"))
    png_key = "XML:com.adobe.xmp"
    png = (F.col("format") == "png") & (F.col("type") == "iTXt") & F.startswith(text, F.lit(png_key))
    jpeg = (F.col("format") == "jpeg") & (F.col("type") == "E1") & F.startswith(text, F.lit(marker))
    webp = (F.col("format") == "webp") & (F.col("type") == "XMP ")
    body = F.when(png, F.expr(f"substring(make_valid_utf8(cast(data as string)), {len(png_key) + 6})")).when(jpeg, F.expr(f"substring(make_valid_utf8(cast(data as string)), {len(marker) + 1})")).otherwise(text)
    return found.where(png | jpeg | webp).select("path", F.col("idx").alias("pos"), body.alias("xmp"))


def webp_fields(found: DataFrame) -> DataFrame:
    """path, the notice fields and rights_url of the XMP chunks of WebP files. Each chunk overwrites all fields of those
    before, but for the web statement, which stays until another has one; a chunk that isn't UTF-8 or is empty is skipped."""
    x = F.col("xmp")

    def unescaped(c: Column) -> Column:
        for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    inner = lambda tag: text.first_match(x, f"(?s)<{tag}>(.*?)</{tag}>")
    plain = lambda tag: unescaped(F.nullif(inner(tag), F.lit("")))
    alt = lambda tag: unescaped(F.nullif(text.first_match(inner(tag), "(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit("")))
    rights = alt("dc:rights")
    trimmed = F.regexp_replace(rights, r"(?U)^\s+|\s+$", "")
    seq = F.get(F.filter(F.regexp_extract_all(inner("dc:creator"), F.lit("(?s)<rdf:li>(.*?)</rdf:li>"), F.lit(1)), lambda v: v != ""), F.lit(0))
    fields = {
        "copyright_holder": F.coalesce(F.when(F.startswith(trimmed, F.lit("Copyright (c) ")), text.strip_copyright(trimmed)).otherwise(rights), plain("photoshop:DateCreated")),
        "contact": plain("photoshop:Credit"), "license_url": F.lit(None).cast("string"), "usage_terms": alt("xmpRights:UsageTerms"), "ai_constraints": plain("stegoeggo:AIConstraints"),
        "creator": unescaped(seq), "credit_line": plain("photoshop:Credit"), "copyright_owner": plain("stegoeggo:CopyrightOwner"), "licensor_name": plain("stegoeggo:LicensorName"),
        "licensor_email": plain("stegoeggo:LicensorEmail"), "licensor_url": plain("stegoeggo:LicensorURL"), "metadata_date": plain("xmp:MetadataDate"), "notice_applied_at": plain("stegoeggo:NoticeAppliedAt"),
    }
    packets = found.where((F.col("format") == "webp") & (F.col("type") == "XMP ") & (F.octet_length("data") > 0)).withColumn("xmp", F.col("data").cast("string")).where(F.is_valid_utf8("xmp"))
    read = packets.select("path", "idx", plain("xmpRights:WebStatement").alias("web"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("f"))
    last = read.groupBy("path").agg(F.max_by("f", "idx").alias("f"), F.max_by("web", F.when(F.col("web").isNotNull(), F.col("idx"))).alias("web"))
    return last.select("path", "f.*", F.col("web").alias("web_statement_of_rights"), F.col("web").alias("rights_url"))
