"""Verification of image files: fields, policy, payload and the strength of the evidence, one row per file."""

from __future__ import annotations

import hashlib
import hmac
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import container_format
from ..session import prepare
from ..sources import png
from . import carrier, containers, jpeg, notice, payload
from .limits import LIMITS

TAG = 16
# Redundancies that are tried, the base of the offset seeds and how many passes there are.
REDUNDANCIES = tuple(range(1, 11))
OFFSET, PASSES, _M = 0x517CC1B727220A95, 5, (1 << 64) - 1


def build_payload(seed: int, policy: int, content_hash: bytes, key: bytes | None = None) -> bytes:
    """Version 3 payload with a checksum, or with an HMAC tag if there is a key."""
    algorithm, tag_len = (3, TAG) if key else (1, 4)
    total = payload.V3_HEADER + tag_len
    head = bytes.fromhex("534503") + struct.pack("<BHHHBQH8sBBB", payload.V3_HEADER, total, 0, 0, policy, seed, 0, content_hash[:8], algorithm, tag_len, 0)
    tag = hmac.new(key, head, hashlib.sha256).digest()[:TAG] if key else struct.pack("<I", zlib.crc32(head))
    return head + tag


def check_payload(data: bytes, key: bytes | None) -> str:
    """Verified, AuthFailed, KeyMissing or Invalid, by the algorithm that the payload names."""
    head, tag = data[: payload.V3_HEADER], data[payload.V3_HEADER :]
    if data[29] == 3:
        return "KeyMissing" if key is None else "Verified" if hmac.compare_digest(hmac.new(key, head, hashlib.sha256).digest()[:TAG], tag[:TAG]) else "AuthFailed"
    return "Verified" if data[29] == 1 and tag[:4] == struct.pack("<I", zlib.crc32(head)) else "Invalid"


def metadata_seed(data: bytes) -> int | None:
    """The seed that a PNG text chunk or a JPEG comment names."""
    for _, kind, _, _, body, _ in containers.png_chunks(data) if data[:8] == containers.PNG_SIGNATURE else containers.jpeg_segments(data):
        key, _, value = body.partition(b"\0")
        if kind == "iTXt":
            value = value[2:].split(b"\0", 2)[-1]
        if kind == "FE":
            key, _, value = body.partition(b": ")
        if kind in ("tEXt", "iTXt", "FE") and key == b"Description" and value.startswith(b"Protected image. Seed: "):
            key, value = b"X-Protection-Seed", value.removeprefix(b"Protected image. Seed: ")
        value = value.strip()
        if kind in ("tEXt", "iTXt", "FE") and key == b"X-Protection-Seed" and value.isdigit() and int(value) <= _M:
            return int(value)
    return None


def _checked(head: bytes | None, whole, key: bytes | None) -> tuple[str, bytes | None]:
    """Status of the payload that starts with head; whole gives candidates of a size."""
    if head is None or head[:3].hex() != payload_magic():
        return "NotFound", None
    size = struct.unpack_from("<H", head, 4)[0]
    found = ("Invalid", None)
    for data in whole(size) if payload.V3_HEADER < size <= payload.V3_MAX else ():
        if data is None:
            continue
        status = check_payload(data, key)
        if status == "Verified":
            return status, data
        if found[1] is None:
            found = (status, data)
    return found


def find_payload(data: bytes, key: bytes | None, redundancies=REDUNDANCIES) -> tuple[str, bytes | None]:
    """First valid candidate, else the first that is one at all; a prefix is read before the whole payload.

    PNG: the seed from the low bits, then that of the metadata, each as it is and then by offsets, each redundancy.
    JPEG: the seed from the quantisation tables, then that of the metadata, each redundancy.
    """
    found = ("NotFound", None)
    for candidate in (_jpeg_candidates if data[:2] == b"\xff\xd8" else _png_candidates)(data, redundancies):
        status, whole = _checked(*candidate, key)
        if status == "Verified":
            return status, whole
        if found[0] == "NotFound":
            found = (status, whole)
    return found


def _png_candidates(data: bytes, redundancies):
    pixels = png.decode(data)
    if pixels is None:
        return
    for seed in dict.fromkeys(s for s in (carrier.extract_seed(pixels), metadata_seed(data)) if s is not None):
        for own in (seed, *[seed * (OFFSET + k) & _M for k in range(PASSES)]):
            for r in redundancies:
                read = lambda n, own=own, r=r: carrier.extract(pixels, n, own, r, reserved=carrier.SEED_SLOTS)
                yield read(6), lambda n, read=read: [read(n)]


def _jpeg_candidates(data: bytes, redundancies):
    seeds = dict.fromkeys(s for s in (jpeg.extract_table_seed(data), metadata_seed(data)) if s is not None)
    decoded = jpeg.decode(data) if seeds else None
    for seed in seeds if decoded else ():
        bits = jpeg.low_bits(decoded[1], seed)
        for r in redundancies:
            yield jpeg.voted(bits, 6, r), lambda n, bits=bits: [jpeg.voted(bits, n, k) for k in redundancies]


def payload_magic() -> str:
    return payload.V3_MAGIC.lower()


def _payloads(key: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_payload(c, key) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.binary())], ["path", "payload_status", "payload"])

    return run


def verify_notices(files: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per file (path, content): all notice fields, the policy signals, payload status and evidence strength.

    Only a payload with a valid HMAC authenticates. Containers are walked once and pixels or coefficients decoded once per file; files
    of other formats have no notice. Files above the limit on input aren't read: their strength is InputTooLarge.
    """
    prepare(files.sparkSession)
    found = containers.chunks(files)
    pairs = containers.text_pairs(found).withColumn("field", F.element_at(F.create_map(*[F.lit(x) for kv in notice.vocab.NOTICE_KEYS.items() for x in kv]), F.col("key")))
    pairs = pairs.where("field is not null").withColumn("value", F.when(F.col("key") == "Copyright", notice.text.strip_copyright(F.col("value"))).otherwise(F.col("value")))
    fields = notice.notice_fields(pairs.select("path", "pos", "field", "value"), "path").unionByName(containers.webp_fields(found))
    signals = notice.policy_signals(F.col("xmp"))
    xmp = containers.xmp_packets(found).select("path", "pos", *[c.alias(n) for n, c in signals.items()])
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n)
    policy = xmp.groupBy("path").agg(*[first(n) for n in signals])
    small = F.octet_length("content") <= LIMITS["max_input_bytes"]
    marks = files.where(small & container_format(F.col("content")).isin("png", "jpeg")).select("path", "content").mapInArrow(_payloads(key), "path string, payload_status string, payload binary")
    out = files.select("path", container_format(F.col("content")).alias("format"), small.alias("_small")).join(fields, "path", "left").join(policy, "path", "left").join(marks, "path", "left")
    noticed = notice.has_notice([*notice.FIELDS, "rights_url", "dmi"])
    verified = F.coalesce(F.col("payload_status") == "Verified", F.lit(False))
    authenticated = verified & (F.hex(F.substring("payload", 30, 1)) == "03")
    return out.withColumn("payload_status", F.coalesce("payload_status", F.lit("NotFound"))).withColumns({"authenticated": authenticated, "evidence_strength": F.when(F.col("_small"), notice.notice_strength(noticed, authenticated, verified)).otherwise("InputTooLarge")}).drop("_small")


def protect_png(data: bytes, pairs: list[tuple[str, str]], seed: int, policy: int, key: bytes | None = None, xmp: str | None = None, redundancy: int = 1) -> bytes:
    """The file with notice texts, and a payload in its pixels if it fits."""
    pixels = png.decode(data)
    if pixels is not None:
        body = build_payload(seed, policy, hashlib.sha256(data).digest(), key)
        marked = carrier.embed(carrier.embed_seed(pixels, seed), body, seed, redundancy, reserved=carrier.SEED_SLOTS)
        extra = b"".join(png.text_chunk(k, v) for k, v in pairs) + (png.xmp_chunk(xmp) if xmp else b"")
        return png.encode(marked if marked is not None else pixels, extra)
    return png.with_texts(data, pairs)
