"""Smaller formats: WebP features, payload extensions, seed records in comments, XMP filtering, perceptual codes."""

from __future__ import annotations

import itertools
import re
import struct
from xml.parsers import expat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import PLUS_NAMESPACE
from .containers import riff_chunks

# Limits of payload extensions, the magic and length of seed records, and their checksum's polynomial.
MAX_EXTENSIONS, MAX_EXTENSION_BYTES, CRITICAL_BELOW, END = 32, 128, 0x0100, 0xFFFF
RECORD_BYTES, CRC16_START, CRC16_POLY = 34, 0xFFFF, 0xA001


def webp_features(data: bytes) -> dict | None:
    """Size and features of a WebP file from its chunks; None if it isn't one."""
    found = list(riff_chunks(data))
    if not found:
        return None
    kinds = {kind: body for _, kind, _, _, body, ok in reversed(found) if ok}
    size, alpha = None, "ALPH" in kinds
    if len(x := kinds.get("VP8X", b"")) >= 10:
        size = tuple(int.from_bytes(x[a : a + 3], "little") + 1 for a in (4, 7))
        alpha |= bool(x[0] & 0x10)
    elif len(x := kinds.get("VP8L", b"")) >= 5 and x[0] == 0x2F:
        v = int.from_bytes(x[1:5], "little")
        size, alpha = ((v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1), alpha or bool(v >> 28 & 1)
    elif len(x := kinds.get("VP8 ", b"")) >= 10:
        size = tuple(struct.unpack_from("<H", x, a)[0] & 0x3FFF for a in (6, 8))
    return {"size": size, "alpha": alpha, "animation": "ANIM" in kinds or "ANMF" in kinds, "xmp": "XMP " in kinds, "exif": "EXIF" in kinds, "icc": "ICCP" in kinds}


def vp8x(width: int, height: int, alpha=False, animation=False, xmp=False, exif=False, icc=False) -> bytes:
    """Body of the extended header."""
    flags = 2 * animation | 4 * xmp | 8 * exif | 16 * alpha | 32 * icc
    return bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def extensions(data: bytes) -> tuple[list[tuple[int, bytes]], str | None]:
    """(type, bytes) of a payload's extensions, and what is wrong: too_large or duplicate. Padding is of 0xFF bytes."""
    out, at, used, seen = [], 0, 0, set()
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if kind == END or len(out) == MAX_EXTENSIONS:
            break
        used += 4 + size
        if at + 4 + size > len(data) or used > MAX_EXTENSION_BYTES:
            return [], "too_large"
        if kind < CRITICAL_BELOW and kind in seen:
            return [], "duplicate"
        seen.add(kind)
        out.append((kind, data[at + 4 : at + 4 + size]))
        at += 4 + size
    return (out, None) if data[at:].strip(b"\xff") == b"" else ([], "too_large")


def _crc16_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ CRC16_POLY * (c & 1) for c in table]
    return table


_CRC16 = _crc16_table()


def crc16(data: bytes) -> int:
    crc = CRC16_START
    for b in data:
        crc = crc >> 8 ^ _CRC16[(crc ^ b) & 255]
    return crc


def seed_record(magic: bytes, seed: int, level: int, intensity: int, time: int, policy: int) -> bytes:
    """magic (11 bytes), version, level, seed, intensity, time, policy and CRC-16 for a binary comment."""
    head = struct.pack("<11sBBQHQB", magic, 1, level, seed, intensity, time, policy)
    return head + struct.pack("<H", crc16(head))


def parse_seed_record(data: bytes, magic: bytes) -> tuple[int, int, int] | None:
    """(seed, level, intensity), or None for anything damaged."""
    if len(data) < RECORD_BYTES:
        return None
    name, version, level, seed, intensity, _, _ = struct.unpack_from("<11sBBQHQB", data)
    good = name == magic and version == 1 and struct.unpack_from("<H", data, 32)[0] == crc16(data[:32])
    return (seed, level, intensity) if good else None


def filter_xmp(xmp: str, owned: frozenset[tuple[str, str]] = frozenset({(PLUS_NAMESPACE, "DataMining"), (PLUS_NAMESPACE, "OtherConstraints")})) -> str | None:
    """The packet without the owned (namespace, name) attributes and elements, all else as it stands; None if malformed."""
    parser = expat.ParserCreate(namespace_separator=" ")
    raw = xmp.encode()
    cuts, open_ = [], []
    attributes: list[tuple[int, list[str]]] = []

    def start(name, attrs):
        own = tuple(name.rsplit(" ", 1)) in owned
        open_.append((own, parser.CurrentByteIndex))
        names = [a for a in attrs if tuple(a.rsplit(" ", 1)) in owned]
        if names and not any(o for o, _ in open_):
            attributes.append((parser.CurrentByteIndex, names))

    def end(name):
        own, at = open_.pop()
        if own and not any(o for o, _ in open_):
            close = raw.find(b">", parser.CurrentByteIndex)
            cuts.append((at, close + 1))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.buffer_text = True
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        return None
    prefixes = {m[1]: m[2] for m in re.finditer(r'xmlns:([\w.-]+)\s*=\s*["\']([^"\']*)["\']', xmp)}
    for at, names in attributes:
        tag_end = at + re.match(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""", raw[at:]).end()
        for name in names:
            uri, local = name.rsplit(" ", 1)
            for p in (p for p, u in prefixes.items() if u == uri):
                m = re.search(rf"""\s+{re.escape(p)}:{re.escape(local)}\s*=\s*("[^"]*"|'[^']*')""".encode(), raw[at:tag_end])
                if m:
                    cuts.append((at + m.start(), at + m.end()))
    for a, b in sorted(cuts, reverse=True):
        raw = raw[:a] + raw[b:]
    return raw.decode()


def perceptual_code(pixels: np.ndarray) -> int:
    """64 bits: signs of the low frequencies of a 32x32 grey image against their median."""
    grey = pixels[..., :3] @ np.array([0.299, 0.587, 0.114])
    y, x = (np.arange(33) * s // 32 for s in grey.shape)
    y, x = (np.maximum.accumulate(np.maximum(v, 0)) for v in (y, x))
    small = np.array([[grey[y[i] : max(y[i + 1], y[i] + 1), x[j] : max(x[j + 1], x[j] + 1)].mean() for j in range(32)] for i in range(32)])
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None] + 1) * n[:8, None] / 64)
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def hamming_pairs(codes: DataFrame, most: int = 7) -> DataFrame:
    """a, b, distance of rows (id, code long) that differ in at most so many of 64 bits (an addition of ours: pairs of similar
    images).

    Of most + t parts of the bits t are equal in such a pair, so pairs meet by equi-join on some t parts. More parts make
    longer keys and more of them: t grows with the rows until t parts tell as many codes apart as there are rows, so
    that the chance candidates of a row stay at the number of its keys (36 of 14 bits for 10,000 rows, 330 of 23 bits for
    eight million). A pair that meets by several keys is given once. ids are unique; null codes meet nothing.
    """
    rows = codes.where(F.col("code").isNotNull()).select("id", "code")
    n, t = rows.count(), 1
    while 64 * t // (most + t) < min(max(n, 2).bit_length(), 32):
        t += 1
    edges = [64 * k // (most + t) for k in range(most + t + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    chosen = [signed(sum(c)) for c in itertools.combinations(masks, t)]  # sums of masks of different bits
    keyed = rows.select("id", "code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in chosen])).alias("k", "p"))
    a, b = keyed.toDF("a", "x", "k", "p"), keyed.toDF("b", "y", "k", "p")
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    near = a.join(b, ["k", "p"]).where((F.col("a") < F.col("b")) & (distance <= most))
    return near.select("a", "b", distance.alias("distance")).distinct()
