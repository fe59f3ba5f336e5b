"""PNG pixels and text chunks without an image library: 8-bit, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.containers import PNG_SIGNATURE, png_chunks

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, extra: bytes = b"") -> bytes:
    """RGBA pixels (height, width, 4); extra chunks go before the pixels."""
    h, w = pixels.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def size(data: bytes) -> tuple[int, int] | None:
    head = next(iter(png_chunks(data)), None)
    return struct.unpack_from(">II", head[4]) if head and head[1] == "IHDR" and head[3] == 13 else None


def decode(data: bytes, max_pixels: int = 64 << 20) -> np.ndarray | None:
    """RGBA pixels; None for what is damaged, too large or of another kind."""
    body, head = [], None
    for _, kind, _, _, part, ok in png_chunks(data):
        if kind == "IHDR" and len(part) == 13 and ok:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == "IDAT":
            body.append(part)
    if not head or head[2] != 8 or head[3] not in _CHANNELS or head[4:] != (0, 0, 0) or not 0 < head[0] * head[1] <= max_pixels:
        return None
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), h * (w * n + 1))
    except zlib.error:
        return None
    if len(raw) != h * (w * n + 1):
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(h, -1)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.add.accumulate(line.reshape(w, n), 0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            row = _predicted(line, above, n, kind == 4)
        else:
            return None
        out[y] = above = row
    px = out.reshape(h, w, n)
    alpha = px[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    colour = px[..., :3] if n > 2 else np.repeat(px[..., :1], 3, 2)
    return np.concatenate([colour, alpha], 2)


def _predicted(line: np.ndarray, above: np.ndarray, n: int, paeth: bool) -> np.ndarray:
    row, up = [0] * n + line.tolist(), [0] * n + above.tolist()
    for i in range(n, len(row)):
        a, b = row[i - n], up[i]
        if paeth:
            c = up[i - n]
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        else:
            guess = (a + b) // 2
        row[i] = (row[i] + guess) & 255
    return np.array(row[n:], np.uint8)


def text_chunk(key: str, value: str) -> bytes:
    """tEXt for ASCII, iTXt for anything else."""
    if value.isascii():
        return chunk(b"tEXt", key.encode() + b"\0" + value.encode())
    return chunk(b"iTXt", key.encode() + b"\0\0\0\0\0" + value.encode())


def xmp_chunk(xmp: str) -> bytes:
    return chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp.encode())


def with_texts(data: bytes, pairs: list[tuple[str, str]], drop: frozenset[str] = frozenset()) -> bytes:
    """The file with text chunks added before its pixels, those with keys in drop (and the added keys) removed."""
    gone = drop | {k for k, _ in pairs}
    parts, added = [PNG_SIGNATURE], False
    for _, kind, _, _, body, _ in png_chunks(data):
        if kind in ("tEXt", "iTXt") and body.split(b"\0", 1)[0].decode("latin-1") in gone:
            continue
        if kind == "IDAT" and not added:
            parts += [text_chunk(k, v) for k, v in pairs]
            added = True
        parts.append(chunk(kind.encode("latin-1"), body))
    return b"".join(parts)


def synthetic(i: int, width: int = 48, height: int = 40) -> np.ndarray:
    """A gradient with texture, by formula from a number."""
    y, x = np.mgrid[0:height, 0:width].astype(np.int64)
    channels = [(x * 5 + y * 3 + i * 17) % 256, (x * y + i * 29) % 256, (x * x + y * 7 + i) % 256, np.full_like(x, 255)]
    return np.stack(channels, 2).astype(np.uint8)
