"""Baseline JPEG: headers, coefficients, payloads in coefficients and in quantisation tables."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from .carrier import GOLDEN, splitmix64
from .containers import jpeg_segments

_M = (1 << 64) - 1
#: Fixed value: marks a seed in the low bits of quantisation tables.
SEED_MAGIC = b"SEED"


@dataclass
class Header:
    width: int = 0
    height: int = 0
    precision: int = 0
    progressive: bool = False
    arithmetic: bool = False
    restart: int = 0
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantisation table)
    quant: dict = field(default_factory=dict)  # table: 64 values in zigzag order, place of the values in the file, bytes each
    huffman: dict = field(default_factory=dict)  # (class, table): (lengths, symbols)
    scan: list = field(default_factory=list)  # (component id, dc table, ac table)
    scan_at: int = 0


def parse(data: bytes) -> Header | None:
    """All that stands before the first scan; None if that is damaged."""
    h = Header()
    try:
        for _, kind, at, size, body, ok in jpeg_segments(data):
            if not ok:
                return None
            marker = int(kind, 16)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h.precision, h.height, h.width, n = struct.unpack_from(">BHHB", body)
                h.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                h.progressive, h.arithmetic = marker in (0xC2, 0xC6, 0xCA, 0xCE), marker >= 0xC9
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, table = body[i] >> 4, body[i] & 15
                    values = struct.unpack_from(">64H" if wide else "64B", body, i + 1)
                    h.quant[table] = (list(values), at + 4 + i + 1, 2 if wide else 1)
                    i += 1 + 64 * (2 if wide else 1)
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    lengths = list(body[i + 1 : i + 17])
                    symbols = list(body[i + 17 : i + 17 + sum(lengths)])
                    if len(symbols) != sum(lengths) or not _fits(lengths):
                        return None
                    h.huffman[body[i] >> 4, body[i] & 15] = (lengths, symbols)
                    i += 17 + len(symbols)
            elif marker == 0xDD:
                h.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                h.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                h.scan_at = at + 4 + size
    except (struct.error, IndexError):
        return None
    return h if h.width and h.scan_at else None


def _fits(lengths: list[int]) -> bool:
    """Codes of these lengths exist, none of all ones at 16 bits or less than a prefix code allows."""
    space = 1
    for n in lengths:
        space = 2 * space - n
        if space < 0:
            return False
    return True


def unsupported(h: Header | None) -> str | None:
    """Why coefficients can't be read: the first of what is wrong, or None."""
    if h is None:
        return "malformed"
    if h.progressive or h.arithmetic:
        return "not_baseline"
    if h.precision != 8:
        return "precision"
    if h.restart:
        return "restart_interval"
    if any(not 1 <= v <= 4 for _, a, b, _ in h.components for v in (a, b)):
        return "sampling"
    if len(h.scan) != len(h.components) or any(q not in h.quant for *_, q in h.components) or any((0, d) not in h.huffman or (1, a) not in h.huffman for _, d, a in h.scan):
        return "tables"
    return None


def structure(data: bytes) -> dict:
    """scans, has_eoi, trailing (bytes after the end of image): markers counted over the whole file."""
    scans, at, eoi = 0, 2, -1
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        m = data[at + 1]
        if m == 0xD9:
            eoi = at
            break
        if m in (0x00, 0xFF) or 0xD0 <= m <= 0xD7 or m == 0x01:
            at += 1 if m == 0xFF else 2
            continue
        scans += m == 0xDA
        if at + 4 > len(data):
            break
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return {"scans": scans, "has_eoi": eoi >= 0, "trailing": len(data) - eoi - 2 if eoi >= 0 else 0}


def _codes(table: tuple[list[int], list[int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), codes counted up in order of length."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[table[1][i]] = (code, length)
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _layout(h: Header):
    """Blocks in the order of the scan: (component, block row, block column), and each component's blocks per row."""
    hm, vm = max(c[1] for c in h.components), max(c[2] for c in h.components)
    across, down = -(-h.width // (8 * hm)), -(-h.height // (8 * vm))
    if len(h.components) == 1:
        across, down = -(-h.width // 8), -(-h.height // 8)
        return [(h.components[0][0], y, x) for y in range(down) for x in range(across)], {h.components[0][0]: across}
    order = [(c, my * v + y, mx * hz + x) for my in range(down) for mx in range(across) for c, hz, v, _ in h.components for y in range(v) for x in range(hz)]
    return order, {c: across * hz for c, hz, _, _ in h.components}


def decode(data: bytes) -> tuple[Header, dict[int, np.ndarray]] | None:
    """Coefficients by component, a row of 64 (zigzag) per block in raster order; None if unsupported or damaged."""
    h = parse(data)
    if unsupported(h):
        return None
    raw = data[h.scan_at :]
    end = next((i for i in range(len(raw) - 1) if raw[i] == 0xFF and raw[i + 1] != 0), len(raw))
    bits = np.unpackbits(np.frombuffer(raw[:end].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
    lookup = {k: {(length, code): s for s, (code, length) in _codes(t).items()} for k, t in h.huffman.items()}
    tables = {c: (lookup[0, d], lookup[1, a]) for c, d, a in h.scan}
    order, per_row = _layout(h)
    blocks: dict[int, dict] = {c[0]: {} for c in h.components}
    last = dict.fromkeys(blocks, 0)
    at = 0

    def symbol(table):
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = 2 * code + bits[at]
            at += 1
            if (length, code) in table:
                return table[length, code]
        raise IndexError

    def amplitude(n):
        nonlocal at
        v = 0
        for b in bits[at : at + n]:
            v = 2 * v + b
        if at + n > len(bits):
            raise IndexError
        at += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    try:
        for c, y, x in order:
            dc, ac = tables[c]
            block = [0] * 64
            last[c] += amplitude(symbol(dc))
            block[0] = last[c]
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = amplitude(s & 15)
                k += 1
            blocks[c][y * per_row[c] + x] = block
    except (IndexError, KeyError):
        return None
    return h, {c: np.array([b[i] for i in sorted(b)], np.int16) for c, b in blocks.items()}


def encode(data: bytes, h: Header, coefficients: dict[int, np.ndarray]) -> bytes:
    """The file with its scan written anew; all other segments stay."""
    codes = {k: _codes(t) for k, t in h.huffman.items()}
    tables = {c: (codes[0, d], codes[1, a]) for c, d, a in h.scan}
    order, per_row = _layout(h)
    last = dict.fromkeys(coefficients, 0)
    out: list[str] = []

    def put(table, run, value):
        n = abs(value).bit_length()
        code, length = table[run << 4 | n]
        out.append(f"{code:0{length}b}")
        if n:
            out.append(f"{value if value > 0 else value + (1 << n) - 1:0{n}b}")

    for c, y, x in order:
        block = coefficients[c][y * per_row[c] + x].tolist()
        dc, ac = tables[c]
        put(dc, 0, block[0] - last[c])
        last[c] = block[0]
        run = 0
        for k in range(1, 64):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                out.append("{:0{}b}".format(*ac[0xF0]))
                run -= 16
            put(ac, run, block[k])
            run = 0
        if run:
            out.append("{:0{}b}".format(*ac[0]))
    text = "".join(out)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
    return data[: h.scan_at] + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


# ---- payload in coefficients


def _places(coefficients: dict[int, np.ndarray], seed: int, blocks: dict[int, np.ndarray] | None = None) -> list[tuple[int, np.ndarray]]:
    """Places of AC values of 2 or more (in the given blocks), in keyed order: sorted, then by a hash of seed and rank."""
    rows = []
    for c in sorted(coefficients):
        b, k = np.nonzero(np.abs(coefficients[c][:, 1:]) >= 2)
        if blocks is not None:
            keep = np.isin(b, blocks.get(c, np.zeros(0, int)))
            b, k = b[keep], k[keep]
        rows.append(np.stack([np.full(len(b), c), b, k + 1], 1))
    all_ = np.concatenate(rows) if rows else np.zeros((0, 3), int)
    key = np.array([splitmix64((seed + GOLDEN * i) & _M) for i in range(len(all_))], np.uint64)
    return all_[np.argsort(key, kind="stable")]


def coefficient_capacity(coefficients: dict[int, np.ndarray], payload_bits: int) -> int:
    """Redundancy that fits."""
    return sum(int((np.abs(v[:, 1:]) >= 2).sum()) for v in coefficients.values()) // max(1, payload_bits)


def embed(coefficients: dict[int, np.ndarray], payload: bytes, seed: int, redundancy: int = 3, blocks=None) -> tuple[dict[int, np.ndarray], int] | None:
    """Copies with the payload and the redundancy used (as much of the wanted one as fits), or None. A value whose low bit
    is wrong goes one down, a 2 up, so that no value leaves the set of places."""
    bits = np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little")
    places = _places(coefficients, seed, blocks)
    use = min(redundancy, len(places) // max(1, len(bits)))
    if use < 1:
        return None
    out = {c: v.copy() for c, v in coefficients.items()}
    for i, (c, b, k) in enumerate(places[: use * len(bits)]):
        v = int(out[c][b, k])
        if abs(v) & 1 != bits[i % len(bits)]:
            out[c][b, k] = (abs(v) - 1 if abs(v) > 2 else 3) * (1 if v > 0 else -1)
    return out, use


def low_bits(coefficients: dict[int, np.ndarray], seed: int, blocks=None) -> np.ndarray:
    """Low bits of all places, in keyed order."""
    return np.array([abs(int(coefficients[c][b, k])) & 1 for c, b, k in _places(coefficients, seed, blocks)], np.uint8)


def voted(bits: np.ndarray, n_bytes: int, redundancy: int) -> bytes | None:
    """Majority over the replicas of each bit; a tie is 0."""
    n = 8 * n_bytes
    if len(bits) < n * redundancy:
        return None
    ones = bits[: n * redundancy].reshape(redundancy, n).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > redundancy, bitorder="little").tobytes()


def extract(coefficients: dict[int, np.ndarray], n_bytes: int, seed: int, redundancy: int, blocks=None) -> bytes | None:
    return voted(low_bits(coefficients, seed, blocks), n_bytes, redundancy)


def tile_blocks(h: Header, x: int, y: int, size: int) -> dict[int, np.ndarray]:
    """Blocks of each component whose pixels start in a tile, under its subsampling."""
    hm, vm = max(c[1] for c in h.components), max(c[2] for c in h.components)
    order, per_row = _layout(h)
    found: dict[int, list] = {c[0]: [] for c in h.components}
    scale = {c: (8 * hm // a, 8 * vm // b) for c, a, b, _ in h.components}
    for c, row, col in order:
        px, py = col * scale[c][0], row * scale[c][1]
        if x <= px < x + size and y <= py < y + size:
            found[c].append(row * per_row[c] + col)
    return {c: np.array(sorted(v), int) for c, v in found.items()}


# ---- seed in quantisation tables


def embed_table_seed(data: bytes, seed: int) -> bytes:
    """Mark and seed in the low bits of the first two tables. Values of 1 are passed over here and not by extract_table_seed(),
    so a table with such values loses the seed; formats in use behave so."""
    h = parse(data)
    bits = np.unpackbits(np.frombuffer(SEED_MAGIC + seed.to_bytes(8, "little"), np.uint8), bitorder="little").tolist()
    out, i = bytearray(data), 0
    for table in (0, 1):
        values, at, width = h.quant.get(table, ([], 0, 1))
        for k, v in enumerate(values):
            if v != 1 and i < len(bits):
                out[at + k * width + width - 1] = out[at + k * width + width - 1] & 0xFE | bits[i]
                i += 1
    return bytes(out)


def extract_table_seed(data: bytes) -> int | None:
    h = parse(data)
    bits = [v & 1 for t in (0, 1) if h and t in h.quant for v in h.quant[t][0]]
    raw = np.packbits(np.array(bits[:96], np.uint8), bitorder="little").tobytes()
    return int.from_bytes(raw[4:], "little") if len(bits) >= 96 and raw[:4] == SEED_MAGIC else None


def synthetic(i: int, width: int = 64, height: int = 48, subsampled: bool = False) -> bytes:
    """A baseline file by formula: quantisation tables by a rule, Huffman tables with codes of one length."""
    segment = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    quant = b"".join(bytes([t]) + bytes(2 + (k * (t + 3) + i) % 90 for k in range(64)) for t in (0, 1))
    sampling = (0x22, 0x11, 0x11) if subsampled else (0x11, 0x11, 0x11)
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c + 1, s, min(c, 1)]) for c, s in enumerate(sampling))
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0, 0xF0]
    table = lambda k, s, length: bytes([k]) + bytes(len(s) if n == length else 0 for n in range(1, 17)) + bytes(s)
    huffman = b"".join(table(k, s, n) for k, s, n in ((0x00, dc, 4), (0x10, ac, 8), (0x01, dc, 4), (0x11, ac, 8)))
    scan = bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])
    data = b"\xff\xd8" + segment(0xDB, quant) + segment(0xC0, frame) + segment(0xC4, huffman) + segment(0xDA, scan)
    h = parse(data + b"\xff\xd9")
    order, _ = _layout(h)
    r = np.random.default_rng(i)
    blocks = {c[0]: sum(o[0] == c[0] for o in order) for c in h.components}
    values = {c: (r.integers(-12, 13, (n, 64)) * (r.random((n, 64)) < 0.5)).astype(np.int16) for c, n in blocks.items()}
    return encode(data, h, values)
