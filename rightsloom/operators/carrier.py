"""Pixel carrier: payload bits in the low bits of colour channels, spread by a keyed permutation."""

from __future__ import annotations

import numpy as np

from ..functions.binary import FRAME_HEAD, frame_bytes, frame_size, unframe_bytes

# Constants of the 64-bit mixer and of tile seeds, copies of each bit per unit of redundancy.
GOLDEN, MIX_A, MIX_B, TILE_X, TILE_Y = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
SPREAD = 5
_M = (1 << 64) - 1


def splitmix64(x: int) -> int:
    z = (x + GOLDEN) & _M
    for shift, factor in ((30, MIX_A), (27, MIX_B)):
        z = ((z ^ (z >> shift)) * factor) & _M
    return z ^ (z >> 31)


def tile_seed(seed: int, x: int, y: int) -> int:
    return splitmix64(seed ^ ((x * TILE_X) & _M) ^ ((y * TILE_Y) & _M))


def permutation(index: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Slots of indexes under a bijection of [0, slots): an affine map modulo the next power of two, walked until inside."""
    if slots <= 1:
        return np.minimum(index, max(slots - 1, 0))
    mask = np.uint64((1 << (slots - 1).bit_length()) - 1)
    a = np.uint64((splitmix64(seed) * 2 & _M) | 1)
    b = np.uint64(splitmix64((seed + GOLDEN) & _M))
    x = (a * index.astype(np.uint64) + b) & mask
    while (out := x >= np.uint64(slots)).any():
        x[out] = (a * x[out] + b) & mask
    return x.astype(np.int64)


def capacity(width: int, height: int) -> int:
    return 3 * width * height


def required(payload_bits: int, redundancy: int) -> int:
    return payload_bits * SPREAD * redundancy


def _slots(bits: int, pixels: np.ndarray, seed: int, redundancy: int, base: int, reserved: int) -> np.ndarray:
    n = bits * SPREAD * redundancy
    return reserved + permutation(np.arange(base, base + n), capacity(pixels.shape[1], pixels.shape[0]) - reserved, seed)


def _places(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slots, the place of each among the bytes of an image of four channels, and its pixel."""
    pixel, channel = np.divmod(slot.astype(np.uint32), np.uint32(3))
    return pixel.astype(np.int64) * 4 + channel, pixel


def embed_in_place(pixels: np.ndarray, payload: bytes, seed: int, redundancy: int = 1, reserved: int = 0) -> bool:
    """Puts the payload into pixels (height, width, 4); False, and nothing changed, if it doesn't fit. A value moves by one
    where its low bit differs: inward at the ends of the range, else up or down by the pixel's place. The first
    reserved slots stay as they are."""
    h, w = pixels.shape[:2]
    if required(8 * len(payload), redundancy) > capacity(w, h) - reserved:
        return False
    bits = np.repeat(np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little"), SPREAD * redundancy)
    place, pixel = _places(_slots(8 * len(payload), pixels, seed, redundancy, 0, reserved))
    flat = pixels.reshape(-1)
    if not np.shares_memory(flat, pixels):
        raise ValueError("pixels must lie in one piece")
    old = flat[place]
    y, x = np.divmod(pixel, np.uint32(w))
    down = ((x + y) & np.uint32(1)).astype(bool)  # 31 x + 17 y is odd where x + y is
    down &= old != 0
    down |= old == 255
    wrong = (old & 1) != bits
    flat[place] = old + np.where(down, np.uint8(255), np.uint8(1)) * wrong
    return True


def embed(pixels: np.ndarray, payload: bytes, seed: int, redundancy: int = 1, reserved: int = 0) -> np.ndarray | None:
    """A copy with the payload, or None if it doesn't fit, see embed_in_place()."""
    out = pixels.copy()
    return out if embed_in_place(out, payload, seed, redundancy, reserved) else None


def extract(pixels: np.ndarray, n_bytes: int, seed: int, redundancy: int = 1, base: int = 0, reserved: int = 0) -> bytes | None:
    """Payload by majority over each bit's replicas (a tie is 0); None if the image is too small."""
    h, w = pixels.shape[:2]
    if base + required(8 * n_bytes, redundancy) > capacity(w, h) - reserved:
        return None
    slot = _slots(8 * n_bytes, pixels, seed, redundancy, base, reserved)
    ones = (np.ascontiguousarray(pixels).reshape(-1)[_places(slot)[0]] & 1).reshape(8 * n_bytes, -1).sum(1, dtype=np.int64)
    return np.packbits(ones > SPREAD * redundancy // 2, bitorder="little").tobytes()


def embed_framed(pixels: np.ndarray, payload: bytes, seed: int, redundancy: int = 1) -> np.ndarray | None:
    """embed() of the payload in a frame that has its length and checksum, so that a reader needs only the seed."""
    return embed(pixels, frame_bytes(payload), seed, redundancy)


def extract_framed(pixels: np.ndarray, seed: int, redundancy: int = 1) -> tuple[str, bytes | None]:
    """Status and payload of a frame, see unframe_bytes(): its head is read first, then as much as that says."""
    head = extract(pixels, FRAME_HEAD, seed, redundancy)
    status, size = frame_size(head or b"")
    if status != "ok":
        return status, None
    whole = extract(pixels, FRAME_HEAD + size, seed, redundancy)
    return ("bad_length", None) if whole is None else unframe_bytes(whole)


#: Slots that hold the seed.
SEED_SLOTS = 64


def embed_seed(pixels: np.ndarray, seed: int) -> np.ndarray:
    """The seed in the low bits of the first 64 colour values."""
    out = pixels.copy()
    flat = out[..., :3].reshape(-1)
    bits = np.unpackbits(np.frombuffer(seed.to_bytes(8, "little"), np.uint8), bitorder="little")
    flat[:64] = (flat[:64] & 0xFE) | bits
    out[..., :3] = flat.reshape(out.shape[0], out.shape[1], 3)
    return out


def extract_seed(pixels: np.ndarray) -> int | None:
    """None where there is none (0) or the image has too few values."""
    flat = pixels[..., :3].reshape(-1)
    if len(flat) < 64:
        return None
    return int.from_bytes(np.packbits(flat[:64] & 1, bitorder="little").tobytes(), "little") or None


def ecc_encode(data: bytes) -> bytes:
    return data * 3


def ecc_decode(data: bytes) -> bytes | None:
    """Byte-wise mode of three copies; if all differ, the largest."""
    if len(data) % 3:
        return None
    a, b, c = np.frombuffer(data, np.uint8).reshape(3, -1)
    return np.where((a == b) | (a == c), a, np.where(b == c, b, np.maximum(np.maximum(a, b), c))).astype(np.uint8).tobytes()
