"""Ed25519 signatures (RFC 8032) over Python integers. Verification needs no secrets; signing here isn't constant-time."""

from __future__ import annotations

import hashlib
from functools import lru_cache

# Fixed values of the curve: field prime, group order, constant d, base point.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
_ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, odd: int) -> int | None:
    """The x with that parity on the curve, or None."""
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _point(x: int, y: int) -> tuple[int, int, int, int]:
    return x, y, 1, x * y % P


_BASE_Y = 4 * pow(5, -1, P) % P
BASE = _point(_x_of(_BASE_Y, 0), _BASE_Y)
_ZERO = (0, 1, 1, 0)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    out = _ZERO
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


def _windows(p) -> list[list[tuple[int, int, int, int]]]:
    """For each four bits of a scalar the 15 multiples they may stand for: a product is 64 additions at most."""
    out = []
    for _ in range(64):
        row = [p]
        for _ in range(14):
            row.append(_add(row[-1], p))
        out.append(row)
        p = _add(row[-1], p)
    return out


@lru_cache(1)
def _base_windows():
    return _windows(BASE)


def _times_by(n: int, windows):
    out = _ZERO
    for row in windows:
        if n & 15:
            out = _add(out, row[(n & 15) - 1])
        n >>= 4
    return out


#: Keys whose windows are remembered (some 300 kB each), and after how many uses they are made.
MAX_KEYS, USES = 64, 4


class _Key:
    """A decoded public key, negated; its windows from the fifth use on."""

    def __init__(self, public: bytes):
        a = _decode(public)
        self.minus = None if a is None else (P - a[0], a[1], 1, P - a[3])
        self.uses, self.windows = 0, None

    def times(self, n: int):
        self.uses += 1
        if self.uses > USES and self.windows is None:
            self.windows = _windows(self.minus)
        return _times_by(n, self.windows) if self.windows else _times(n, self.minus)


_key = lru_cache(MAX_KEYS)(_Key)


def _encode(p) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decode(data: bytes):
    n = int.from_bytes(data, "little")
    y = n & (2**255 - 1)
    x = _x_of(y, n >> 255) if y < P else None
    return None if x is None else _point(x, y)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expand(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & (2**254 - 8) | 2**254, h[32:]


def public_key(secret: bytes) -> bytes:
    return _encode(_times_by(_expand(secret)[0], _base_windows()))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    public = _encode(_times_by(a, _base_windows()))
    r = _number(prefix, message) % ORDER
    big_r = _encode(_times_by(r, _base_windows()))
    return big_r + ((r + _number(big_r, public, message) * a) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """False for wrong lengths, points off the curve and scalars beyond the order too."""
    if len(public) != 32 or len(signature) != 64:
        return False
    key, s = _key(public), int.from_bytes(signature[32:], "little")
    if key.minus is None or s >= ORDER or _decode(signature[:32]) is None:
        return False
    k = _number(signature[:32], public, message) % ORDER
    return _encode(_add(_times_by(s, _base_windows()), key.times(k))) == signature[:32]
