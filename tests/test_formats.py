"""JPEG coefficients and smaller formats: round trips, damage, plain versions."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rightsloom.operators import formats, jpeg
from rightsloom.sources import png


@pytest.mark.parametrize("subsampled", [False, True])
@pytest.mark.parametrize("size", [(64, 48), (33, 17)])
def test_coefficients_round_trip(subsampled, size):
    data = jpeg.synthetic(5, *size, subsampled)
    h, values = jpeg.decode(data)
    assert (h.width, h.height) == size and jpeg.unsupported(h) is None and not h.progressive
    assert jpeg.encode(data, h, values) == data
    assert jpeg.structure(data + b"tail") == {"scans": 1, "has_eoi": True, "trailing": 4}


@settings(max_examples=15, deadline=None)
@given(st.binary(min_size=1, max_size=20), st.integers(0, 2**64 - 1))
def test_payload_in_coefficients(body, seed):
    data = jpeg.synthetic(seed % 7, 96, 64)
    h, values = jpeg.decode(data)
    out, used = jpeg.embed(values, body, seed, 3)
    again = jpeg.decode(jpeg.encode(data, h, out))[1]
    assert jpeg.extract(again, len(body), seed, used) == body


def test_payload_in_tiles_only_touches_the_tile():
    data = jpeg.synthetic(1, 128, 96, True)
    h, values = jpeg.decode(data)
    tile = jpeg.tile_blocks(h, 64, 32, 64)
    out, used = jpeg.embed(values, b"tile", 9, 2, tile)
    assert jpeg.extract(out, 4, 9, used, tile) == b"tile"
    for c in values:
        changed = np.flatnonzero((out[c] != values[c]).any(1))
        assert np.isin(changed, tile[c]).all()


def test_seed_in_tables_and_its_blind_spot():
    data = jpeg.synthetic(2)
    assert jpeg.extract_table_seed(data) is None
    assert jpeg.extract_table_seed(jpeg.embed_table_seed(data, 2**63 + 9)) == 2**63 + 9
    at = jpeg.parse(data).quant[0][1]
    ones = data[:at] + b"\x01" + data[at + 1 :]
    assert jpeg.extract_table_seed(jpeg.embed_table_seed(ones, 77)) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 255))
def test_damaged_files_are_refused_not_fatal(at, value):
    data = bytearray(jpeg.synthetic(3, 24, 16))
    data[at % len(data)] = value
    jpeg.decode(bytes(data[:4096]))
    jpeg.structure(bytes(data))


def test_unsupported_reasons():
    data = jpeg.synthetic(3)
    assert jpeg.unsupported(jpeg.parse(data.replace(b"\xff\xc0", b"\xff\xc2"))) == "not_baseline"
    assert jpeg.unsupported(jpeg.parse(b"\xff\xd8")) == "malformed"
    assert jpeg.unsupported(jpeg.parse(data[:2] + b"\xff\xdd\0\x04\0\x05" + data[2:])) == "restart_interval"


def test_webp_features():
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    riff = lambda *c: b"RIFF" + struct.pack("<I", 4 + sum(map(len, c))) + b"WEBP" + b"".join(c)
    got = formats.webp_features(riff(chunk(b"VP8X", formats.vp8x(1000, 70000, alpha=True)), chunk(b"XMP ", b"<x/>")))
    assert got["size"] == (1000, 70000) and got["alpha"] and got["xmp"] and not got["animation"]
    lossless = formats.webp_features(riff(chunk(b"VP8L", b"\x2f" + (99 | 49 << 14 | 1 << 28).to_bytes(4, "little"))))
    assert lossless["size"] == (100, 50) and lossless["alpha"]
    assert formats.webp_features(b"RIFF") is None


def test_extensions():
    one = lambda k, b: struct.pack("<HH", k, len(b)) + b
    assert formats.extensions(one(1, b"a") + one(300, b"") + b"\xff" * 6) == ([(1, b"a"), (300, b"")], None)
    assert formats.extensions(one(1, b"a") + one(1, b"b"))[1] == "duplicate"
    assert formats.extensions(one(300, b"a") + one(300, b"b"))[1] is None
    assert formats.extensions(one(2, bytes(125)))[1] == "too_large" and formats.extensions(b"\x01\0\x09\0a")[1] == "too_large" and formats.extensions(b"\0")[1] == "too_large"


def test_seed_records():
    r = formats.seed_record(b"elevenbytes", 2**64 - 3, 2, 75, 1, 5)
    assert len(r) == 34 and formats.parse_seed_record(r, b"elevenbytes") == (2**64 - 3, 2, 75)
    assert all(formats.parse_seed_record(r[:i] + bytes([r[i] ^ 1]) + r[i + 1 :], b"elevenbytes") is None for i in range(34))
    assert formats.crc16(b"123456789") == 0x4B37  # the published check value of this checksum


def test_xmp_filter_keeps_the_rest():
    ns = formats.PLUS_NAMESPACE
    packet = f'<r:R xmlns:r="rdf" xmlns:q="{ns}" xmlns:o="other"><r:D q:DataMining="x" o:DataMining="keep" o:b=\'1\'/><q:OtherConstraints>gone <r:i>too</r:i></q:OtherConstraints><o:OtherConstraints>é stays</o:OtherConstraints></r:R>'
    assert formats.filter_xmp(packet) == f'<r:R xmlns:r="rdf" xmlns:q="{ns}" xmlns:o="other"><r:D o:DataMining="keep" o:b=\'1\'/><o:OtherConstraints>é stays</o:OtherConstraints></r:R>'
    assert formats.filter_xmp(formats.filter_xmp(packet)) == formats.filter_xmp(packet) and formats.filter_xmp("<a>") is None


def test_similar_codes_meet(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    codes = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 10))) for b in base for _ in range(3)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = {(x.a, x.b, x.distance) for x in formats.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, code long")).collect()}
    assert got == {(i, j, (codes[i] ^ codes[j]).bit_count()) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 7}
    image = png.synthetic(4, 64, 64)
    near = np.clip(image.astype(int) + 2, 0, 255).astype(np.uint8)
    assert ((formats.perceptual_code(image) ^ formats.perceptual_code(near)) & (1 << 64) - 1).bit_count() <= 7
