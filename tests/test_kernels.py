"""Byte and pixel kernels against plain versions and round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rightsloom.functions import binary, text
from rightsloom.operators import carrier, containers, payload, pixel_cost, verify, voting
from rightsloom.sources import png
from rightsloom.streaming import watch


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_permutation_is_a_bijection(n, seed):
    assert np.array_equal(np.sort(carrier.permutation(np.arange(n), n, seed)), np.arange(n))


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.integers(0, 2**64 - 1), st.integers(1, 3))
def test_pixel_round_trip(body, seed, redundancy):
    image = png.synthetic(seed % 97)
    out = carrier.embed(image, body, seed, redundancy)
    assert carrier.extract(out, len(body), seed, redundancy) == body
    assert np.abs(out.astype(int) - image).max() <= 1


def test_payload_that_does_not_fit_is_refused():
    assert carrier.embed(np.zeros((4, 4, 4), np.uint8), b"x" * 10, 1) is None


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60))
def test_copies_survive_one_damaged_copy(body):
    coded = bytearray(carrier.ecc_encode(body))
    if body:
        coded[len(body)] ^= 255
    assert carrier.ecc_decode(bytes(coded)) == body
    assert carrier.ecc_decode(b"\x01\x03\x02") == b"\x03"


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters_decode(colour, channels):
    r = np.random.default_rng(colour)
    want = r.integers(0, 256, (10, 7, channels)).astype(np.uint8)
    lines = []
    flat = want.reshape(10, -1).astype(int)
    for y in range(10):
        kind = y % 5
        line = bytearray([kind])
        for i, v in enumerate(flat[y]):
            a = flat[y][i - channels] if i >= channels else 0
            b = flat[y - 1][i] if y else 0
            c = flat[y - 1][i - channels] if y and i >= channels else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            line.append((v - guess) % 256)
        lines.append(bytes(line))
    data = png.PNG_SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"".join(lines))) + png.chunk(b"IEND", b"")
    got = png.decode(data)
    assert np.array_equal(got[..., :3] if channels in (3, 4) else got[..., 0], want[..., :3] if channels in (3, 4) else want[..., 0])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200), st.sampled_from([png.PNG_SIGNATURE, b"\xff\xd8", b"RIFF", b""]))
def test_parsers_survive_any_bytes(body, head):
    for parse in containers.PARSERS.values():
        list(parse(head + body))
    png.decode(head + body)
    verify.find_payload(head + body, None)


def test_jpeg_and_riff_walks():
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + seg(0xE1, b"abc") + b"\xff\xff" + seg(0xFE, b"Copyright: Copyright (c) Ada")[1:] + seg(0xDA, b"scan") + b"rest"
    assert [(t, b) for _, t, _, _, b, _ in containers.jpeg_segments(jpeg)] == [("E1", b"abc"), ("FE", b"Copyright: Copyright (c) Ada"), ("DA", b"scan")]
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body = b"WEBP" + chunk(b"VP8X", b"1234567890") + chunk(b"XMP ", b"<x/>!")
    riff = b"RIFF" + struct.pack("<I", len(body)) + body
    assert [t for _, t, *_ in containers.riff_chunks(riff)] == ["VP8X", "XMP "]
    assert not list(containers.riff_chunks(riff + b"x"))


def test_costs_by_windows_and_by_arrays_agree(spark):
    gray = (np.arange(77).reshape(7, 11) ** 2) % 31
    df = spark.createDataFrame([(1, x, y, int(gray[y, x])) for y in range(7) for x in range(11)], "image int, x int, y int, gray int")
    got = {(r.x, r.y): r.cost for r in pixel_cost.cost_table(df, 5.0).collect()}
    want = pixel_cost.cost_grid(gray, 5.0)
    assert all(got[x, y] == pytest.approx(want[y, x]) for y in range(7) for x in range(11))


def test_frames(spark):
    bodies = [b"", b"a", b"hello" * 50]
    df = spark.createDataFrame([(b,) for b in bodies], "b binary").select("b", binary.frame(F.col("b")).alias("f"))
    got = {bytes(r.b): bytes(r.f) for r in df.collect()}
    assert got == {b: b"SG\x01" + struct.pack("<II", len(b), zlib.crc32(b)) + b for b in bodies}
    bad = [b"SG", b"XX\x01" + bytes(8), b"SG\x02" + bytes(8), b"SG\x01\x05\0\0\0" + bytes(4), b"SG\x01\x01\0\0\0" + bytes(4) + b"a", got[b"a"]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, b binary").select("i", binary.unframe(F.col("b"))["status"].alias("s")).orderBy("i")
    assert [r.s for r in df.collect()] == ["too_short", "bad_magic", "bad_version", "bad_length", "bad_crc", "ok"]


def test_payloads_parse_and_verify(spark):
    plain, keyed = verify.build_payload(2**63 + 5, 3, hashlib.sha256(b"x").digest()), verify.build_payload(9, 0, bytes(32), b"key")
    assert [verify.check_payload(plain, None), verify.check_payload(keyed, b"key"), verify.check_payload(keyed, b"no"), verify.check_payload(keyed, None)] == ["Verified", "Verified", "AuthFailed", "KeyMissing"]
    df = spark.createDataFrame([(0, plain), (1, keyed), (2, plain[:20]), (3, b"")], "i int, b binary")
    got = [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in payload.parse_payload(F.col("b")).items()]).orderBy("i").collect()]
    assert (got[0]["seed"], got[0]["dmi_policy"], got[0]["algorithm"], got[0]["error"]) == (2**63 + 5, 3, "crc32", None)
    assert got[1]["algorithm"] == "hmac_sha256_128" and got[2]["error"] == "too_short" and got[3]["error"] == "too_short"


def test_text_functions(spark):
    rows = [("<a x=\"\" y=\"1\"><b>t &amp;lt; u</b></a>", 2), ("<a><b/><c><d></d></c></a>", 3), ("</a></a><b>", 1), ("", 0), (None, None)]
    df = spark.createDataFrame(rows, "s string, d int")
    got = df.select(text.attribute(F.col("s"), "x").alias("x"), text.attribute(F.col("s"), "z").alias("z"), text.text_property(F.col("s"), "b").alias("b"), text.max_depth(F.col("s")).alias("m"), "d").collect()
    assert got[0].x == "" and got[0].z is None and got[0].b == "t < u"
    assert all(r.m == r.d for r in got)


def test_votes_break_ties(spark):
    votes = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 1, 1)], "g int, bit_idx int, bit int")
    assert {(r.bit_idx, r.bit) for r in voting.majority_bits(votes, "g").collect()} == {(0, 0), (1, 1)}
    copies = spark.createDataFrame([(0, 1), (0, 3), (0, 2), (1, 5), (1, 5), (1, 9)], "pos int, byte int")
    assert {(r.pos, r.byte) for r in voting.byte_mode(copies, ["pos"]).collect()} == {(0, 3), (1, 5)}


def test_notices_of_files(spark):
    jpeg = b"\xff\xd8" + b"\xff\xfe" + struct.pack(">H", 2 + 18) + b"Creator: Grace Hop" + b"\xff\xd9"
    image = png.encode(png.synthetic(1), png.text_chunk("Creator", "Zoë") + png.xmp_chunk('<x plus:DataMining="http://ns.useplus.org/ldf/vocab/DMI-PROHIBITED"/>'))
    df = spark.createDataFrame([("a.jpg", jpeg), ("b.png", image), ("c.txt", b"text"), ("d.png", None)], "path string, content binary")
    got = {r.path: r for r in verify.verify_notices(df).collect()}
    assert got["a.jpg"].creator == "Grace Hop" and got["b.png"].creator == "Zoë" and got["b.png"].dmi == "Prohibited"
    assert got["c.txt"].evidence_strength == "NoNoticeFound" and got["d.png"].format is None and got["b.png"].evidence_strength == "MetadataNoticeOnly"


def test_watching_a_folder_drops_repeated_contents(spark, tmp_path):
    for i, body in enumerate([b"one", b"two", b"one"]):
        (tmp_path / f"{i}.png").write_bytes(png.PNG_SIGNATURE + body)
    q = watch.watch_files(spark, str(tmp_path)).writeStream.format("memory").queryName("watched").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM watched").first()[0] == 2
