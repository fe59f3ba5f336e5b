"""Payload search of image files."""

import hashlib
import struct

import pytest

from rightsloom.operators import carrier, jpeg, verify
from rightsloom.sources import png

BODY = verify.build_payload(77, 5, hashlib.sha256(b"x").digest(), b"key")


@pytest.mark.parametrize("redundancy", [1, 3, 7, 10])
def test_png_payload_of_any_redundancy(redundancy):
    pixels = carrier.embed_seed(png.synthetic(3, 160, 120), 77)
    data = png.encode(carrier.embed(pixels, BODY, 77, redundancy, carrier.SEED_SLOTS))
    assert verify.find_payload(data, b"key") == ("Verified", BODY)


def test_png_payload_by_metadata_and_offset_seeds():
    pixels = png.synthetic(3, 96, 80)
    own = 77 * (verify.OFFSET + 4) % 2**64
    for key, value in (("X-Protection-Seed", "77"), ("Description", "Protected image. Seed: 77")):
        data = png.encode(carrier.embed(pixels, BODY, own, 2, carrier.SEED_SLOTS), png.text_chunk(key, value))
        assert verify.find_payload(data, b"key") == ("Verified", BODY)


def test_jpeg_payload(spark):
    plain = jpeg.synthetic(5, 96, 64)
    files = []
    for redundancy in (1, 4):
        h, values = jpeg.decode(plain)
        marked = jpeg.encode(plain, h, jpeg.embed(values, BODY, 77, redundancy)[0])
        comment = b"X-Protection-Seed: 77"
        files += [jpeg.embed_table_seed(marked, 77), marked[:2] + b"\xff\xfe" + (len(comment) + 2).to_bytes(2, "big") + comment + marked[2:]]
    assert [verify.find_payload(f, b"key") for f in files] == [("Verified", BODY)] * 4
    table = spark.createDataFrame([(str(i), f) for i, f in enumerate([*files, plain])], "path string, content binary")
    got = {r.path: (r.payload_status, r.authenticated) for r in verify.verify_notices(table, b"key").collect()}
    assert got == {str(i): ("Verified", True) for i in range(4)} | {"4": ("NotFound", False)}


def test_webp_notice_fields(spark):
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    riff = lambda *c: b"RIFF" + struct.pack("<I", 4 + sum(map(len, c))) + b"WEBP" + b"".join(c)
    first = "<dc:rights><rdf:Alt><rdf:li xml:lang='x-default'>Old</rdf:li></rdf:Alt></dc:rights><xmpRights:WebStatement>http://w.example/</xmpRights:WebStatement><photoshop:Credit>C</photoshop:Credit>"
    second = "<dc:rights><rdf:Alt><rdf:li xml:lang='x-default'>Copyright (c) Zoë &amp; Co</rdf:li></rdf:Alt></dc:rights><dc:creator><rdf:Seq><rdf:li></rdf:li><rdf:li>A &lt;b&gt;</rdf:li></rdf:Seq></dc:creator><stegoeggo:LicensorURL>http://l.example/</stegoeggo:LicensorURL>"
    files = [("two", riff(chunk(b"XMP ", first.encode()), chunk(b"XMP ", second.encode()))), ("bad", riff(chunk(b"XMP ", first.encode()), chunk(b"XMP ", b"<dc:rights>\xff"))), ("none", riff(chunk(b"VP8X", bytes(10))))]
    got = {r.path: r for r in verify.verify_notices(spark.createDataFrame(files, "path string, content binary")).collect()}
    r = got["two"]
    assert (r.copyright_holder, r.creator, r.licensor_url, r.contact, r.rights_url, r.web_statement_of_rights) == ("Zoë & Co", "A <b>", "http://l.example/", None, "http://w.example/", "http://w.example/")
    assert (got["bad"].copyright_holder, got["bad"].contact, got["bad"].credit_line) == ("Old", "C", "C")
    assert [got[p].evidence_strength for p in ("two", "bad", "none")] == ["MetadataNoticeOnly", "MetadataNoticeOnly", "NoNoticeFound"]
