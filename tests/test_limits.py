"""Limits, frames in pixels, files above the limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rightsloom.functions import binary
from rightsloom.operators import carrier, containers, limits, verify
from rightsloom.sources import png


def test_limits_are_inclusive_and_named(spark):
    df = spark.createDataFrame([(1, 100, 16384, None), (2, 101, 16385, 9), (3, 5, 5, 5)], "id long, bytes long, width long, chunks long")
    facts = {"max_input_bytes": F.col("bytes"), "max_width": F.col("width"), "max_png_chunks": F.col("chunks")}
    got = {r.id: [(x.limit, x.observed, x.allowed, x.error) for x in r.v] for r in df.select("id", limits.exceeded(facts, limits.with_limits(max_input_bytes=100, max_png_chunks=8)).alias("v")).collect()}
    assert got == {1: [], 2: [("max_input_bytes", 101, 100, "InputTooLarge"), ("max_width", 16385, 16384, "DimensionsExceeded"), ("max_png_chunks", 9, 8, "ContainerLimitExceeded")], 3: []}
    assert len(limits.LIMITS) == 18
    with pytest.raises(ValueError, match="unknown"):
        limits.with_limits(max_files=1)


def test_container_facts_and_usage(spark):
    pixels = np.zeros((4, 4, 4), np.uint8)
    data = png.encode(pixels, png.text_chunk("Copyright", "x" * 50))
    files = spark.createDataFrame([("a.png", bytearray(data)), ("b.bin", bytearray(b"none"))], "path string, content binary")
    found = containers.chunks(files)
    facts = {r.path: r for r in limits.container_facts(found).collect()}
    assert list(facts) == ["a.png"] and facts["a.png"].max_png_chunks == 4 and facts["a.png"].max_png_chunk_bytes == 60 and facts["a.png"].max_jpeg_segments is None
    fields = spark.createDataFrame([("a.png", "x" * 50)], "path string, value string")
    (used,) = limits.usage(found, fields).collect()
    assert (used.parts, used.largest_part, used.fields, used.field_bytes) == (4, 60, 1, 50)


def test_files_above_the_limit_have_a_status_of_their_own(spark, monkeypatch):
    data = png.encode(np.zeros((4, 4, 4), np.uint8), png.text_chunk("Copyright", "Copyright (c) A"))
    files = spark.createDataFrame([("a.png", bytearray(data)), ("b.png", bytearray(data + bytes(5000)))], "path string, content binary")
    monkeypatch.setitem(limits.LIMITS, "max_input_bytes", 2000)
    got = {r.path: r.evidence_strength for r in verify.verify_notices(files).collect()}
    assert got == {"a.png": "MetadataNoticeOnly", "b.png": "InputTooLarge"}


def test_frames_in_pixels():
    pixels = np.random.default_rng(3).integers(0, 256, (64, 64, 4), dtype=np.uint8)
    marked = carrier.embed_framed(pixels, b"some payload", 77, 2)
    assert carrier.extract_framed(marked, 77, 2) == ("ok", b"some payload")
    assert carrier.extract_framed(marked, 78, 2)[0] == "bad_magic" and carrier.extract_framed(pixels[:2, :2], 77)[0] == "too_short"
    own = pixels.copy()
    assert carrier.embed_in_place(own, b"x" * 20, 5) and np.array_equal(own, carrier.embed(pixels, b"x" * 20, 5))
    before = own.copy()
    assert not carrier.embed_in_place(own, b"x" * 5000, 5) and np.array_equal(own, before) and carrier.embed(pixels, b"x" * 5000, 5) is None
    whole = binary.frame_bytes(b"abc")
    assert binary.unframe_bytes(whole) == ("ok", b"abc") and binary.unframe_bytes(whole[:-1])[0] == "bad_length" and binary.unframe_bytes(whole[:-1] + b"x")[0] == "bad_crc"


def test_frames_are_the_same_on_columns(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),)], "p binary")
    for r in df.select("p", binary.frame(F.col("p")).alias("f")).collect():
        assert bytes(r.f) == binary.frame_bytes(bytes(r.p))
