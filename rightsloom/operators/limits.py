"""Resource limits as predicates over observed facts, and usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The eighteen limits and their defaults, by name.
LIMITS = {
    "max_input_bytes": 100 * 1024 * 1024, "max_width": 16384, "max_height": 16384, "max_png_chunks": 500, "max_png_chunk_bytes": 16 * 1024 * 1024, "max_jpeg_segments": 256,
    "max_jpeg_segment_bytes": 65535, "max_webp_riff_chunks": 500, "max_webp_riff_bytes": 16 * 1024 * 1024, "max_xmp_bytes": 65535, "max_xml_depth": 32, "max_xml_properties": 256,
    "max_metadata_fields": 64, "max_metadata_field_bytes": 8192, "max_payload_bytes": 256, "max_detached_manifest_bytes": 1024 * 1024, "max_tile_extraction_origins": 16,
    "max_verification_seeds": 32,
}
#: What kind of error a limit gives when it is exceeded.
ERRORS = {"max_input_bytes": "InputTooLarge", "max_width": "DimensionsExceeded", "max_height": "DimensionsExceeded"}
SIZES = ("max_xmp_bytes", "max_metadata_field_bytes", "max_payload_bytes", "max_detached_manifest_bytes")


def with_limits(**own: int) -> dict[str, int]:
    """The defaults with some limits changed; an unknown name is an error."""
    if unknown := own.keys() - LIMITS.keys():
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    return LIMITS | own


def error_of(limit: str) -> str:
    return ERRORS.get(limit, "MetadataLimitExceeded" if limit in SIZES else "ContainerLimitExceeded")


def exceeded(facts: dict[str, Column], limits: dict[str, int] = LIMITS) -> Column:
    """Array of struct(limit, observed, allowed, error) for facts (by limit name) that are above their limits. A limit is
    inclusive; what wasn't observed (null) exceeds nothing."""
    found = [
        F.when(c > limits[name], F.struct(F.lit(name).alias("limit"), c.cast("long").alias("observed"), F.lit(limits[name]).cast("long").alias("allowed"), F.lit(error_of(name)).alias("error")))
        for name, c in facts.items()
    ]
    return F.array_compact(F.array(*found))


def container_facts(chunks: DataFrame) -> DataFrame:
    """path, and by limit name what the walk of a container found: numbers of parts and the largest one of each kind."""
    aggs = []
    for kind, count, largest in (("png", "max_png_chunks", "max_png_chunk_bytes"), ("jpeg", "max_jpeg_segments", "max_jpeg_segment_bytes"), ("webp", "max_webp_riff_chunks", "max_webp_riff_bytes")):
        of = F.col("format") == kind
        aggs += [F.nullif(F.count_if(of), F.lit(0).cast("long")).alias(count), F.max(F.when(of, F.col("length"))).alias(largest)]
    return chunks.groupBy("path").agg(*aggs)


def usage(chunks: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """path, parts, part_bytes, largest_part and, from fields (path, value), fields and field_bytes: work seen, not estimated."""
    out = chunks.groupBy("path").agg(F.count("*").alias("parts"), F.sum("length").alias("part_bytes"), F.max("length").alias("largest_part"))
    if fields is not None:
        seen = fields.groupBy("path").agg(F.count("*").alias("fields"), F.sum(F.octet_length("value")).alias("field_bytes"))
        out = out.join(seen, "path", "left").na.fill(0, ["fields", "field_bytes"])
    return out
