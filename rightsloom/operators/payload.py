"""Payload codec and integrity."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binary import V3_MAGIC, unsigned

# Least sizes of payload versions, and limits of version 3.
V1_SIZE, V2_SIZE, V3_HEADER, V3_MAX, MAX_KEY_ID, MAX_POLICY = 24, 32, 32, 256, 32, 6
ALGORITHMS = ("none", "crc32", "hmac_sha256_64", "hmac_sha256_128")


def payload_version(data: Column) -> Column:
    first = F.hex(F.substring(data, 1, 1))
    return F.when(F.hex(F.substring(data, 1, 3)) == V3_MAGIC, 3).when(first == "02", 2).when(first == "01", 1)


def parse_payload(data: Column) -> dict[str, Column]:
    """version, level, seed, intensity, timestamp (1, 2), header fields (3), error: null or the first thing wrong."""
    v, size = payload_version(data), F.octet_length(data)
    old, new = v < 3, v == 3
    total, header, policy, tag, key = (unsigned(data, o, w) for o, w in ((4, 2), (3, 1), (10, 1), (30, 1), (31, 1)))
    error = (
        F.when(v.isNull(), F.when(size >= 2, "invalid_magic").otherwise("too_short"))
        .when((v == 1) & (size < V1_SIZE) | (v == 2) & (size < V2_SIZE) | new & (size < V3_HEADER), "too_short")
        .when(new & ((header < V3_HEADER) | (total > V3_MAX) | (total < header)), "invalid_length")
        .when(new & (size < total), "truncated")
        .when(new & (policy > MAX_POLICY), "invalid_policy")
        .when(new & (unsigned(data, 29, 1) >= len(ALGORITHMS)), "unknown_algorithm")
        .when(new & (key > MAX_KEY_ID), "key_id_too_long")
        .when(new & (V3_HEADER + key + tag > total), "invalid_length")
    )
    seed = F.when(old, unsigned(data, 2, 8)).when(new, unsigned(data, 11, 8))
    return {
        "version": v, "error": error, "level": F.when(old, unsigned(data, 1, 1)), "seed": seed,
        "intensity": F.when(old, unsigned(data, 10, 2)).when(new, unsigned(data, 19, 2)) / 100,
        "timestamp": F.when(old, unsigned(data, 12, 8)), "total_length": F.when(new, total), "flags": F.when(new, unsigned(data, 6, 2)),
        "channels": F.when(new, unsigned(data, 8, 2)), "dmi_policy": F.when(new, policy), "algorithm": F.when(new, F.get(F.array(*map(F.lit, ALGORITHMS)), unsigned(data, 29, 1).cast("int"))),
        "content_hash": F.when(new, F.lower(F.hex(F.substring(data, 22, 8)))), "tag_length": F.when(new, tag), "key_id_length": F.when(new, key),
    }


def checksum(data: Column) -> Column:
    return F.crc32(data)


def hmac_tag(key: bytes, length: int = 16):
    """Function of a binary column: its HMAC-SHA256 (RFC 2104), cut to a length, in hex. The key is a literal of the plan."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(c ^ pad for c in block).hex())) for pad in (0x36, 0x5C))

    def tag(data: Column) -> Column:
        return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256), 1, 2 * length)

    return tag


def integrity(algorithm: Column, crc_matches: Column, hmac_matches: Column, has_key: Column) -> Column:
    """Verified, AuthFailed, KeyMissing or Invalid. A checksum never counts as authentication."""
    keyed = F.startswith(algorithm, F.lit("hmac"))
    return F.when(keyed & ~has_key, "KeyMissing").when(keyed, F.when(hmac_matches, "Verified").otherwise("AuthFailed")).when((algorithm == "crc32") & crc_matches, "Verified").otherwise("Invalid")
