"""Manifests of the published shape, with real signatures, good and bad."""

import hashlib
import json
import zlib

from pyspark.sql import functions as F

from rightsloom.functions import ed25519
from rightsloom.operators import manifests
from rightsloom.plans import catalogue

A, B = bytes(range(32)), bytes(range(7, 39))
CONTENT = "image bytes"
CLAIM = {
    "claim_id": "00" * 16, "content_code": "iscc:KACT4EBWK27737D2", "created_at": 1700000000, "file_size": 524288, "format": "png", "height": 1080, "instance_digest": "sha256:" + hashlib.sha256(CONTENT.encode()).hexdigest(),
    "issuer_id": "dGVzdC1pc3N1ZXI", "notice_digest": "sha256:" + "ab" * 32, "rights_policy": 2, "schema_version": 1, "software": 'tool "x"/1 é', "width": 1920,
}


def canonical(claim: dict) -> bytes:
    return json.dumps({k: v for k, v in sorted(claim.items()) if k != "claim_id" and v is not None}, separators=(",", ":"), ensure_ascii=False).encode()


def manifest(secret=A, key_id=(97, 0xBB), over=None, claim=CLAIM, **other) -> dict:
    m = {
        "schema_version": 1, "claim": claim, "signatures": [{"algorithm": "ed25519", "key_id": list(key_id), "signature": ed25519.sign(secret, canonical(over or claim)).hex()}],
        "public_keys": [{"key_id": list(key_id), "algorithm": "ed25519", "key_bytes": ed25519.public_key(secret).hex()}], "embedded_reference": None,
    }
    return m | other


def test_check(spark):
    reference = {"payload_digest": "sha256:" + "cd" * 32, "payload_version": 3}
    twice = manifest()
    twice["signatures"] *= 2
    cases = {
        "VerifiedTrusted": manifest(), "VerifiedUntrusted": manifest(B, (98,), trust_metadata={"trust_model": "pki", "trusted": True, "reason": "says so"}),
        "SignatureFailure": manifest(over=CLAIM | {"width": 1}), "SignatureFailure 2": manifest(signatures=[{"algorithm": "ed25519", "key_id": [97, 0xBB], "signature": "ab" * 64}]),
        "SignatureFailure 3": manifest(signatures=[]), "KeyMaterialMismatch": manifest(B, (97, 0xBB)), "BindingFailure": manifest(claim=CLAIM | {"instance_digest": "sha256:" + "00" * 32}),
        "InvalidConfiguration": twice, "InvalidConfiguration 2": manifest(public_keys=[]), "InvalidConfiguration 3": {k: v for k, v in manifest().items() if k != "claim"},
        "InvalidConfiguration 4": manifest(claim={k: v for k, v in CLAIM.items() if k != "width"}), "EmbeddedReferenceFailure": manifest(embedded_reference=reference),
        "VerifiedTrusted 2": manifest(embedded_reference=reference),
    }
    rows = [(name, f"p{i}", json.dumps(m)) for i, (name, m) in enumerate(cases.items())]
    files = spark.createDataFrame([(f"p{i}", CONTENT) for i in range(len(cases))], "path string, content string")
    trusted = spark.createDataFrame([("61bb", ed25519.public_key(A).hex().upper())], "key_id string, public_key string")
    payloads = spark.createDataFrame([(f"p{len(cases) - 1}", "Verified", 3, reference["payload_digest"], None)], "path string, payload_status string, payload_version int, payload_digest string, authentication string")
    got = manifests.check(manifests.parse(spark.createDataFrame(rows, "id string, path string, json string")), files, "id", trusted, payloads).collect()
    assert {r.id: r.status for r in got} == {name: name.split(" ")[0] for name in cases}
    assert {r.status: r.exit_code for r in got} == {"VerifiedTrusted": 0, "VerifiedUntrusted": 4, "InvalidConfiguration": 2, "BindingFailure": 3, "SignatureFailure": 3, "EmbeddedReferenceFailure": 3, "KeyMaterialMismatch": 3}
    assert {r.id: r.embedded for r in got}["EmbeddedReferenceFailure"] == "Stripped"


def test_canonical_claim_is_sorted_compact_json(spark):
    for claim in (CLAIM, CLAIM | {"parent_claim_id": "cGFyZW50", "statement_uri": "https://x.example/a?b=1&c"}):
        parsed = manifests.parse(spark.createDataFrame([(json.dumps(manifest(claim=claim)),)], "json string"))
        assert parsed.select(manifests.canonical_claim(F.col("m.claim"))).first()[0].encode() == canonical(claim)


def test_checksums_against_a_plain_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = catalogue.crc_frame(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.crc, r.length, r.status) == (zlib.crc32(raw), 11 + len(raw), "ok")
