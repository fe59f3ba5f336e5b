"""Detached manifests: JSON with claims, keys and signatures, checked against files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from ..session import prepare

# Size and count limits of manifests, and statuses with their exit codes, worst first.
MAX_BYTES, MAX_ITEMS, MAX_KEY_ID = 64 << 10, 16, 64
STATUSES = (
    ("InvalidConfiguration", 2), ("BindingFailure", 3), ("KeyMaterialMismatch", 3), ("SignatureFailure", 3), ("EmbeddedReferenceFailure", 3),
    ("VerifiedTrusted", 0), ("VerifiedUntrusted", 4),
)
# The fields of a claim, by name, with their types; the last two of those marked may be missing.
CLAIM = {
    "claim_id": "string", "content_code": "string", "created_at": "long", "file_size": "long", "format": "string", "height": "long", "instance_digest": "string", "issuer_id": "string",
    "notice_digest": "string", "parent_claim_id": "string", "rights_policy": "int", "schema_version": "int", "software": "string", "statement_uri": "string", "width": "long",
}
OPTIONAL = ("parent_claim_id", "statement_uri")
SCHEMA = (
    f"schema_version int, claim struct<{','.join(f'{k}:{v}' for k, v in CLAIM.items())}>, signatures array<struct<algorithm:string,key_id:array<int>,signature:string>>, "
    "public_keys array<struct<key_id:array<int>,algorithm:string,key_bytes:string>>, embedded_reference struct<payload_digest:string,payload_version:int>, "
    "trust_metadata struct<trust_model:string,trusted:boolean,reason:string,certificate_chain:array<string>>"
)


def key_id_bytes(key_id: Column) -> Column:
    """A key id as JSON has it, an array of bytes, as lowercase hex."""
    return F.array_join(F.transform(key_id, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), "")


def parse(manifests: DataFrame, json: str = "json") -> DataFrame:
    """All columns, with m (the parsed manifest) and error: too_large, malformed or too_many.

    A manifest is malformed if it isn't JSON of its shape, or lacks a field that isn't optional. Key ids are hex here.
    """
    m = F.from_json(F.when(F.octet_length(json) <= MAX_BYTES, F.col(json)), SCHEMA)
    out = manifests.withColumn("m", m)
    lacks = F.col("m.claim").isNull() | F.col("m.schema_version").isNull() | F.col("m.signatures").isNull() | F.col("m.public_keys").isNull()
    for c in CLAIM:
        if c not in OPTIONAL:
            lacks = lacks | F.col(f"m.claim.{c}").isNull()
    many = (F.size("m.signatures") > MAX_ITEMS) | (F.size("m.public_keys") > MAX_ITEMS)
    out = out.withColumn("error", F.when(F.octet_length(json) > MAX_BYTES, "too_large").when(F.coalesce(lacks, F.lit(True)), "malformed").when(many, "too_many"))
    hexed = lambda items: F.transform(F.col(f"m.{items}"), lambda x: x.withField("key_id", key_id_bytes(x["key_id"])))
    return out.withColumn("m", F.col("m").withField("signatures", hexed("signatures")).withField("public_keys", hexed("public_keys")))


def canonical_claim(claim: Column) -> Column:
    """Compact JSON of the claim's fields by name, without its id and without nulls; numbers stay numbers."""
    return F.to_json(F.struct(*[claim[c].alias(c) for c in CLAIM if c != "claim_id"]))


def violations(parsed: DataFrame, id_col: str) -> DataFrame:
    """id, rule: key ids empty, too long or twice; hex of wrong length; signatures twice or by keys that aren't listed."""
    keys = parsed.select(id_col, F.posexplode("m.public_keys").alias("pos", "k")).select(id_col, "pos", "k.*")
    sigs = parsed.select(id_col, F.posexplode("m.signatures").alias("pos", "s")).select(id_col, "pos", "s.*")
    hexed = lambda c, n: F.coalesce(F.col(c), F.lit("")).rlike(f"^[0-9a-fA-F]{{{n}}}$")
    ids = keys.select(id_col, "key_id").unionByName(sigs.select(id_col, "key_id"))
    rules = [
        keys.where(~hexed("key_bytes", 64)).select(id_col, F.lit("bad_public_key").alias("rule")),
        ids.where(F.coalesce(F.length("key_id"), F.lit(0)) == 0).select(id_col, F.lit("empty_key_id").alias("rule")),
        ids.where(F.length("key_id") > 2 * MAX_KEY_ID).select(id_col, F.lit("key_id_too_long").alias("rule")),
        keys.groupBy(id_col, "key_id").count().where("count > 1").select(id_col, F.lit("duplicate_key_id").alias("rule")),
        sigs.where(~hexed("signature", 128)).select(id_col, F.lit("bad_signature").alias("rule")),
        sigs.groupBy(id_col, "algorithm", "key_id").count().where("count > 1").select(id_col, F.lit("duplicate_signature").alias("rule")),
        sigs.join(keys.select(id_col, "key_id"), [id_col, "key_id"], "left_anti").select(id_col, F.lit("unknown_key").alias("rule")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.distinct()


def overall_status(config: Column, binding: Column, keys: Column, signature: Column, embedded: Column, trusted: Column) -> Column:
    """The worst of what failed, in the order of STATUSES; else whether a trusted key signed."""
    out = None
    for flag, (name, _) in zip((config, binding, keys, signature, embedded), STATUSES, strict=False):
        out = F.when(flag, name) if out is None else out.when(flag, name)
    return out.otherwise(F.when(trusted, "VerifiedTrusted").otherwise("VerifiedUntrusted"))


def exit_code(status: Column) -> Column:
    return F.element_at(F.create_map(*[x for s, c in STATUSES for x in (F.lit(s), F.lit(c))]), status)


def embedded_status(reference: Column, status: Column, version: Column, digest: Column, authentication: Column) -> Column:
    """What became of the payload that a manifest refers to. status: how the file's payload verified (Verified, Invalid, NotFound
    or null); authentication: of an invalid HMAC payload, whether the key was missing or wrong."""
    return (
        F.when(reference.isNull(), "NotProvided").when(status.isNull() | (status == "NotFound"), "Stripped")
        .when(status == "Invalid", F.coalesce(authentication, F.lit("Malformed")))
        .when(version != reference["payload_version"], "VersionMismatch").when(digest.isNull(), "Malformed")
        .when(digest != reference["payload_digest"], "DigestMismatch").otherwise("PresentValid")
    )


def check(parsed: DataFrame, files: DataFrame, id_col: str, trusted: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """id, path, status, embedded, exit_code: manifests against the files at their path and the caller's keys.

    files: path, content. trusted: key_id (hex), public_key (hex): the caller's keys, the only ones that are trusted; the
    manifest's own claims of trust count for nothing. A manifest that breaks a rule, or has no file, is InvalidConfiguration. The
    claim's instance_digest must be the file's; a caller's key whose id the manifest gives to another key is a
    KeyMaterialMismatch; a signature by any listed key must hold over the canonical claim. payloads (path, payload_status,
    payload_version, payload_digest, authentication) tells what the files carry; without it a referred payload counts as
    stripped. Paths, ids and key ids are unique by rule; of several files at a path each gives a row.
    """
    seen = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("seen"))
    broken = violations(parsed, id_col).groupBy(id_col).agg(F.count("*").alias("rules"))
    signed = signature_results(parsed, id_col, trusted).groupBy(id_col).agg(
        F.bool_or("valid").alias("valid"), F.bool_or(F.col("valid") & F.col("trusted")).alias("trusted"), F.bool_or(~F.col("key_material_matched")).alias("mismatch")
    )
    j = parsed.join(seen, "path", "left").join(broken, id_col, "left").join(signed, id_col, "left")
    none = F.lit(None).cast("string")
    embedded = embedded_status(F.col("m.embedded_reference"), none, none, none, none)
    if payloads is not None:
        j = j.join(payloads, "path", "left")
        embedded = embedded_status(F.col("m.embedded_reference"), F.col("payload_status"), F.col("payload_version"), F.col("payload_digest"), F.col("authentication"))
    j = j.withColumn("embedded", F.when(F.col("error").isNull(), embedded).otherwise("NotProvided"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = overall_status(
        F.col("error").isNotNull() | F.col("seen").isNull() | F.col("rules").isNotNull(), F.col("seen") != F.col("m.claim.instance_digest"), yes("mismatch"), ~yes("valid"),
        ~F.col("embedded").isin("NotProvided", "PresentValid"), yes("trusted"),
    )
    return j.select(id_col, "path", status.alias("status"), "embedded").withColumn("exit_code", exit_code(F.col("status")))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, messages, signatures = (batch.column(c).to_pylist() for c in ("public_key", "message", "signature"))
        valid = [None not in x and ed25519.verify(x[0], x[1], x[2]) for x in zip(keys, messages, signatures, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(valid, pa.bool_())], [*batch.schema.names[:4], "valid"])


def signature_results(parsed: DataFrame, id_col: str, trusted: DataFrame) -> DataFrame:
    """id, key_id, trusted, key_material_matched, valid: a row per signature, checked over its manifest's canonical claim.

    A key from the caller's table (key_id, public_key, both hex) takes the place of the manifest's own key of that id; only
    such keys are trusted, and only where the manifest's own key, if it lists one, is the same. Without a key, or with hex that can't
    be read, a signature isn't valid. The rows are dealt by key, so that a task reads a key once, but evenly where
    one key signs most.
    """
    spark = parsed.sparkSession
    prepare(spark)
    message = canonical_claim(F.col("m.claim")).cast("binary")
    sigs = parsed.select(id_col, message.alias("message"), F.explode("m.signatures").alias("s")).select(id_col, "message", "s.key_id", "s.algorithm", "s.signature")
    own = parsed.select(id_col, F.explode("m.public_keys").alias("k")).select(id_col, F.col("k.key_id").alias("key_id"), F.when(F.col("k.algorithm") == "ed25519", F.lower("k.key_bytes")).otherwise("").alias("own")).dropDuplicates([id_col, "key_id"])
    mine = trusted.select(F.lower("key_id").alias("key_id"), F.lower("public_key").alias("mine")).dropDuplicates(["key_id"])
    both = sigs.join(own, [id_col, "key_id"], "left").join(mine, "key_id", "left")
    unhexed = lambda c: F.try_to_binary(c, F.lit("hex"))
    matched = F.col("mine").isNull() | F.col("own").isNull() | (F.col("mine") == F.col("own"))
    narrow = both.select(
        id_col, "key_id", (F.col("mine").isNotNull() & matched).alias("trusted"), matched.alias("key_material_matched"),
        unhexed(F.coalesce("mine", "own")).alias("public_key"), "message", F.when(F.col("algorithm") == "ed25519", unhexed(F.col("signature"))).alias("signature"),
    )
    # verifying is the cost, not the rows: they are spread over all tasks, some thousand of a key going together
    narrow = narrow.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "public_key", F.pmod(F.xxhash64(id_col), F.lit(64)))
    return narrow.mapInArrow(_verified, f"{id_col} {parsed.schema[id_col].dataType.simpleString()}, key_id string, trusted boolean, key_material_matched boolean, valid boolean")
