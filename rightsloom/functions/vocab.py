"""Vocabularies as literal dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The data-mining vocabulary (code, name, key, property), its namespace and its prefix of URIs.
POLICIES = (
    (0, "Unspecified", "DMI-UNSPECIFIED", "Iptc4xmpExt:DMI"),
    (1, "Allowed", "DMI-ALLOWED", "Iptc4xmpExt:DMI-Allowed"),
    (2, "ProhibitedAiMlTraining", "DMI-PROHIBITED-AIMLTRAINING", "Iptc4xmpExt:DMI-Prohibited"),
    (3, "ProhibitedGenAiMlTraining", "DMI-PROHIBITED-GENAIMLTRAINING", "Iptc4xmpExt:DMI-Prohibited"),
    (4, "ProhibitedExceptSearchEngineIndexing", "DMI-PROHIBITED-EXCEPTSEARCHENGINEINDEXING", "Iptc4xmpExt:DMI-Prohibited"),
    (5, "Prohibited", "DMI-PROHIBITED", "Iptc4xmpExt:DMI-Prohibited"),
    (6, "ProhibitedSeeConstraints", "DMI-PROHIBITED-SEECONSTRAINT", "Iptc4xmpExt:DMI-Prohibited"),
)
URI_PREFIX = "http://ns.useplus.org/ldf/vocab/"
PLUS_NAMESPACE = "http://ns.useplus.org/ldf/xmp/1.0/"
LEGACY_ATTRIBUTES = ("Iptc4xmpExt:DataMiningAttribute", "Iptc4xmpExt:DMI-Prohibited", "Iptc4xmpExt:DMI-Allowed", "Iptc4xmpExt:DMI")
# Keys of notices in text chunks and comments, and the field each one sets.
NOTICE_KEYS = {
    "Copyright": "copyright_holder", "Contact": "contact", "License": "license_url", "UsageTerms": "usage_terms", "AIConstraints": "ai_constraints",
    "WebStatementOfRights": "web_statement_of_rights", "Creator": "creator", "CreditLine": "credit_line", "CopyrightOwner": "copyright_owner",
    "LicensorName": "licensor_name", "LicensorEmail": "licensor_email", "LicensorURL": "licensor_url", "MetadataDate": "metadata_date", "NoticeAppliedAt": "notice_applied_at",
}
# Warnings, their categories, and severities by profile in the order of PROFILES.
PROFILES = ("LegalNotice", "LegalNoticeWithStego", "AuthenticatedProvenance", "Maximal")
WARNINGS = (
    ("MissingMacKey", "AuthenticatedProvenance", ("info", "info", "warning", "warning")),
    ("MetadataInjectionDisabled", "LegalNotice", ("error", "error", "warning", "warning")),
    ("ProgressiveJpegFallback", "FormatFragility", ("warning", "warning", "warning", "warning")),
    ("JpegReencodeFragile", "FormatFragility", ("warning", "warning", "warning", "warning")),
    ("LsbCapacitySkipped", "BestEffortStego", ("info", "warning", "warning", "warning")),
    ("DctCapacityInsufficient", "BestEffortStego", ("info", "warning", "warning", "warning")),
    ("ContradictoryLegalClaims", "LegalNotice", ("warning", "warning", "warning", "warning")),
    ("MissingRightsConstraints", "LegalNotice", ("error", "error", "error", "error")),
)
# What a fixture manifest may contain, and the least coverage.
FORMATS = ("png", "jpeg", "webp")
CATEGORIES = ("canonical", "legacy", "conflicting", "malformed", "preservation")
SOURCES = ("generated", "external", "historical", "generated-negative", "current-generated")


def policies(spark: SparkSession) -> DataFrame:
    rows = [(c, n, k, URI_PREFIX + k if c else None, p) for c, n, k, p in POLICIES]
    return spark.createDataFrame(rows, "code int, policy string, vocab_key string, vocab_uri string, property string")


def severities(spark: SparkSession) -> DataFrame:
    rows = [(w, c, p, s) for w, c, by in WARNINGS for p, s in zip(PROFILES, by, strict=True)]
    return spark.createDataFrame(rows, "warning string, category string, profile string, severity string")


def _lookup(value: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), value)


def policy_of_label(value: Column) -> Column:
    """Policy for one of the seven labels, exactly; null for anything else."""
    return F.when(value.isin(*[n for _, n, _, _ in POLICIES]), value)


def policy_of_key(value: Column) -> Column:
    return _lookup(value, {k: n for _, n, k, _ in POLICIES})


def policy_of_uri(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit(URI_PREFIX)), policy_of_key(F.substring(value, len(URI_PREFIX) + 1, 1000)))


def representation(value: Column) -> Column:
    """canonical_uri, bare_key or unknown."""
    return F.when(policy_of_uri(value).isNotNull(), "canonical_uri").when(policy_of_key(value).isNotNull(), "bare_key").when(value.isNotNull(), "unknown")


def normalise_policy(value: Column) -> Column:
    """Vocabulary key of a key, a URI or a display text; what is neither stays as it is. The order of the guesses counts."""
    key = F.when(F.startswith(value, F.lit(URI_PREFIX)), F.substring(value, len(URI_PREFIX) + 1, 1000)).otherwise(value)
    low = F.lower(value)
    has = lambda x: F.contains(low, F.lit(x))
    no = has("prohibited")
    return (
        F.when(key.isin(*[k for c, _, k, _ in POLICIES if c]), key)
        .when(no & has("search"), POLICIES[4][2])
        .when(no & has("gen") & has("ai"), POLICIES[3][2])
        .when(no & has("ai"), POLICIES[2][2])
        .when(no & has("see"), POLICIES[6][2])
        .when(no, POLICIES[5][2])
        .when(has("allowed") | has("permitted"), POLICIES[1][2])
        .otherwise(value)
    )
