"""Plan resolution: defaults, validation and warnings of protection requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

# Channels by preset.
PRESETS = {"passthrough": (False, False), "metadata_only": (True, False), "metadata_and_payload": (True, True)}


def resolve(requests: DataFrame) -> DataFrame:
    """requests: request_id, preset, profile, policy, format, detected_format, seed, fallback_seed, authenticated (boolean),
    has_key (boolean), notice (boolean), constraints. Adds the effective format, seed, channels, warnings and error.

    Seeds and clocks are columns of the input, never drawn in the plan, so that a recomputed partition says the same.
    """
    table = F.create_map(*[x for n, (m, p) in PRESETS.items() for x in (F.lit(n), F.struct(F.lit(m).alias("metadata"), F.lit(p).alias("payload")))])
    channels = F.element_at(table, F.col("preset"))
    error = (
        F.when(channels.isNull(), "unknown_preset")
        .when(F.col("authenticated") & ~channels["payload"], "authentication_needs_payload")
        .when(F.col("authenticated") & ~F.col("has_key"), "authentication_needs_key")
    )
    warn = lambda where, name: F.when(where, F.lit(name))
    constrained = F.col("policy") == "ProhibitedSeeConstraints"
    warnings = F.array_compact(
        F.array(
            warn(channels["payload"] & ~F.col("has_key"), "MissingMacKey"),
            warn(~channels["metadata"], "MetadataInjectionDisabled"),
            warn(constrained & (F.coalesce("constraints", F.lit("")) == ""), "MissingRightsConstraints"),
            warn((F.col("policy") == "Allowed") & (F.coalesce("constraints", F.lit("")) != ""), "ContradictoryLegalClaims"),
        )
    )
    return requests.select(
        "request_id", "profile", F.coalesce("format", "detected_format").alias("format"), F.coalesce("seed", "fallback_seed").alias("seed"),
        channels["metadata"].alias("metadata"), channels["payload"].alias("payload"), warnings.alias("warnings"), error.alias("error"),
    )


def graded_warnings(resolved: DataFrame) -> DataFrame:
    """request_id, warning, category, severity: warnings meet the severity matrix by warning and profile."""
    each = resolved.select("request_id", "profile", F.explode("warnings").alias("warning"))
    matrix = F.broadcast(vocab.severities(resolved.sparkSession))  # eight warnings by four profiles
    return each.join(matrix, ["warning", "profile"]).select("request_id", "warning", "category", "severity")
