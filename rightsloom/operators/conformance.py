"""Corpus-level operators: manifests, digests, coverage, comparison of extractions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab

# Least numbers for coverage.
MINIMUMS = {
    "canonical_png": 1, "canonical_jpeg": 1, "canonical_webp": 1, "legacy": 3, "legacy_formats": 2, "conflicting": 3, "malformed": 4, "malformed_png": 1, "malformed_jpeg": 1,
    "malformed_webp": 1, "preservation": 3, "preservation_formats": 3, "external_canonical_png": 1, "external_canonical_jpeg": 1, "external_canonical_webp": 1, "external_legacy": 1,
    "external_conflicting": 1, "external_preservation": 1,
}


def typed_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def manifest_violations(manifest: DataFrame, order: str = "pos") -> DataFrame:
    """One row (id, path, rule) per broken rule. Of equal ids or paths all but the first in order are duplicates."""
    later = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(order)) > 1
    rules = {
        "empty_id": F.col("id") == "", "duplicate_id": F.col("_later_id"), "duplicate_path": F.col("_later_path"),
        "absolute_path": F.col("path").rlike(r"^[/\\]"), "path_traversal": F.contains("path", F.lit("..")),
        "unsupported_format": ~F.col("format").isin(*vocab.FORMATS), "unsupported_category": ~F.col("category").isin(*vocab.CATEGORIES),
        "unsupported_source": ~F.col("source").isin(*vocab.SOURCES), "empty_sha256": F.col("sha256") == "",
        "invalid_sha256": (F.col("sha256") != "") & ~F.col("sha256").rlike("^[0-9a-fA-F]{64}$"),
        "missing_tool_version": (F.col("source") == "external") & (F.col("authoring_tool_version") == ""),
    }
    checked = manifest.withColumn("_later_id", later("id")).withColumn("_later_path", later("path"))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return checked.select("id", "path", F.explode(broken).alias("rule"))


def digest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Expected against observed digests; a missing file has the empty digest. files: path, content."""
    seen = files.select(F.col("path"), F.sha2("content", 256).alias("seen"))
    observed = F.coalesce("seen", F.lit(""))
    return manifest.join(seen, "path", "left").select("id", "path", F.col("sha256").alias("expected"), observed.alias("observed"), (observed == F.col("sha256")).alias("matches"))


def coverage(manifest: DataFrame, minimums: dict[str, int] = MINIMUMS) -> DataFrame:
    """measure, observed, minimum, met: all counts in one pass over the manifest."""
    aggs = {}
    for name in minimums:
        rest = name.removeprefix("external_")
        where = F.col("source") == "external" if rest != name else F.lit(True)
        category, _, kind = rest.partition("_")
        where = where & (F.col("category") == category)
        aggs[name] = F.countDistinct(F.when(where, F.col("format"))) if kind == "formats" else F.count_if(where & (F.col("format") == kind) if kind else where)
    counted = manifest.agg(*[c.alias(n) for n, c in aggs.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("observed"), F.lit(m).cast("long").alias("minimum")) for n, m in minimums.items()]))
    return counted.select(rows.alias("r")).select("r.*").withColumn("met", F.col("observed") >= F.col("minimum"))


def compare_extractions(internal: DataFrame, external: DataFrame, normal: Column | None = None) -> DataFrame:
    """fixture, field, severity from two tables (fixture, field, value): equal passes, different fails, one side warns.

    Text is compared in normal form: white space and Unicode, URLs by scheme and host. A fixture with non-ASCII
    text whose external tool is known to recode it (named canonical_unicode) warns instead of failing.
    """
    key = lambda c: F.when(F.col("field").contains("url"), text.normalise_url(c)).otherwise(text.mostly_ascii_nfc(text.normalise_space(c)))
    i = internal.select("fixture", "field", F.col("value").alias("internal"), key(F.col("value")).alias("_ni"))
    e = external.select("fixture", "field", F.col("value").alias("external"), key(F.col("value")).alias("_ne"))
    both = i.join(e, ["fixture", "field"], "full")
    recoded = F.contains("fixture", F.lit("canonical_unicode")) & F.col("field").isin("copyright", "usage_terms") & (F.length("internal") != F.length("external")) & (F.col("internal") != "") & (F.col("external") != "")
    severity = (
        F.when(F.col("internal").isNull() & F.col("external").isNull(), "Pass")
        .when(F.col("internal").isNull() | F.col("external").isNull(), "Warn")
        .when(F.col("_ni") == F.col("_ne"), "Pass")
        .when(recoded, "Warn")
        .otherwise("Fail")
    )
    return both.select("fixture", "field", "internal", "external", severity.alias("severity"))


def reports(checks: DataFrame) -> DataFrame:
    """fixture, format, passed: a report passes without any failed check. checks: fixture, format, severity."""
    return checks.groupBy("fixture", "format").agg(F.bool_and(F.col("severity") != "Fail").alias("passed"))


def summary(report: DataFrame) -> DataFrame:
    """format (null: all), total, passed, failed."""
    return report.rollup("format").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def count_by_tool(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("authoring_tool").agg(F.count("*").alias("n"))
