"""Exact dedup: groups by a 128-bit content hash, bytes compared inside groups, smallest id kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, bounded_broadcast, written

#: Rows of a broadcast list of repeated hashes: 16 bytes each, 32 MB at most. Beyond it the lists are shuffled.
MAX_BROADCAST_HASHES = 2_000_000


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty. Only runs that change are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of equal texts the smallest doc_id stays.
    Null or empty texts form one group. A null doc_id never stays while its group has another; in a group of
    nulls only, keep_id is null and its rows are kept. Rows that repeat doc_id and text get the same answer.
    An empty table gives an empty result. Other columns are not read.

    The hash decides which texts may be equal. Groups of two or more then are formed anew over (hash, text),
    so equal bytes are compared and a hash collision can't merge texts. Hot groups collapse in the map-side
    aggregation, and joining their members back uses a broadcast of at most a thousand rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = base.select("doc_id", hash_fn(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = written(keyed, "exact_rows")
    repeated = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact_repeated")
    suspects = bounded_broadcast(repeated, repeated.count(), MAX_BROADCAST_HASHES)
    members = base.withColumn("h", hash_fn(F.col("norm"))).join(suspects, "h", "left_semi")
    classes = members.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = written(classes.select(F.concat("h", F.unhex(F.sha2("norm", 256))).alias("g"), "keep_id", "group_size"), "exact_classes")
    rows = rows.withColumn("g", F.concat("h", "sha"))
    out = attach_groups(rows, classes, "g", "group_size", rows.count(), F.unhex(F.md5(F.concat(F.lit("row"), F.col("sha"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
