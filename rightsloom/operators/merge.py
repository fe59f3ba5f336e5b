"""Update policies for metadata fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLACE_OWNED, PRESERVE_EXISTING, FAIL_ON_CONFLICT = "replace_owned", "preserve_existing", "fail_on_conflict"


def merge_fields(existing: DataFrame, new: DataFrame, owned: list[str], policy: str = REPLACE_OWNED) -> DataFrame:
    """asset, pos, key, value after an update; existing and new have these columns, owned names the updater's keys.

    replace_owned drops owned fields and adds the new ones; preserve_existing adds only keys that the asset lacks;
    fail_on_conflict gives an asset with owned fields back as it is, with error set. New fields follow old ones.
    """
    old, fresh = existing.withColumn("origin", F.lit("existing")), new.withColumn("origin", F.lit("new"))
    nothing = F.lit(None).cast("string")
    if policy == REPLACE_OWNED:
        return old.where(~F.col("key").isin(*owned)).unionByName(fresh).withColumn("error", nothing)
    if policy == PRESERVE_EXISTING:
        added = fresh.join(existing.select("asset", "key").distinct(), ["asset", "key"], "left_anti")
        return old.unionByName(added.select(*old.columns)).withColumn("error", nothing)
    if policy != FAIL_ON_CONFLICT:
        raise ValueError(policy)
    conflict = existing.where(F.col("key").isin(*owned)).select("asset").distinct().withColumn("error", F.lit("conflict"))
    kept = old.join(conflict, "asset", "left").select(*old.columns, "error")
    return kept.unionByName(fresh.join(conflict, "asset", "left_anti").withColumn("error", nothing))


def ordered_distinct(rows: DataFrame, group: str, order: str, value: str, without: list[str] = ()) -> DataFrame:
    """First occurrence of each value in a group, without the given values, in order."""
    kept = rows.where(~F.col(value).isin(*without)) if without else rows
    return kept.groupBy(group, value).agg(F.min(order).alias(order))
