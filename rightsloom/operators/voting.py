"""Votes over replicated bits and bytes, in relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_bits(votes: DataFrame, group: str, bit: str = "bit_idx", value: str = "bit") -> DataFrame:
    """group, bit, bit value: 1 where more than half of the replicas are 1; a tie is 0."""
    return votes.groupBy(group, bit).agg((F.sum(value) > F.floor(F.count("*") / 2)).cast("int").alias(value), F.count("*").alias("replicas"))


def bits_to_bytes(bits: DataFrame, group: str, bit: str = "bit_idx", value: str = "bit") -> DataFrame:
    """group, pos, byte: eight bits a byte, lowest first."""
    weight = F.expr(f"shiftleft(1, cast({bit} % 8 as int))") * F.col(value)
    return bits.groupBy(group, F.floor(F.col(bit) / 8).cast("long").alias("pos")).agg(F.sum(weight).cast("int").alias("byte"))


def byte_mode(copies: DataFrame, keys: list[str], value: str = "byte") -> DataFrame:
    """keys, value: the most frequent value; of equally frequent ones the largest."""
    counted = copies.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("votes"))


def first_valid(candidates: DataFrame, group: str, order: str = "ord", outcome: str = "outcome") -> DataFrame:
    """group, outcome, ord: the first valid candidate, else the first that says more than not found, else not found."""
    at = lambda where: F.min(F.when(where, F.struct(F.col(order).alias("ord"), F.col(outcome).alias("outcome"))))
    best = candidates.groupBy(group).agg(at(F.col(outcome) == "Valid").alias("valid"), at(F.col(outcome) != "NotFound").alias("other"))
    chosen = F.coalesce("valid", "other")
    return best.select(group, F.coalesce(chosen["outcome"], F.lit("NotFound")).alias("outcome"), chosen["ord"].alias("ord"))
