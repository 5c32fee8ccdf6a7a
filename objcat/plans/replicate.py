"""Mirroring one object store to another by key and size, without looking inside the objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.plans.transfer import EXISTS, MISSING, SIZE
from objcat.schema import count_where

REPLICATE, REVERIFY, SKIP = "replicate", "reverify", "skip"

# How much a run proves about objects that are already there.
VERIFY_MODES = ("checksum", "sample", "strict")


def _compared(src: DataFrame, dst: DataFrame, verify: str) -> DataFrame:
    if verify not in VERIFY_MODES:
        raise Refused(f"verify mode {verify!r} is not one of {VERIFY_MODES}")
    left = src.select(F.col("object_key").alias("key"), "size")
    right = dst.select(F.col("object_key").alias("_key"), F.col("size").alias("_size"))
    present = REVERIFY if verify == "strict" else SKIP
    action = (
        F.when(F.col("_key").isNull() | (F.col("_size") != F.col("size")), REPLICATE)
        .when(F.col("key").isNotNull(), present)
    )
    reason = (
        F.when(F.col("_key").isNull(), MISSING).when(F.col("_size") != F.col("size"), SIZE).otherwise(EXISTS)
    )
    joined = left.join(right, left["key"] == right["_key"], "full_outer")
    return joined.withColumn("action", F.when(F.col("key").isNotNull(), action)).withColumn("reason", reason)


def replicate_plan(src: DataFrame, dst: DataFrame, verify: str = "checksum") -> DataFrame:
    """replicate (missing or other size), reverify (strict) or skip per source object; nothing is deleted."""
    return _compared(src, dst, verify).filter(F.col("key").isNotNull()).select("action", "key", "size", "reason")


def replicate_summary(src: DataFrame, dst: DataFrame, verify: str = "checksum") -> DataFrame:
    """Counts, bytes to write, bytes that leave the source, and objects only the destination holds."""
    action, size = F.col("action"), F.col("size")
    zero = F.lit(0).cast("long")
    return _compared(src, dst, verify).agg(
        F.count("key").alias("objects"),
        count_where(action == REPLICATE).alias("replicated"),
        count_where(action == REVERIFY).alias("reverified"),
        count_where(action == SKIP).alias("skipped"),
        F.coalesce(F.sum(F.when(action == REPLICATE, size)), zero).alias("bytes"),
        F.coalesce(F.sum(F.when(action.isin(REPLICATE, REVERIFY), size)), zero).alias("egress_bytes"),
        count_where(F.col("key").isNull()).alias("extra"),
    )
