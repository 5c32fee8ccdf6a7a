"""Backup and restore plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths
from objcat.operators.filters import FilterSet
from objcat.operators.preflight import BLOCKING, nfc_collisions
from objcat.plans.transfer import EXISTS
from objcat.schema import count_where

STORE, RESTORE, OVERWRITE, SKIP = "store", "restore", "overwrite", "skip"


def scan_native(native: DataFrame) -> DataFrame:
    """A native listing with its logical `path`, or the `problem` that keeps a name from having one."""
    name = F.col("native")
    parts = paths.components(name)
    problem = F.when(name.contains("\\"), "separator").when(F.array_contains(parts, ".."), "parent-dir")
    logical = paths.nfc(F.when(problem.isNull(), F.array_join(F.array_remove(parts, "."), "/")))
    return native.select("*", logical.alias("path"), problem.alias("problem"))


def backup_plan(native: DataFrame, target: str, filters: FilterSet = FilterSet()) -> DataFrame:
    """Store every admitted file under `target`, except files whose names fall together once composed.

    `native` rows: native, size, mtime.
    """
    kept = filters.admits_enumerated(scan_native(native).filter(F.col("problem").isNull()))
    clashing = nfc_collisions(kept.select("native", F.col("path").alias("logical"))).select(
        F.col("logical").alias("path")
    )
    return (
        kept.join(clashing, "path", "left_anti")
        .select(
            F.lit(STORE).alias("action"),
            F.col("native").alias("source"),
            paths.join_path(F.lit(target), F.col("path")).alias("dest"),
            "size",
        )
        .orderBy("dest")
    )


def backup_counts(native: DataFrame, filters: FilterSet = FilterSet()) -> DataFrame:
    """Files seen, filtered out, and refused for their name."""
    scanned = filters.flag(scan_native(native), "_kept")
    pruned = filters.pruned_above(F.col("path"))
    kept = F.col("_kept") if pruned is None else F.col("_kept") & ~pruned
    good = F.col("problem").isNull()
    return scanned.agg(
        F.count(F.lit(1)).alias("seen"),
        count_where(good & ~kept).alias("filtered"),
        count_where(~good).alias("problems"),
    )


def restore_plan(
    catalog: DataFrame,
    existing: DataFrame,
    findings: DataFrame,
    destination: str,
    remote: str,
    target: str = "",
    filters: FilterSet = FilterSet(),
) -> DataFrame:
    """restore, overwrite (something is there), or skip (a blocking finding), by destination.

    `existing` and `findings` carry paths relative to the target. An unmeasured size stays NULL.
    """
    inside = catalog.filter(paths.is_under(target, "path")).withColumn("_logical", F.col("path"))
    inside = filters.admit(inside.withColumn("path", paths.relative_to(target, "path")))
    blocked = findings.filter(F.col("severity") == BLOCKING).select(F.col("path").alias("_blocked")).distinct()
    there = existing.select(F.col("path").alias("_there")).distinct()
    joined = inside.join(blocked, inside["path"] == blocked["_blocked"], "left")
    joined = joined.join(there, inside["path"] == there["_there"], "left")
    action = F.when(F.col("_blocked").isNotNull(), SKIP).when(F.col("_there").isNotNull(), OVERWRITE).otherwise(RESTORE)
    reason = F.when(F.col("_blocked").isNotNull(), BLOCKING).when(F.col("_there").isNotNull(), EXISTS)
    return joined.select(
        action.alias("action"),
        F.concat(F.lit(remote + ":"), "_logical").alias("source"),
        paths.join_path(F.lit(destination.rstrip("/")), F.col("path")).alias("dest"),
        "size",
        reason.alias("reason"),
    ).orderBy("dest")


def overwrites(plan: DataFrame) -> DataFrame:
    """How many rows would replace something."""
    return plan.agg(count_where(F.col("action") == OVERWRITE).alias("overwrites"))


def gate_overwrites(plan: DataFrame, overwrite: bool = False, immutable: bool = False) -> DataFrame:
    """The plan itself, or a refusal when it would replace files without being asked to."""
    count = overwrites(plan).first()["overwrites"]
    if count and immutable:
        raise Refused(f"immutable, but the restore would replace {count} existing files")
    if count and not overwrite:
        raise Refused(f"the restore would replace {count} existing files")
    return plan
