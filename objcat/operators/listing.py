"""Listings and roll-ups of an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths, units
from objcat.operators.bounded import counted_with_first
from objcat.operators.filters import FilterSet
from objcat.operators.ordered import with_position
from objcat.schema import count_where, measured_total, total_or_null, unmeasured, unmeasured_count

# Rows shown by name in a report before the rest is only counted.
LINK_SAMPLE = 64
SPECIAL_SAMPLE = 16

# What a size is the size of.
SIZE_BASES = ("plaintext", "stored")


def ls(inv: DataFrame, root: str = "") -> DataFrame:
    """Size and path of every object, in byte order of the path."""
    return inv.orderBy("path").select("size", paths.relative_to(root, "path").alias("path"))


def lsl(inv: DataFrame, root: str = "") -> DataFrame:
    """`ls` with the modification time."""
    return inv.orderBy("path").select(
        "size", units.rfc3339("mtime").alias("modified"), paths.relative_to(root, "path").alias("path")
    )


def _folders(inv: DataFrame, root: str, deepest: int | None) -> DataFrame:
    """Objects and bytes per directory that directly holds some, cut at `deepest` components.

    Rows are reduced by directory before anything is multiplied by depth, so a directory with most of the
    objects is combined where it is read, and the roll-up above it handles few rows.
    """
    above = paths.parent(paths.relative_to(root, "path"))
    odd = above.startswith("/") | above.contains("//")
    folder = F.when(odd, F.array_join(paths.components(above), "/")).otherwise(above)
    if deepest is not None:
        folder = F.substring_index(folder, "/", deepest) if deepest > 0 else F.lit("")
    return (
        inv.select(folder.alias("folder"), "size")
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("objects"),
            F.count("size").alias("measured"),
            F.sum("size").alias("bytes"),
        )
    )


def _up(folders: DataFrame, columns: list) -> DataFrame:
    """Every directory at or above each folder (not the root), with the folder's figures."""
    levels = F.array_remove(F.concat(paths.directories("folder"), F.array("folder")), "")
    return folders.select(F.explode(levels).alias("dir"), *columns)


def _subtree_bytes():
    whole = F.sum("measured") == F.sum("objects")
    return F.when(whole, F.coalesce(F.sum("bytes"), F.lit(0).cast("long")))


def lsd(inv: DataFrame, depth: int | None = 1, root: str = "") -> DataFrame:
    """Directories down to `depth` (None: all) with objects and bytes of the whole subtree, parents first.

    Bytes are NULL once one member is unmeasured; objects directly under the root make no directory.
    """
    base = root.rstrip("/")
    full = paths.join_path(F.lit(base), F.col("dir"))
    return (
        _up(_folders(inv, root, depth), ["objects", "measured", "bytes"])
        .groupBy("dir")
        .agg(F.sum("objects").alias("objects"), _subtree_bytes().alias("bytes"))
        .orderBy(F.split("dir", "/"))
        .select(full.alias("path"), "objects", "bytes")
    )


def size_totals(inv: DataFrame) -> DataFrame:
    """count, bytes (NULL if anything is unmeasured, 0 for nothing), measured_bytes, unmeasured."""
    return inv.agg(
        F.count(F.lit(1)).alias("count"),
        total_or_null("size").alias("bytes"),
        measured_total("size").alias("measured_bytes"),
        unmeasured_count("size").alias("unmeasured"),
    )


def usage(inv: DataFrame, basis: str = "stored", by: str = "remote") -> DataFrame:
    """`size_totals` per remote, with what the sizes are sizes of."""
    if basis not in SIZE_BASES:
        raise Refused(f"basis {basis!r} is not one of {SIZE_BASES}")
    return inv.groupBy(by).agg(
        F.count(F.lit(1)).alias("objects"),
        total_or_null("size").alias("bytes"),
        measured_total("size").alias("measured_bytes"),
        unmeasured_count("size").alias("unmeasured"),
        F.lit(basis).alias("sizes"),
    )


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """objects, bytes of measured rows, unmeasured; `measured_bytes` only when nothing is unmeasured."""
    blank = unmeasured("size", "hash")
    return catalog.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum(F.when(~blank, F.col("size"))), F.lit(0).cast("long")).alias("bytes"),
        count_where(blank).alias("unmeasured"),
    ).withColumn("measured_bytes", F.when(F.col("unmeasured") == 0, F.col("bytes")))


def infer_dirs(inv: DataFrame) -> DataFrame:
    """Directories implied by object paths, with the number of objects at or below each; no row for the root."""
    return _up(_folders(inv, "", None), ["objects"]).groupBy("dir").agg(F.sum("objects").alias("objects"))


def children(catalog: DataFrame, directory: str) -> DataFrame:
    """Objects whose parent is exactly `directory`; a stored `parent` column is used when there is one."""
    if "parent" in catalog.columns:
        return catalog.filter(F.col("parent") == directory)
    below = paths.is_under(directory, "path")
    return catalog.filter(below & (paths.parent("path") == directory))


def child_dirs(catalog: DataFrame, directory: str) -> DataFrame:
    """Immediate subdirectories, sorted."""
    start = len(paths.components_of(directory))
    inside = catalog.filter(paths.is_under(directory, "path"))
    parts = paths.components("path")
    return (
        inside.filter(F.size(parts) > start + 1)
        .select(F.array_join(F.slice(parts, 1, start + 1), "/").alias("dir"))
        .distinct()
        .orderBy("dir")
    )


def has_dir(catalog: DataFrame, directory: str) -> DataFrame:
    """One row saying whether any object or marker lies below; the scan stops at the first one found."""
    inside = catalog if directory == "" else catalog.filter(F.col("path").startswith(directory.rstrip("/") + "/"))
    return inside.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))


def tree(
    inv: DataFrame,
    level: int | None = None,
    dirs_only: bool = False,
    root: str = "",
) -> DataFrame:
    """One row per drawn node: path, parent, name, depth, is_dir, subtree bytes, position among siblings, is_last.

    Below `level` paths collapse into the directory at the level. Bytes are NULL once a member is unmeasured.
    """
    relative = paths.relative_to(root, "path")
    figures = ["objects", "measured", "bytes"]
    if level is None:
        files = inv.select(paths.components(relative).alias("parts"), "size")
    else:
        files = inv.select(paths.components(relative).alias("parts"), "size").filter(F.size("parts") <= level)
    leaves = files.select(
        F.array_join("parts", "/").alias("dir"),
        F.lit(False).alias("is_dir"),
        F.lit(1).cast("long").alias("objects"),
        F.col("size").isNotNull().cast("long").alias("measured"),
        F.col("size").alias("bytes"),
    )
    above = _up(_folders(inv, root, level), figures).select("dir", F.lit(True).alias("is_dir"), *figures)
    # A file and a directory of one name are one node, and the file (first in path order) decides its kind.
    nodes = (
        leaves.unionByName(above)
        .groupBy("dir")
        .agg(F.min("is_dir").alias("is_dir"), _subtree_bytes().alias("bytes"))
    )
    if dirs_only:
        nodes = nodes.filter("is_dir")
    nodes = nodes.select(
        F.col("dir").alias("path"),
        paths.parent("dir").alias("parent"),
        paths.file_name("dir").alias("name"),
        paths.depth("dir").cast("long").alias("depth"),
        "is_dir",
        "bytes",
    )
    numbered = with_position(nodes, ["parent"], ["name"], "position")
    last = nodes.groupBy("parent").agg(F.max("name").alias("_last"))
    return numbered.join(last, "parent").select(*nodes.columns, "position", (F.col("name") == F.col("_last")).alias("is_last"))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """Directories and files drawn."""
    return nodes.agg(count_where(F.col("is_dir")).alias("directories"), count_where(~F.col("is_dir")).alias("files"))


def stat(catalog: DataFrame, path: str) -> DataFrame:
    """The entry at exactly this path, or nothing."""
    return catalog.filter(F.col("path") == path)


def _noted(observed: DataFrame, totals: dict[str, Column], label: str, sample: int) -> DataFrame:
    """Counts over everything and the first rows by path as notes, from one reading; the rest is counted as unnamed."""
    found = counted_with_first(observed, totals, ["path", label], sample)
    return found.select(*totals, (F.col("_all") - F.size("rows")).alias("unnamed"), F.col("rows").alias("notes"))


def link_report(observed: DataFrame, sample: int = LINK_SAMPLE) -> DataFrame:
    """followed, skipped and broken links (rows path, verdict), a bounded sample, and how many went unnamed."""
    verdict = F.col("verdict")
    totals = {"followed": verdict == "followed", "skipped": ~verdict.isin("followed", "broken"), "broken": verdict == "broken"}
    return _noted(observed, totals, "verdict", sample)


def special_report(observed: DataFrame, sample: int = SPECIAL_SAMPLE) -> DataFrame:
    """Count and sample of special files (rows path, kind); rows without a kind are ordinary and left out."""
    special = observed.filter(F.col("kind").isNotNull())
    return _noted(special, {"skipped": F.lit(True)}, "kind", sample)


def listing_stats(inv: DataFrame, filters: FilterSet) -> DataFrame:
    """How many entries were seen and how many the filter kept."""
    flagged = filters.flag(inv)
    return flagged.agg(F.count(F.lit(1)).alias("seen"), count_where(F.col("admitted")).alias("matched"))
