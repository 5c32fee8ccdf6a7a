"""What a deletion, a purge or a clean-up would remove. Nothing here removes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths
from objcat.operators.filters import FilterSet
from objcat.schema import as_col, count_where

OBJECT, DIRECTORY, STAGING, ORPHAN, MULTIPART = "object", "directory", "staging", "orphan", "multipart"
RECLAIM, HELD = "reclaim", "held"

# How old debris must be before it may go, and why it is held otherwise.
DEFAULT_MIN_AGE = 24 * 3600
TOO_YOUNG, AGE_UNKNOWN = "too-young", "age-unknown"


def _item(path: Column, size: Column, kind: Column | str) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [path.alias("path"), size.cast("long").alias("size"), kind.alias("kind")]


def _marker_items(dirs: DataFrame, marker: str) -> DataFrame:
    """Marker objects of directories (column dir)."""
    return dirs.select(*_item(paths.marker_path("dir", marker), F.lit(0), DIRECTORY))


def _declared(inv: DataFrame, target: str, marker: str) -> DataFrame:
    """Directories a marker declares, at or below the target."""
    dirs = inv.filter(paths.is_marker("path", marker)).select(paths.parent("path").alias("dir")).distinct()
    return dirs.filter(paths.is_under(target, "dir"))


def _holding(objects: DataFrame, *aggregates: Column) -> DataFrame:
    """Every directory (the root too) with figures over the objects at or below it (column path).

    Objects are reduced by parent before the few parents are expanded to their ancestors.
    """
    folders = objects.groupBy(paths.parent("path").alias("folder")).agg(
        F.count(F.lit(1)).alias("objects"), *aggregates
    )
    names = [c for c in folders.columns if c not in ("folder", "objects")]
    above = F.array_distinct(F.concat(paths.ancestors("folder"), F.array("folder")))
    spread = folders.select(F.explode(above).alias("dir"), "objects", *names)
    return spread.groupBy("dir").agg(F.sum("objects").alias("objects"), *[F.max(n).alias(n) for n in names])


def removal_order(items: DataFrame) -> DataFrame:
    """Objects in path order, then directories, deepest first."""
    return items.orderBy(F.col("kind") == DIRECTORY, F.when(F.col("kind") == DIRECTORY, -paths.depth("path")), "path")


def select_delete(
    inv: DataFrame,
    target: str = "",
    filters: FilterSet = FilterSet(),
    rmdirs: bool = False,
    marker: str = paths.MARKER_NAME,
) -> DataFrame:
    """Objects under the target that the filter admits. Markers survive, except with `rmdirs` those of
    directories this deletion empties: they held an object before and hold none after. Never the target itself."""
    inside = inv.filter(paths.is_under(target, "path"))
    objects = inside.filter(~paths.is_marker("path", marker)).withColumn("_full", F.col("path"))
    seen = objects.withColumn("path", paths.relative_to(target, "path"))
    chosen = filters.admit(seen).select(*_item(F.col("_full"), F.col("size"), OBJECT))
    if not rmdirs:
        return chosen
    decided = filters.flag(seen, "_goes").select(F.col("_full").alias("path"), (~F.col("_goes")).alias("_stays"))
    held = _holding(decided, F.max("_stays").alias("stays"))
    emptied = held.filter(~F.col("stays")).select("dir")
    gone = _declared(inside, target, marker).filter(F.col("dir") != target.rstrip("/")).join(emptied, "dir", "left_semi")
    return removal_order(chosen.unionByName(_marker_items(gone, marker)))


def select_deletefile(inv: DataFrame, path: str, marker: str = paths.MARKER_NAME) -> DataFrame:
    """Exactly one object; an absent path and a directory are refused."""
    kind = F.when(paths.is_marker("path", marker), DIRECTORY).otherwise(OBJECT)
    found = inv.filter(F.col("path") == path).select(*_item(F.col("path"), F.col("size"), kind))
    if found.isEmpty():
        if inv.filter(paths.is_under(path, "path")).isEmpty():
            raise Refused(f"{path!r} does not exist")
        raise Refused(f"{path!r} is a directory, not an object")
    return found


def select_purge(inv: DataFrame, directory: str, marker: str = paths.MARKER_NAME) -> DataFrame:
    """Everything under a directory and its markers, whatever the filters say."""
    inside = inv.filter(paths.is_under(directory, "path"))
    if directory != "" and inside.isEmpty():
        raise Refused(f"{directory!r} does not exist")
    objects = inside.filter(~paths.is_marker("path", marker)).select(*_item(F.col("path"), F.col("size"), OBJECT))
    return removal_order(objects.unionByName(_marker_items(_declared(inside, directory, marker), marker)))


def rmdir_state(inv: DataFrame, directory: str, marker: str = paths.MARKER_NAME) -> DataFrame:
    """One row: whether the directory exists and is declared, and its first occupant and subdirectory, if any."""
    inside = inv.filter(paths.is_under(directory, "path"))
    is_marker = paths.is_marker("path", marker)
    declared = paths.parent("path")
    below = F.col("path").startswith(directory + "/") if directory else F.lit(True)
    occupant = F.min(F.when(~is_marker & below, F.col("path")))
    child = F.min(F.when(is_marker & (declared != directory), F.struct(-paths.depth(declared), declared.alias("dir"))))
    own = F.coalesce(F.max(is_marker & (declared == directory)), F.lit(False))
    row = inside.agg(own.alias("declared"), occupant.alias("occupant"), child["dir"].alias("child"))
    exists = F.col("declared") | F.col("occupant").isNotNull() | F.col("child").isNotNull()
    return row.select(exists.alias("exists"), "declared", "occupant", "child")


def select_rmdir(inv: DataFrame, directory: str, marker: str = paths.MARKER_NAME) -> DataFrame:
    """The marker of a directory with nothing beneath it; an occupied or absent directory is refused."""
    state = rmdir_state(inv, directory, marker).first()
    if not state["exists"]:
        raise Refused(f"{directory!r} does not exist")
    if state["occupant"] or state["child"]:
        raise Refused(f"{directory!r} is not empty: it holds {state['occupant'] or state['child']!r}")
    return _marker_items(_declared(inv, directory, marker).filter(F.col("dir") == directory), marker)


def select_rmdirs(
    inv: DataFrame, directory: str = "", leave_root: bool = False, marker: str = paths.MARKER_NAME
) -> DataFrame:
    """All declared directories with no object beneath, deepest first."""
    inside = inv.filter(paths.is_under(directory, "path"))
    dirs = _declared(inside, directory, marker)
    if leave_root:
        dirs = dirs.filter(F.col("dir") != directory)
    held = _holding(inside.filter(~paths.is_marker("path", marker)).select("path")).select("dir")
    return removal_order(_marker_items(dirs.join(held, "dir", "left_anti"), marker))


def age_verdict(mtime: Column | str, now: int | Column, min_age: int = DEFAULT_MIN_AGE) -> Column:
    """struct(status, reason): debris is reclaimed only when it is known to be old enough."""
    mtime = as_col(mtime)
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    # A time too far away to subtract is either older than any limit or still to come.
    age = F.greatest(F.coalesce(F.try_subtract(now, mtime), F.when(mtime < now, F.lit(2**63 - 1)).otherwise(F.lit(0))), F.lit(0))
    reason = F.when(mtime.isNull(), AGE_UNKNOWN).when(age < min_age, TOO_YOUNG)
    return F.struct(F.when(reason.isNull(), RECLAIM).otherwise(HELD).alias("status"), reason.alias("reason"))


def _aged(df: DataFrame, path: str, size: Column, mtime: str, kind: str, now: int, min_age: int) -> DataFrame:
    judged = df.withColumn("_v", age_verdict(mtime, now, min_age))
    return judged.select(*_item(F.col(path), size, kind), F.col("_v.status").alias("status"), F.col("_v.reason").alias("reason"))


def debris_staging(
    inv: DataFrame,
    now: int,
    min_age: int = DEFAULT_MIN_AGE,
    scope: str = "",
    prefix: str = paths.STAGING_PREFIX,
) -> DataFrame:
    """Objects under a scope that carry the reserved staging name, with what their age allows."""
    named = inv.filter(paths.is_under(scope, "path") & paths.is_staging_key("path", prefix))
    return _aged(named, "path", F.col("size"), "mtime", STAGING, now, min_age)


def debris_multipart(uploads: DataFrame, now: int, min_age: int = DEFAULT_MIN_AGE, scope: str = "") -> DataFrame:
    """Incomplete uploads (object_key, upload_id, started); their size is not known."""
    inside = uploads.filter(paths.is_under(scope, "object_key"))
    return _aged(inside, "object_key", F.lit(None), "started", MULTIPART, now, min_age)


def debris_orphans(
    objects: DataFrame, catalog: DataFrame, name_records: DataFrame, now: int, min_age: int = DEFAULT_MIN_AGE
) -> DataFrame:
    """Stored objects (object_key, size, mtime) that no catalog row references.

    Refused unless the store holds as many name records as the catalog has rows: a catalog that misses
    files would make their objects look like orphans.
    """
    records, rows = name_records.count(), catalog.count()
    if records != rows:
        raise Refused(f"the store holds {records} name records but the catalog has {rows} rows")
    lost = objects.join(catalog.select("object_key"), "object_key", "left_anti")
    return _aged(lost, "object_key", F.col("size"), "mtime", ORPHAN, now, min_age)


def removal_totals(items: DataFrame) -> DataFrame:
    """Counts per status (removed, would-remove, absent, failed, held), held bytes, and the bytes of what
    is or would be removed: NULL once one of those is unmeasured."""
    status, size = F.col("status"), F.col("size")
    counted = status.isin("removed", "would-remove")
    blank = count_where(counted & size.isNull())
    zero = F.lit(0).cast("long")
    measured = F.coalesce(F.sum(F.when(counted, size)), zero)
    names = {n: n.replace("-", "_") for n in ("removed", "would-remove", "absent", "failed", "held")}
    return items.agg(
        *[count_where(status == value).alias(name) for value, name in names.items()],
        F.coalesce(F.sum(F.when(status == HELD, F.coalesce(size, zero))), zero).alias("held_bytes"),
        F.when(blank == 0, measured).alias("bytes"),
        measured.alias("measured_bytes"),
        blank.alias("unmeasured"),
    )
