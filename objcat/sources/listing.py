"""Where inventories come from: object listings, catalogs, path lists and numbered text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths
from objcat.schema import CATALOG, catalog_inventory, count_where
from objcat.session import spread, staged

COMMENTS = ("#", ";")


FOUND = "path string, size long, mtime long, is_dir boolean"


def scan_objects(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every object below a folder or store prefix with its size and time; bodies are not read.

    The tree is listed level by level: the directories of one level are a table whose rows are spread over
    the cluster, each task lists the directories it holds, and what they contain is written out and gives
    the next level. Nothing is gathered on the driver, and unlike Spark's own file index this sees empty
    objects and names that start with `.` or `_`. Links are not followed; special files are no objects.
    Tasks reach folders and stores through the file systems of pyarrow.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow as pa
        from pyarrow import fs

        if "://" in root:
            store, base = fs.FileSystem.from_uri(root)
        else:
            store, base = fs.LocalFileSystem(), os.path.abspath(root)
        local = isinstance(store, fs.LocalFileSystem)
        names = ["path", "size", "mtime", "is_dir"]
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                place = f"{base.rstrip('/')}/{directory}".rstrip("/")
                rows: list[tuple] = []
                for info in store.get_file_info(fs.FileSelector(place)):
                    if local and os.path.islink(info.path):
                        continue
                    is_dir = info.type == fs.FileType.Directory
                    if not is_dir and info.type != fs.FileType.File:
                        continue
                    name = f"{directory}/{info.base_name}" if directory else info.base_name
                    seconds = None if info.mtime_ns is None else info.mtime_ns // 10**9
                    rows.append((name, None if is_dir else info.size, seconds, is_dir))
                for start in range(0, len(rows), 10_000):
                    columns = zip(*rows[start : start + 10_000])
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    level = spark.createDataFrame([("",)], "path string")
    found: DataFrame | None = None
    while True:
        listed = staged(level.mapInArrow(contents, FOUND), "listing")
        found = listed if found is None else found.unionByName(listed)
        below = listed.filter("is_dir").select("path")
        if not recursive or below.isEmpty():
            break
        level = spread(below, "path")
    return found.filter(~F.col("is_dir")).select(
        paths.nfc("path").alias("path"),
        "size",
        "mtime",
        F.lit(None).cast("string").alias("hash"),
        F.lit(False).alias("object_missing"),
    )


def read_catalog(spark: SparkSession, location: str) -> DataFrame:
    """A recorded inventory; a row nobody measured shows a NULL size. `location` is a folder or a table name.

    A stored `parent` column is kept: one directory's rows are then found by the statistics of the files.
    """
    table = spark.read.parquet(location) if "/" in location else spark.table(location)
    kept = [F.col(f.name).cast(f.dataType) for f in CATALOG.fields]
    if "parent" not in table.columns:
        return catalog_inventory(table.select(*kept))
    return catalog_inventory(table.select(*kept, "parent"), "parent")


def rebuild_catalog(name_records: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog from the store alone, and (files, measured, unmeasured).

    Each name record (path, object_key) takes size, time and digest from its object's header
    (object_key, size, mtime, hash). A record whose object cannot be described is kept, as unmeasured.
    """
    known = headers.select("object_key", F.col("size").alias("_size"), "mtime", F.col("hash").alias("_hash"))
    catalog = name_records.select("path", "object_key").join(known, "object_key", "left").select(
        "path",
        "object_key",
        F.coalesce("_size", F.lit(0).cast("long")).alias("size"),
        "mtime",
        F.coalesce("_hash", F.lit("")).alias("hash"),
    )
    described = name_records.join(known.select("object_key", "_size"), "object_key", "left")
    rebuilt = described.agg(
        F.count(F.lit(1)).alias("files"),
        count_where(F.col("_size").isNotNull()).alias("measured"),
        count_where(F.col("_size").isNull()).alias("unmeasured"),
    )
    return catalog, rebuilt


def numbered_lines(spark: SparkSession, location: str) -> DataFrame:
    """(file, line, pos, value): text with the 1-based number of every line of every file, and the 0-based
    place of each line among those that are not blank.

    Files are read in splits, in any order. Each line knows the byte at which its split begins; lines are
    numbered inside their split and the counts of the splits before it are added, so no file has to pass
    through one task.
    """
    filled = (F.trim(F.regexp_replace("value", r"\s+", " ")) != "").cast("long")
    read = spark.read.text(location).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        filled.alias("_filled"),
    )
    counts = read.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_filled").alias("_full"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "file",
        "_split",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_full").over(earlier), F.lit(0)).alias("_full_before"),
    )
    inside = Window.partitionBy("file", "_split").orderBy("_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        read.withColumn("_line", F.row_number().over(inside))
        .withColumn("_place", F.sum("_filled").over(upto))
        .join(starts, ["file", "_split"])
        .select(
            "file",
            (F.col("_line") + F.col("_lines_before")).cast("long").alias("line"),
            (F.col("_place") + F.col("_full_before") - 1).cast("long").alias("pos"),
            "value",
        )
    )


def path_list(lines: DataFrame, text: str = "value", line: str = "line") -> DataFrame:
    """Distinct logical paths of a list; blank and comment lines are skipped, a line with `..` is refused."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    first = F.substring(trimmed, 1, 1)
    named = lines.select(F.col(line).alias("_line"), trimmed.alias("_text")).filter(
        (F.col("_text") != "") & ~first.isin(*COMMENTS)
    )
    bad = named.filter(F.col("_text").rlike(r"(?:\A|[/\\])\.\.(?:[/\\]|\z)")).orderBy("_line").limit(1).collect()
    if bad:
        raise Refused(f"line {bad[0]['_line']}: {bad[0]['_text']!r}: the path leaves the root with '..'")
    return named.select(paths.clean_path("_text").alias("path")).filter(F.col("path") != "").distinct()


def read_path_list(spark: SparkSession, location: str) -> DataFrame:
    """`path_list` of a text file."""
    return path_list(numbered_lines(spark, location))
