"""Comparing two inventories, two manifests, or a catalog with its store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions.paths import nfc
from objcat.schema import count_where

MATCH, DIFFER, ERROR = "match", "differ", "error"
MISSING_ON_SRC, MISSING_ON_DST = "missing-on-src", "missing-on-dst"

# The mark of each status in a combined list.
MARKS = {MATCH: "=", MISSING_ON_SRC: "-", MISSING_ON_DST: "+", DIFFER: "*", ERROR: "!"}

# Names of the comparisons, with the fields each one reads.
COMPARISONS = {"size+mtime": ("size", "mtime"), "size": ("size",), "checksum": ("hash",)}

DEFAULT_WINDOW = 1


def side(df: DataFrame, prefix: str, fields: tuple[str, ...]) -> DataFrame:
    """One side of a path join: the key and only the fields that will be read, under a prefix.

    A field the table does not have is unknown; rows are files and their objects are there unless it says so.
    """
    absent = {
        "size": F.lit(None).cast("long"),
        "mtime": F.lit(None).cast("long"),
        "hash": F.lit(None).cast("string"),
        "object_missing": F.lit(False),
        "kind": F.lit("file"),
    }
    picked = [(F.col(f) if f in df.columns else absent[f]).alias(prefix + f) for f in fields]
    return df.select(F.col("path").alias(prefix + "path"), *picked)


def within(a: Column, b: Column, window: int) -> Column:
    """Are two times at most `window` apart? NULL if either is unknown; times too far apart to subtract are not."""
    gap = F.try_subtract(a, b)
    unknown = a.isNull() | b.isNull()
    return F.when(~unknown, F.coalesce((gap <= window) & (gap >= -window), F.lit(False)))


def same_contents(compare: str, window: int) -> Column:
    """True, False, or NULL where a field the comparison needs is unknown. Sizes that differ settle it early."""
    if compare == "size":
        return F.col("s_size") == F.col("d_size")
    if compare == "checksum":
        return F.lower("s_hash") == F.lower("d_hash")
    sizes = F.col("s_size") == F.col("d_size")
    times = within(F.col("s_mtime"), F.col("d_mtime"), window)
    return F.when(sizes.isNull(), F.lit(None).cast("boolean")).when(~sizes, F.lit(False)).otherwise(times)


def check(
    src: DataFrame,
    dst: DataFrame,
    compare: str = "size+mtime",
    window: int = DEFAULT_WINDOW,
    one_way: bool = False,
) -> DataFrame:
    """Status of every path of either side. An entry whose object is gone counts as missing on its side."""
    if compare not in COMPARISONS:
        raise Refused(f"comparison {compare!r} is not one of {sorted(COMPARISONS)}")
    fields = (*COMPARISONS[compare], "object_missing")
    left, right = side(src, "s_", fields), side(dst, "d_", fields)
    paired = left.join(right, left["s_path"] == right["d_path"], "left" if one_way else "full_outer")
    on_src = F.col("s_path").isNotNull() & ~F.col("s_object_missing")
    on_dst = F.col("d_path").isNotNull() & ~F.col("d_object_missing")
    same = same_contents(compare, window)
    status = (
        F.when(on_src & on_dst, F.when(same, MATCH).when(~same, DIFFER).otherwise(ERROR))
        .when(on_src, MISSING_ON_DST)
        .when(on_dst, MISSING_ON_SRC)
        .otherwise(ERROR)
    )
    result = paired.select(F.coalesce("s_path", "d_path").alias("path"), status.alias("status"))
    return result.filter(F.col("status") != MISSING_ON_SRC) if one_way else result


def check_summary(result: DataFrame, compare: str = "size+mtime") -> DataFrame:
    """Counts per status, and whether the comparison proves contents."""
    status = F.col("status")
    return result.agg(
        F.count(F.lit(1)).alias("checked"),
        count_where(status == MATCH).alias("matched"),
        count_where(status == DIFFER).alias("differ"),
        count_where(status == MISSING_ON_SRC).alias("missing_on_src"),
        count_where(status == MISSING_ON_DST).alias("missing_on_dst"),
        count_where(status == ERROR).alias("errors"),
    ).withColumn("proves_contents", F.lit(compare == "checksum"))


def mark_of(status: Column | str) -> Column:
    pairs = [F.lit(x) for pair in MARKS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col(status) if isinstance(status, str) else status)


def combined_marks(result: DataFrame) -> DataFrame:
    """`<mark> <path>` per row."""
    mark = mark_of("status")
    return result.select(mark.alias("mark"), "path", F.concat(mark, F.lit(" "), "path").alias("line"))


def confirm(inv: DataFrame, store_keys: DataFrame) -> DataFrame:
    """Mark recorded entries whose object the store no longer holds (rows without a key are not recorded)."""
    held = store_keys.select(F.col("object_key").alias("_held")).distinct()
    joined = inv.drop("object_missing").join(held, inv["object_key"] == held["_held"], "left")
    gone = F.col("object_key").isNotNull() & F.col("_held").isNull()
    return joined.withColumn("object_missing", gone).drop("_held")


def compare_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """identical / differing / missing / unexpected / respelled per path (rows: path, size, hash).

    A path absent under its own spelling is looked up by its composed form, first in path order. One outer join
    and one window over the spellings of a form: each side is read once.
    """
    e = expected.select(*[F.col(c).alias("e_" + c) for c in ("path", "size", "hash")])
    a = actual.select(*[F.col(c).alias("a_" + c) for c in ("path", "size", "hash")])
    paired = e.join(a, e["e_path"] == a["a_path"], "full_outer")
    listed, there = F.col("e_path").isNotNull(), F.col("a_path").isNotNull()

    spellings = Window.partitionBy("form")
    found = F.when(there, F.struct(*[F.col("a_" + c).alias(c) for c in ("path", "size", "hash")]))
    seen = paired.withColumn("form", nfc(F.coalesce("e_path", "a_path"))).select(
        "*",
        F.min(found).over(spellings).alias("f"),
        F.max(listed & ~there).over(spellings).alias("sought"),
    )

    def equal(size: str, digest: str) -> Column:
        return F.col("e_size").eqNullSafe(F.col(size)) & F.col("e_hash").eqNullSafe(F.col(digest))

    status = (
        F.when(listed & there, F.when(equal("a_size", "a_hash"), "identical").otherwise("differing"))
        .when(listed & F.col("f").isNull(), "missing")
        .when(listed, F.when(equal("f.size", "f.hash"), "respelled").otherwise("differing"))
        # The spelling that stands for a path not found under its own is no surprise.
        .when(~(F.col("sought") & (F.col("a_path") == F.col("f.path"))), "unexpected")
    )
    return seen.select(
        F.coalesce("e_path", "a_path").alias("path"),
        F.when(there, F.col("a_path")).otherwise(F.col("f.path")).alias("restored_as"),
        status.alias("status"),
    ).filter("status is not null")


def superseded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Object keys that a newer record of the same path replaced."""
    before = old.select("path", F.col("object_key").alias("_old"))
    after = new.select("path", F.col("object_key").alias("replaced_by"))
    return (
        before.join(after, "path")
        .filter(F.col("_old") != F.col("replaced_by"))
        .select("path", F.col("_old").alias("object_key"), "replaced_by")
    )


def superseded_versions(versions: DataFrame, order: str = "version") -> DataFrame:
    """The same over a history table: every key of a path except its latest one.

    The latest key is an aggregate with partial results, so a path with most of the versions is no bottleneck.
    """
    latest = versions.groupBy("path").agg(F.max_by("object_key", order).alias("replaced_by"))
    keys = versions.groupBy("path", "object_key").agg(F.max(order).alias("_last"))
    return (
        keys.join(latest, "path")
        .filter(F.col("object_key") != F.col("replaced_by"))
        .select("path", "object_key", "replaced_by")
    )
