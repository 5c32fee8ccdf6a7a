"""Row contracts shared by every operator, and the one rule they all keep: unknown is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("object_missing", T.BooleanType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("object_key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("v", T.IntegerType()),
        T.StructField("index", T.LongType()),
        T.StructField("time", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("objects", T.LongType()),
        T.StructField("plaintext_hash", T.StringType()),
        T.StructField("ciphertext_hash", T.StringType()),
        T.StructField("remote", T.StringType()),
        T.StructField("prev", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)


def as_col(value: Column | str) -> Column:
    """A column given by name or as an expression."""
    return F.col(value) if isinstance(value, str) else value


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))


def total_or_null(size: Column | str) -> Column:
    """Sum of sizes, NULL as soon as one member is unmeasured, 0 for an empty set."""
    size = as_col(size)
    return F.when(F.count(size) == F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0).cast("long")))


def measured_total(size: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(size)), F.lit(0).cast("long"))


def unmeasured_count(size: Column | str) -> Column:
    return count_where(as_col(size).isNull())


def unmeasured(size: Column | str, digest: Column | str) -> Column:
    """A catalog row nobody measured: size 0 *and* no digest. A real empty file has a digest."""
    return (as_col(size) == 0) & (F.coalesce(F.length(as_col(digest)), F.lit(0)) == 0)


def as_inventory(
    df: DataFrame,
    path: Column | str,
    size: Column | str | None = None,
    mtime: Column | str | None = None,
    hash: Column | str | None = None,
    object_missing: Column | str | None = None,
) -> DataFrame:
    """Put any table into the inventory contract; a field that is not given is unknown, not zero."""

    def take(value, name, dtype):
        column = F.lit(None) if value is None else as_col(value)
        return column.cast(dtype).alias(name)

    missing = F.lit(False) if object_missing is None else F.coalesce(as_col(object_missing), F.lit(False))
    return df.select(
        as_col(path).cast("string").alias("path"),
        take(size, "size", "long"),
        take(mtime, "mtime", "long"),
        take(hash, "hash", "string"),
        missing.alias("object_missing"),
    )


def catalog_inventory(catalog: DataFrame, *kept: str) -> DataFrame:
    """A catalog as inventory rows: an unmeasured row shows a NULL size, and an empty digest is no digest."""
    return catalog.select(
        "path",
        "object_key",
        F.when(~unmeasured("size", "hash"), F.col("size")).alias("size"),
        "mtime",
        F.when(F.length("hash") > 0, F.col("hash")).alias("hash"),
        F.lit(False).alias("object_missing"),
        *kept,
    )


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of two one-row frames in one row, without a join."""
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
