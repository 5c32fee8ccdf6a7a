"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words, as a class of a regular expression; bytes.split() splits at the same six bytes.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(df: DataFrame, column: str) -> Column:
    """The column as text, with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on nothing but the parts (52 bits of their MD5)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    # A separator and a sign for null keep ("a", null), ("a", "") and ("", "a") apart.
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(column).type) else pa.binary()
    return [value or b"" for value in batch.column(column).cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
