"""Integer vectors as short binary rows, and every block of one table beside every block of another."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import slices
from objcat.session import staged

SCALE = 256  # a component x counts as floor(SCALE * x)


@dataclass(frozen=True)
class Shape:
    """Binary vectors are `width` little-endian numbers of type `kind`; no score passes `bound`."""

    width: int
    kind: str
    bound: int

    @property
    def exact(self) -> type:
        """The quickest type in which every partial sum of a score is exact."""
        return np.float32 if self.bound < 1 << 24 else np.float64 if self.bound < 1 << 53 else np.int64

    def matrix(self, column: pa.ChunkedArray) -> np.ndarray:
        values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        whole = np.frombuffer(b"".join(values.to_pylist()), self.kind)
        return whole.reshape(len(values), self.width).astype(self.exact)


def taking_part(df: DataFrame, key: str, vector: str) -> Column:
    """Rows with a key and a vector whose components are all finite numbers."""
    bad = F.exists(df[vector], lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df[key].isNotNull() & df[vector].isNotNull() & ~bad


def integers(df: DataFrame, key: str, vector: str, extra: dict[str, Column] | None = None, scale: int = SCALE) -> tuple[DataFrame, Shape]:
    """(id, v, code, ...): one short row for each key that takes part, written once, and the shape of v.

    Rows that repeat a key count once: the row whose vector (then extra columns) is least. Shorter vectors are filled up with 0.
    `code` holds the signs of the first 16 components, by which similar vectors can be put together. Vectors whose
    scores would pass 64 bits are an error.
    """
    extra = extra or {}
    names = list(extra)
    part = df.filter(taking_part(df, key, vector))
    tall = F.array_max(F.transform(part[vector], lambda x: F.abs(x.cast("double"))))
    facts = part.agg(F.max(F.size(part[vector])).alias("width"), F.max(tall).alias("tall")).first()
    width, tall = facts["width"] or 0, math.floor((facts["tall"] or 0.0) * scale) + 1
    bound = max(1, width) * tall * tall
    if bound >= 1 << 63:
        raise ValueError(f"components up to {facts['tall']} give scores of more than 64 bits")
    kind = "<i2" if tall < 1 << 15 else "<i4" if tall < 1 << 31 else "<i8"

    whole = F.transform(part[vector], lambda x: F.floor(x.cast("double") * scale))
    one = part.select(part[key].alias("id"), F.struct(whole.alias("v"), *[c.alias(n) for n, c in extra.items()]).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    rows = one.select("id", "r.v", *[F.col(f"r.{n}").alias(n) for n in names])
    schema = rows.select("id", F.lit(b"").alias("v"), F.lit(0).alias("code"), *names).schema
    columns = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            column = batch.column("v")
            lengths = np.asarray(column.value_lengths()) if len(column) else np.zeros(0, np.int64)
            filled = np.zeros((len(column), width), kind)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            filled[np.repeat(np.arange(len(column)), lengths), at] = column.flatten().to_numpy(zero_copy_only=False)
            signs = (filled[:, :16] >= 0) @ (1 << np.arange(min(16, width))[::-1])
            packed = pa.array([row.tobytes() for row in filled], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(signs.astype(np.int32)), *[batch.column(n) for n in names]], columns)

    return staged(rows.mapInArrow(run, schema), "vectors"), Shape(width, kind, bound)


def beside(left: DataFrame, right: DataFrame, blocks: int, cell_rows: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`score` of every block of `left` (a column `block`, 0 to `blocks` - 1) with every cell of `right`, as one table.

    Each row of `right` falls by the hash of its id in a cell of about `cell_rows` rows, and meets each block once; so a
    task holds one block and one cell at a time, whatever the size of the tables. Blocks and cells are about equal,
    so no key is larger than others. The number of partitions is given: adaptive execution would put such short rows together.
    """
    spark = right.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    total = right.count()
    cells = max(1, math.ceil(total / cell_rows), min(math.ceil(2 * slots / max(1, blocks)), math.ceil(total / 256)))
    parts = min(blocks * cells, max(slots, blocks * cells // 8))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    own = left.select(*[F.col(c).alias(c) for c in left.columns])  # left may be a part of right
    spread = own.withColumn("cell", over(cells)).repartition(max(1, parts), "block", "cell")
    dealt = right.withColumn("cell", F.pmod(F.xxhash64("id", F.lit("cell")), F.lit(cells)).cast("int"))
    dealt = dealt.withColumn("block", over(blocks)).repartition(max(1, parts), "block", "cell")
    return spread.groupBy("block", "cell").cogroup(dealt.groupBy("block", "cell")).applyInArrow(score, schema)
