"""Totals over a table and its first few rows, from one reading."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted_with_first(df: DataFrame, counts: dict[str, Column], columns: list[str], k: int) -> DataFrame:
    """One row: how many rows meet each condition, `_all`, and `rows`, the first `k` by the given columns in order.

    Each task keeps its counts and its k first rows, and hands on one short row; those are summed and cut again. So the table is
    read once and never sorted, and nothing grows with it but the number of tasks. An empty table gives zeros and no rows.
    """
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in counts.items()]
    narrow = df.select(*columns, *flags)
    flagged = list(counts)
    names = [*flagged, "_all"]
    one = narrow.select(*counts, F.lit(0).cast("long").alias("_all"), F.array(F.struct(*columns)).alias("rows")).schema
    order = [(c, "ascending") for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first = dict.fromkeys(names, 0), None
        for batch in batches:
            for name in flagged:
                sums[name] += pc.sum(batch.column(name)).as_py() or 0
            sums["_all"] += batch.num_rows
            mine = pa.Table.from_batches([batch.select(columns)])
            mine = mine if first is None else pa.concat_tables([first, mine])
            first = mine.take(pc.sort_indices(mine, sort_keys=order, null_placement="at_start")[:k])
        if first is not None:
            kind = pa.list_(pa.struct([(c, first.schema.field(c).type) for c in columns]))
            yield pa.RecordBatch.from_arrays([*[pa.array([sums[n]], pa.int64()) for n in names], pa.array([first.to_pylist()], kind)], [*names, "rows"])

    tasks = narrow.mapInArrow(run, one)
    total = [F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names]
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, k)
    return tasks.agg(*total, merged.alias("rows"))
