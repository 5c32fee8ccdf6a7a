"""Positions inside ordered groups that stay whole and spread out when one group is most of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objcat.session import staged

# Rows among which the search for a cut ends with a running total; more are cut by range again.
PIECE_ROWS = 100_000
# Ranges of one step of that search, at least.
PIECES = 64


def with_position(df: DataFrame, by: list[str], order: list[str], name: str = "position", piece: Column | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its group, in order.

    Rows are range-partitioned by group and order and written once, so that every row keeps its range. The part
    of a group that lies in one range is numbered on its own, and the rows of its earlier parts are added. Only the
    group that comes first in a range can have earlier parts, so what is joined is one short row per range.
    `piece` is a whole number that never falls along the order and cuts long groups by value, such as a quotient of
    the order column: the rows then need no range partitioning and are not written.
    """
    if piece is None:
        ranges = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
        ranges = staged(ranges, "ranges")
    else:
        ranges = df.withColumn("_range", piece)
    counts = ranges.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_range").alias("_r"), F.sum("_rows").over(earlier).alias("_before"))
    starts = starts.filter("_before > 0")
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    numbered = ranges.withColumn("_inside", F.row_number().over(inside))
    match = [numbered[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(by)]
    match.append(numbered["_range"] == starts["_r"])
    place = F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))
    return numbered.join(starts, match, "left").select(*df.columns, place.cast("long").alias(name))


def first_over_limit(df: DataFrame, order: str, amount: str, limit: int) -> str | None:
    """The order key at which a running total of `amount` first passes `limit`, or None if it never does.

    Rows are range-partitioned by the key and reduced to one row per range (lowest key, highest key, rows, sum),
    which come to the driver. The range in which the limit is passed is cut by range again, until it holds at most
    PIECE_ROWS rows or one key; only those are run through row by row.
    """
    rows, spent, known = df.select(order, amount), 0, None
    pieces = max(PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        ranges = (
            rows.repartitionByRange(pieces, order)
            .groupBy(F.spark_partition_id().alias("_range"))
            .agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("total"))
            .collect()
        )
        over = None
        for row in sorted(ranges, key=lambda r: r["low"].encode()):
            if spent + row["total"] > limit:
                over = row
                break
            spent += row["total"]
        if over is None:
            return None
        if over["low"] == over["high"]:
            return over["low"]
        rows = rows.filter(F.col(order).between(over["low"], over["high"]))
        if over["rows"] <= PIECE_ROWS or over["rows"] == known:
            break
        known = over["rows"]
    running = F.sum(amount).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    passed = rows.select(order, running.alias("_running")).filter(F.col("_running") > limit - spent)
    return passed.agg(F.min(order).alias("cut")).first()["cut"]
