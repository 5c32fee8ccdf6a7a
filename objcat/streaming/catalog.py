"""Catalog totals and directory counts kept up to date from a feed of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from objcat.errors import Refused
from objcat.functions import paths
from objcat.session import discard, scratch_folder, staged
from objcat.sources.commits import CommitLog

CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("hash", T.StringType()),
    ]
)

BUCKETS = 64
STATE = "path string, seq long, present boolean, bytes long, unmeasured long"
_CHANGE = "d_objects long, d_bytes long, d_unmeasured long"
_TOTALS = ("objects", "bytes", "unmeasured")
_EMPTY = {"done": {}, "state": {}, "dirs": {}, "totals": dict.fromkeys(_TOTALS, 0)}


def _latest(changes: DataFrame) -> DataFrame:
    """(path, seq, present, bytes, unmeasured) after the latest change of each path, reduced before the shuffle."""
    feed = changes.select(*[F.col(f.name).cast(f.dataType) for f in CHANGES.fields])
    last = feed.groupBy("path").agg(F.max(F.struct("seq", "kind", "size", "hash")).alias("l")).select("path", "l.*")
    put = F.col("kind") == "put"
    blank = F.col("size").isNull() | (F.col("size") == 0) & (F.coalesce("hash", F.lit("")) == "")
    return last.select(
        "path",
        "seq",
        F.coalesce(put, F.lit(False)).alias("present"),
        F.when(put & ~blank, F.col("size")).otherwise(0).cast("long").alias("bytes"),
        F.when(put & blank, 1).otherwise(0).cast("long").alias("unmeasured"),
    )


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


def _stored(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(df: DataFrame, column: str, buckets: int, folder: str, touched: int) -> set[str]:
    """One folder per bucket that has rows; their numbers."""
    placed = df.withColumn("bucket", _bucket(column, buckets)).repartition(max(1, touched), "bucket")
    placed.write.partitionBy("bucket").parquet(folder)
    there = df.sparkSession.read.schema("bucket int").parquet(folder)
    return {str(r["bucket"]) for r in there.select("bucket").distinct().collect()}


def apply_changes(changes: DataFrame, location: str, batch: int, query: str = "", buckets: int = BUCKETS) -> None:
    """Merge one batch of changes into the catalog state, totals and directory counts below `location`.

    State is one short row per path, in buckets by the hash of the path. Only the buckets of changed paths are read, merged in one
    grouping of built-in aggregates, and written anew; then a commit names the current folder of every bucket and the totals. A change
    older than the one already applied is ignored, so late and repeated changes do no harm, and a batch that was
    committed is not applied again. Folders that neither of the last two commits names are removed, so the number
    of files depends on `buckets`, not on the batches. Take more buckets for larger catalogs: one is rewritten as a whole.
    """
    spark, log = changes.sparkSession, CommitLog(changes.sparkSession, f"{location}/commits")
    number, last = log.last()
    last = last or _EMPTY
    if last["done"].get(query, -1) >= batch:
        return
    tag = f"{number + 1}-{uuid.uuid4().hex}"

    fresh = staged(_latest(changes), "changes")
    touched = [str(r["bucket"]) for r in fresh.select(_bucket("path", buckets)).distinct().collect()]
    fields = ["seq", "stored", "present", "bytes", "unmeasured"]
    known = _stored(spark, [last["state"][b] for b in touched if b in last["state"]], STATE).withColumn("stored", F.lit(True))
    both = fresh.withColumn("stored", F.lit(False)).unionByName(known)
    row = F.struct(*fields)  # of equal numbers, what is stored stays
    merged = both.groupBy("path").agg(F.max(row).alias("now"), F.max(F.when(F.col("stored"), row)).alias("was"))
    was = lambda c: F.coalesce(F.col(f"was.{c}").cast("long"), F.lit(0).cast("long"))
    merged = merged.select(
        "path", "now.seq", "now.present", "now.bytes", "now.unmeasured",
        (F.col("now.present").cast("long") - was("present")).alias("d_objects"),
        (F.col("now.bytes") - was("bytes")).alias("d_bytes"),
        (F.col("now.unmeasured") - was("unmeasured")).alias("d_unmeasured"),
    )
    state = {**last["state"], **{b: f"{location}/state/{tag}/bucket={b}" for b in _write(merged, "path", buckets, f"{location}/state/{tag}", len(touched))}}

    written = _stored(spark, [state[b] for b in touched], f"{STATE}, {_CHANGE}")
    sums = written.agg(*[F.coalesce(F.sum("d_" + n), F.lit(0).cast("long")).alias(n) for n in _TOTALS]).first()
    folders = written.groupBy(paths.parent("path").alias("folder")).agg(F.sum("d_objects").alias("refs")).filter("refs <> 0")
    above = F.array_remove(F.concat(paths.ancestors("folder"), F.array("folder")), "")
    deltas = folders.select(F.explode(F.array_distinct(above)).alias("dir"), "refs").groupBy("dir").agg(F.sum("refs").alias("refs"))
    deltas = staged(deltas, "folders")
    moved = [str(r["bucket"]) for r in deltas.select(_bucket("dir", buckets)).distinct().collect()]
    counts = _stored(spark, [last["dirs"][b] for b in moved if b in last["dirs"]], "dir string, refs long").unionByName(deltas)
    counts = counts.groupBy("dir").agg(F.sum("refs").alias("refs")).filter("refs <> 0")
    kept = _write(counts, "dir", buckets, f"{location}/dirs/{tag}", len(moved)) if moved else set()
    dirs = {b: f for b, f in last["dirs"].items() if b not in moved} | {b: f"{location}/dirs/{tag}/bucket={b}" for b in kept}

    record = {"done": {**last["done"], query: batch}, "state": state, "dirs": dirs, "totals": {n: last["totals"][n] + sums[n] for n in _TOTALS}}
    if not log.claim(number + 1, record):
        raise Refused(f"another writer keeps the totals at {location}")
    discard(fresh, deltas)
    _forget(log, number + 1)


def _forget(log: CommitLog, newest: int) -> None:
    """Remove commits before the last two, and the folders that they alone name."""
    numbers = log.numbers()
    named = lambda n: {f for part in ("state", "dirs") for f in log._read(f"{n:020}.json")[part].values()}
    live = {f for n in numbers if n >= newest - 1 for f in named(n)}
    for n in [n for n in numbers if n < newest - 1]:
        for folder in named(n) - live:
            log.remove(folder)
        log.forget(n)


def stream_catalog(
    changes: DataFrame, location: str, checkpoint: str | None = None, available_now: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep totals and directory counts below `location` from a stream of changes; each batch is applied once."""
    checkpoint = checkpoint or scratch_folder(changes.sparkSession, "stream")

    def apply(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        apply_changes(batch, location, number, query, buckets)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_totals(spark: SparkSession, location: str) -> DataFrame:
    """objects, bytes, unmeasured and measured_bytes as of the last commit."""
    totals = (CommitLog(spark, f"{location}/commits").last()[1] or _EMPTY)["totals"]
    row = spark.createDataFrame([tuple(totals[n] for n in _TOTALS)], "objects long, bytes long, unmeasured long")
    return row.withColumn("measured_bytes", F.when(F.col("unmeasured") == 0, F.col("bytes")))


def stream_dirs(spark: SparkSession, location: str) -> DataFrame:
    """Objects at or below each directory as of the last commit; a directory at 0 is gone."""
    folders = (CommitLog(spark, f"{location}/commits").last()[1] or _EMPTY)["dirs"]
    refs = _stored(spark, sorted(folders.values()), "dir string, refs long")
    return refs.select("dir", F.col("refs").alias("objects")).filter(F.col("objects") > 0)


def batch_state(changes: DataFrame) -> DataFrame:
    """The catalog the same changes leave behind, worked out at once: the latest change of each path, if a put."""
    latest = changes.groupBy("path").agg(F.max_by(F.struct("kind", "size", "hash"), "seq").alias("l"))
    return latest.filter(F.col("l.kind") == "put").select("path", "l.size", "l.hash")
