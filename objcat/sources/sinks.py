"""Writing results: verdict lists, plans, and tables that count as stored only after they were read back."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions.paths import parent
from objcat.plans.compare import DIFFER, MATCH, MISSING_ON_DST, MISSING_ON_SRC, combined_marks
from objcat.plans.transfer import plan_summary
from objcat.session import scratch_folder, staged
from objcat.sources.commits import FOLD_EVERY, CommitLog

STATUS_LISTS = {"match": MATCH, "differ": DIFFER, "missing_on_src": MISSING_ON_SRC, "missing_on_dst": MISSING_ON_DST}


def write_check(result: DataFrame, combined: str | None = None, **lists: str) -> None:
    """One text list per asked status (match, differ, missing_on_src, missing_on_dst) and a combined list
    with marks. An error has no list of its own; two lists in one place are refused."""
    unknown = set(lists) - set(STATUS_LISTS)
    if unknown:
        raise Refused(f"no list for {sorted(unknown)}")
    asked = [p.rstrip("/") for p in [combined, *lists.values()] if p]
    if len(set(asked)) != len(asked):
        raise Refused("two lists would be written to one place")
    # The comparison runs once; each list then reads only the rows of its status.
    spark, folder = result.sparkSession, scratch_folder(result.sparkSession, "check")
    result.select("path", "status").write.partitionBy("status").parquet(folder)
    kept = spark.read.schema("path string, status string").parquet(folder)
    if combined:
        combined_marks(kept).select("line").write.text(combined)
    for name, place in lists.items():
        kept.filter(F.col("status") == STATUS_LISTS[name]).select("path").write.text(place)


def write_plan(plan: DataFrame, location: str, result: DataFrame | None = None) -> None:
    """The rows that act, the summary, and after a run its result, as JSON documents below one folder."""
    plan = staged(plan.select("action", "source", "dest", "size", "reason"), "plan")
    rows = plan.filter(F.col("action") != "skip").select("action", "source", "dest", "size", "reason")
    rows.write.json(f"{location}/actions", ignoreNullFields=False)
    plan_summary(plan).write.json(f"{location}/summary", ignoreNullFields=False)
    if result is not None:
        result.write.json(f"{location}/result", ignoreNullFields=False)


def write_catalog(catalog: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Store a catalog sorted by directory, with the directory as a column.

    Rows are range-partitioned by (parent, path): listing one directory reads the few row groups that hold
    it, and a directory with most of the rows is spread over many files.
    """
    placed = catalog.withColumn("parent", parent("path"))
    placed.repartitionByRange("parent", "path").sortWithinPartitions("parent", "path").write.mode(mode).parquet(location)


def save_inventory(inv: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """Store an inventory bucketed and sorted by path: comparing two such tables moves no rows."""
    spread = inv.repartition(buckets, "path")
    spread.write.mode(mode).bucketBy(buckets, "path").sortBy("path").saveAsTable(table)


@dataclass(frozen=True)
class Receipt:
    """What a verified write stored, and the figures that were read back."""

    write_id: str
    data: str
    mode: str
    rows: int
    bytes: int
    xor: int
    total: str
    committed_at: str


def _figures(columns: list[str], size: str | None) -> list[Column]:
    """Count, bytes, and two digests over the rows in any order. The exclusive-or alone would not see a
    pair of equal rows come or go, so a sum of the same row hashes stands beside it."""
    row = F.xxhash64(*[F.col(c) for c in columns])
    amount = F.sum(size) if size else F.max(F.lit(0))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(amount, F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.bit_xor(row), F.lit(0)).cast("long").alias("xor"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"),
    ]


def _same(a: dict, b: dict) -> bool:
    return all(a[k] == b[k] for k in ("rows", "bytes", "xor", "total"))


def verified_write(df: DataFrame, location: str, size: str | None = "size", mode: str = "append") -> Receipt:
    """Write a table, read it back, and publish it only if what came back is what went out.

    The figures of the rows are taken while they are written, in the same pass. The data lands in a folder
    no reader looks at; the commit that names it is written last, under a number no other writer has. On a mismatch nothing is published.
    """
    if mode not in ("append", "overwrite"):
        raise Refused(f"mode {mode!r} is neither append nor overwrite")
    spark = df.sparkSession
    write_id = uuid.uuid4().hex
    data = f"{location}/data/{write_id}"
    sent = Observation(f"write-{write_id}")
    df.observe(sent, *_figures(df.columns, size if size in df.columns else None)).write.parquet(data)
    out = sent.get
    back = stored_figures(spark.read.parquet(data), df.columns, size if size in df.columns else None)
    if not _same(out, back):
        raise Refused(f"read back {back}, wrote {out}: nothing was published")
    receipt = Receipt(
        write_id,
        data,
        mode,
        back["rows"],
        back["bytes"],
        back["xor"],
        back["total"],
        datetime.datetime.now(datetime.timezone.utc).isoformat(),
    )
    log = CommitLog(spark, f"{location}/commits")
    number = log.append(asdict(receipt))
    if number % FOLD_EVERY == FOLD_EVERY - 1:
        log.fold(number, {"live": _live(log, number)})
    return receipt


def _live(log: CommitLog, upto: int | None = None) -> list[dict]:
    """What was committed since the last overwrite, in the order of the commits' numbers."""
    fold, after = log.tail()
    live = list(fold["live"]) if fold else []
    for number, record in after:
        if upto is None or number <= upto:
            live = [record] if record["mode"] == "overwrite" else [*live, record]
    return live


def stored_figures(table: DataFrame, columns: list[str], size: str | None) -> dict:
    return table.select(*columns).agg(*_figures(columns, size)).first().asDict()


def read_verified(spark: SparkSession, location: str, check: bool = False) -> DataFrame:
    """The published rows: everything committed since the last overwrite. `check` reads the figures again.

    The reader opens the last fold of the log and the few commits after it.
    """
    live = _live(CommitLog(spark, f"{location}/commits"))
    if not live:
        raise Refused(f"nothing was published at {location}")
    for row in live if check else []:
        table = spark.read.parquet(row["data"])
        found = stored_figures(table, table.columns, "size" if "size" in table.columns else None)
        if not _same(found, row):
            raise Refused(f"{row['data']} no longer holds what was committed")
    return spark.read.parquet(*[row["data"] for row in live])
