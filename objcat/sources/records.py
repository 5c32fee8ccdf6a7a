"""Audit logs, checksum manifests and JSON listings: reading and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objcat.errors import Refused
from objcat.functions import paths, units
from objcat.schema import AUDIT
from objcat.sources.listing import numbered_lines

REQUIRED = ("index", "time", "op", "result", "prev", "hash")
HASH_NAME = "sha256"


def parse_audit(lines: DataFrame) -> DataFrame:
    """Records of audit log lines (chain, line, pos, value); blank lines are left out.

    A line that is not exactly a record keeps its place and is handed on in `corrupt`: it breaks the chain, it is
    not skipped. That is broken text, a doubled key, an absent required field, and a field that is null, of
    another type than the record's, or a number below 0 or with a fraction. Absent optional fields are empty or 0.
    """
    body = F.regexp_replace("value", r"\A\s+|\s+\z", "")
    present = lines.withColumn("value", body).filter(F.col("value") != "")
    parsed = present.withColumn("_r", F.from_json("value", AUDIT, {"mode": "PERMISSIVE"}))
    exact = F.try_parse_json("value")  # NULL for broken text and doubled keys
    wrong = exact.isNull()
    for f in AUDIT.fields:
        text = isinstance(f.dataType, T.StringType)
        kind = F.schema_of_variant(F.try_variant_get(exact, "$." + f.name, "variant"))
        wrong = wrong | (F.coalesce(kind != ("STRING" if text else "BIGINT"), F.lit(f.name in REQUIRED)))
        if not text:
            wrong = wrong | F.coalesce(F.col("_r." + f.name) < 0, F.lit(False))
    fields = []
    for f in AUDIT.fields:
        value = F.col("_r." + f.name)
        if f.name in ("size", "bytes", "objects"):
            value = F.coalesce(value, F.lit(0).cast("long"))
        elif f.name not in ("v", *REQUIRED):
            value = F.coalesce(value, F.lit(""))
        fields.append(value.alias(f.name))
    return parsed.select("chain", "pos", "line", F.when(wrong, F.col("value")).alias("corrupt"), *fields)


def read_audit(spark: SparkSession, location: str) -> DataFrame:
    """Audit records of JSON-lines logs; each file is a chain."""
    return parse_audit(numbered_lines(spark, location).withColumnRenamed("file", "chain"))


def write_audit(log: DataFrame, location: str, chain: str = "chain", order: str = "pos") -> None:
    """Write whole chains in order as JSON lines, broken or not; each line names its chain.

    Rows are range-partitioned by chain and place: part files follow the order, a long chain runs over
    several of them, and many short chains share one.
    """
    names = [f.name for f in AUDIT.fields]
    columns = [F.col(chain).cast("string").alias("chain"), *[F.col(n) for n in names if n in log.columns]]
    ordered = log.repartitionByRange(F.col(chain), F.col(order)).sortWithinPartitions(chain, order)
    ordered.select(F.to_json(F.struct(*columns)).alias("value")).write.text(location)


def read_audit_export(spark: SparkSession, location: str) -> DataFrame:
    """What `write_audit` wrote. A record's place is its line in all the part files together, counted from
    the first line of its chain, so a line that was moved, dropped or slipped in shows."""
    lines = numbered_lines(spark, location)
    counts = lines.groupBy("file").agg(F.max("line").alias("_lines"), (F.max("pos") + 1).alias("_full"))
    # One row per part file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "file",
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_full").over(earlier), F.lit(0)).alias("_full_before"),
    )
    chain = F.coalesce(F.get_json_object("value", "$.chain"), F.lit(""))
    whole = lines.join(starts, "file").select(
        chain.alias("chain"),
        (F.col("line") + F.col("_lines_before")).alias("line"),
        (F.col("pos") + F.col("_full_before")).alias("pos"),
        "value",
    )
    firsts = whole.groupBy("chain").agg(F.min("pos").alias("_first"))
    return parse_audit(whole.join(firsts, "chain").withColumn("pos", F.col("pos") - F.col("_first")))


def lsjson(inv: DataFrame, root: str = "", algo: str = HASH_NAME) -> DataFrame:
    """Listing rows as they go out in JSON: Path, Name, Size, ModTime, IsDir and a map of digests."""
    is_dir = F.col("is_dir") if "is_dir" in inv.columns else F.lit(False)
    none = F.create_map().cast("map<string,string>")
    hashes = F.when(F.length("hash") > 0, F.create_map(F.lit(algo), F.col("hash"))).otherwise(none)
    return inv.select(
        paths.relative_to(root, "path").alias("Path"),
        paths.file_name("path").alias("Name"),
        F.col("size").alias("Size"),
        units.rfc3339("mtime").alias("ModTime"),
        is_dir.alias("IsDir"),
        hashes.alias("Hashes"),
    )


def manifest_lines(df: DataFrame, binary: bool = False) -> DataFrame:
    """`<hex>  <path>` per row, or `<hex> *<path>` in binary mode."""
    return df.select(F.concat("hash", F.lit(" *" if binary else "  "), "path").alias("value"))


def write_manifest(df: DataFrame, location: str, binary: bool = False) -> None:
    manifest_lines(df, binary).write.text(location)


def parse_manifest(lines: DataFrame, algo: str = HASH_NAME, text: str = "value") -> DataFrame:
    """(path, hash, problem) of checksum lines; a digest of the wrong length or alphabet is a problem."""
    shape = r"(?s)\A(\S+) [ *](.+)\z"
    digest, path = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    good = units.is_hex_digest(digest, algo)
    problem = F.when(~F.col(text).rlike(shape), "malformed-line").when(~good, "malformed-digest")
    usable = problem.isNull()
    return lines.select(
        F.when(path != "", path).alias("path"), F.when(usable, digest).alias("hash"), problem.alias("problem")
    )


def read_manifest(spark: SparkSession, location: str, algo: str = HASH_NAME) -> DataFrame:
    if algo not in units.HEX_LENGTH:
        raise Refused(f"digest {algo!r} is not one of {sorted(units.HEX_LENGTH)}")
    return parse_manifest(spark.read.text(location), algo)
