"""Following an audit log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objcat.operators.audit import admits
from objcat.sources.records import parse_audit


def read_audit_stream(spark: SparkSession, location: str) -> DataFrame:
    """New records of JSON-lines logs below a folder, read as strictly as in a batch.

    Columns as `parse_audit` gives them; a stream has no place for a line, so pos and line are NULL.
    """
    lines = spark.readStream.text(location).select(F.col("_metadata.file_path").alias("chain"), "value")
    none = F.lit(None).cast("long")
    return parse_audit(lines.withColumn("pos", none).withColumn("line", none))


def follow_audit(log: DataFrame, **window) -> DataFrame:
    """`audit_list` without order or limit: the records that match, as they arrive, and every line that is no record."""
    wanted = admits(**window)
    return log.filter(F.coalesce(wanted, F.lit(False)) | F.col("corrupt").isNotNull() if "corrupt" in log.columns else wanted)
