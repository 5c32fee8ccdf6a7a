"""Session helpers: a sensible local session, and the shared folder for tables that outlive a stage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("objcat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which every executor can reach. It goes when the application ends.

    Only where that setting is absent (tests on one machine) is a local temporary folder used; with a
    master that is not local, an absent setting is an error, because executors would not share the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "objcat-scratch")
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    # The store forgets it when the driver's JVM ends. That needs a folder that exists, so writers get one below.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/data"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: the lineage is cut and values are fixed."""
    spark = df.sparkSession
    folder = scratch_folder(spark, label)
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._staged_at = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, before the application ends. Others are left alone."""
    for table in tables:
        folder = getattr(table, "_staged_at", None)
        if folder:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Short rows that stand for much work, over every task slot.

    The number of partitions is given, because adaptive execution would otherwise put rows this small
    together again by their size.
    """
    spark = df.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(slots, *columns)
