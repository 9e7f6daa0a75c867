"""Spark session helpers: UTC, checkpoint folder, materialisation."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# HotSpot compiles no method of more bytes than this. Rows of records are spelled out by many expressions; above the limit Spark
# splits them into small methods, where its own default (65535) makes one that is interpreted for every row.
METHOD_CONF, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def build_session(master: str = "local[*]", app: str = "sessionloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass in the session you have."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Timestamps are computed and rendered in UTC whatever session is handed in; generated code stays small enough to be compiled."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(METHOD_CONF, "65535") == "65535":
        spark.conf.set(METHOD_CONF, METHOD_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster shares between executors, if it names one."""
    return spark.conf.get(CHECKPOINT_CONF, None)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table several results read, once.

    With a shared folder the table is written there as Parquet: lineage is cut,
    a lost executor costs nothing, and later reads still prune columns. Zstandard
    takes fewer bytes than the default. Without a folder (tests, notebooks) the
    table is persisted and stays recomputable.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder:
        path = f"{folder.rstrip('/')}/sessionloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
