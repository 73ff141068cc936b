"""Reading tables of the given folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  #: Spark's own setting: shuffle files go with the query that wrote them


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local session (as in tests) gets a temporary folder; a cluster has to set it, for a local one would be lost.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="formledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str, *more: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows (and those of more frames, one after another) to the shared folder and read them back.

    Files that the shuffles on the way leave behind go as soon as a frame is written; otherwise they stay until the driver's memory
    is tidied up, and the steps of a query add up on disk.
    """
    path, spark = scratch(df.sparkSession, what), df.sparkSession
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
