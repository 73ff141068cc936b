"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  #: a word: a run without ASCII white space

#: A side of a join is broadcast up to so many rows and bytes; beyond either Spark shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16 << 20
ROWS_A_FILE = 100_000  #: of a narrow table in the shared folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker and in its executor's buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (as in tests) gets a temporary folder; a cluster has to set it, for a local one would be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="formledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str, free: bool = False, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    ``free``: what it was made from was large and isn't needed any more; a collection lets Spark's cleaner drop its shuffle files
    and broadcasts now instead of when the driver happens to run short of memory, so a job of many steps needs the disk of one.
    ``rows``: a bound of its rows, if these are narrow; they are then gathered into files of ``ROWS_A_FILE``, not one for each partition.
    """
    path = shared_folder(df.sparkSession, what)
    # by a shuffle: a task that runs many partitions of joins and sums one after another would hold the memory of all
    out = df if rows is None else df.repartition(max(1, -(-rows // ROWS_A_FILE)))
    out.write.parquet(path)
    if free:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(side: DataFrame) -> DataFrame:
    """Hint a broadcast if the counted rows and bytes are below the bounds, else leave the join to a shuffle.  ``side`` should be settled."""
    deep = [F.octet_length(F.to_json(F.struct(c)) if kind[:3] in ("arr", "map", "str") and kind != "string" else F.col(c)) for c, kind in side.dtypes if kind in ("string", "binary") or kind[:3] in ("arr", "map", "str")]
    width = sum((F.coalesce(x, F.lit(0)) for x in deep), F.lit(8 * len(side.columns)))
    n, size = side.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(side) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else side


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
