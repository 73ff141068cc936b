"""A sink with one commit: files of tasks are named by their content, a manifest makes them a table, and a table never changes.

Each task writes its rows to one file and says what it wrote.  The commit sums up what the tasks say into the table's digest,
which doesn't depend on how rows were dealt to tasks or in which order, and publishes the manifest, the last step.  Without a
manifest nothing is visible, so a failed job leaves nothing but files that the next one removes; a second write of equal rows changes nothing,
one of other rows is an error.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .blobs import opened

MANIFEST = "_manifest.json"


@dataclasses.dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    total: int  #: sum of the rows' digests


def _total(batch: pa.RecordBatch) -> int:
    """Sum of the digests of a batch's rows, modulo 2 ** 256."""
    columns = [c.to_pylist() for c in batch.columns]
    return sum(int.from_bytes(hashlib.sha256(repr(row).encode("utf-8", "surrogatepass")).digest(), "big") for row in zip(*columns)) % (1 << 256)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.job = path.rstrip("/"), schema.simpleString(), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.path)
        rows = total = 0
        writer, temporary = None, f"{base}/.{self.job}-{uuid.uuid4().hex}"
        try:
            for batch in iterator:
                if writer is None:
                    system.create_dir(base, recursive=True)
                    writer = pq.ParquetWriter(temporary, batch.schema, filesystem=system)
                writer.write_batch(batch)
                rows, total = rows + batch.num_rows, (total + _total(batch)) % (1 << 256)
        except BaseException:
            if writer is not None:
                writer.close()
                system.delete_file(temporary)
            raise
        if writer is None:
            return Written(None, 0, 0)
        writer.close()
        name = f"{total:064x}-{self.job}-{uuid.uuid4().hex[:8]}.parquet"
        system.move(temporary, f"{base}/{name}")
        return Written(name, rows, total)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        done = [m for m in messages if m is not None]
        made = {"columns": self.columns, "rows": sum(m.rows for m in done), "digest": f"{sum(m.total for m in done) % (1 << 256):064x}"}
        stored = manifest(self.path)
        if stored is not None:
            self.abort(messages)
            if {k: stored[k] for k in made} != made:
                raise ValueError(f"{self.path} holds other rows, and tables never change")
            return
        system.create_dir(base, recursive=True)
        temporary = f"{base}/.{self.job}-manifest"
        with system.open_output_stream(temporary) as f:
            f.write(json.dumps(made | {"files": sorted(m.file for m in done if m.file)}).encode())
        system.move(temporary, f"{base}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what tasks of this job wrote, those included whose messages never came."""
        from pyarrow import fs

        system, base = opened(self.path)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if self.job in info.base_name:
                system.delete_file(info.path)


class OnceTables(DataSource):
    """Format ``once``: option path; write with mode append."""

    @classmethod
    def name(cls) -> str:
        return "once"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tables never change: write with mode append")
        return _Writer(self.options["path"], schema)


def manifest(path: str) -> dict | None:
    """What is published of a table, or None."""
    from pyarrow import fs

    system, base = opened(path.rstrip("/"))
    if system.get_file_info(f"{base}/{MANIFEST}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def write(df: DataFrame, path: str) -> None:
    """Publish a table, or find that it is there already."""
    df.sparkSession.dataSource.register(OnceTables)
    df.write.format("once").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The published rows: the manifest's files and no others."""
    known = manifest(path)
    if known is None:
        raise FileNotFoundError(f"{path} holds no published table")
    files = [f"{path.rstrip('/')}/{f}" for f in known["files"]]
    schema = StructType.fromDDL(known["columns"].removeprefix("struct<").removesuffix(">"))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
