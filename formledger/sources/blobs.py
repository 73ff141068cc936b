"""Files of any size as rows of ranges, listed and read in tasks; their digests by a tree over the ranges or in a chain.

``spark.read.binaryFile`` holds a file in one row, which ends at 2 GB, and lists all files on the driver.  Here folders are listed by
tasks, level by level, and a task reads ranges, a block at a time: its memory is that of a block, and a large file is read by many tasks.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settled

SCHEMA = "path string, size_bytes long, modified timestamp, part long, n_parts long, begin long, n_bytes long, sha256 string, problem string"
RANGE = 64 << 20  #: bytes of a range
BLOCK = 1 << 20  #: bytes read at once
LARGEST = 1 << 40  #: bytes of a file; larger ones are told, not read
FAN = 1024  #: digests that are joined into one
TOGETHER = 1024  #: small files that a task reads, about
STEP = 256 << 20  #: bytes that a task of a chain reads at most
LISTING = pa.schema({"path": pa.string(), "is_folder": pa.bool_(), "size_bytes": pa.int64(), "modified": pa.timestamp("us", "UTC")})


def opened(path: str):
    """(file system, path in it) of a URI or a local path, whatever pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _hidden(name: str) -> bool:
    """Names that Spark's own readers leave out."""
    return (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)) and not name.startswith(("_metadata", "_common_metadata"))


def listed(spark: SparkSession, path: str, pattern: str = "*", hidden: bool = True) -> DataFrame:
    """path, size_bytes, modified of files below a folder (or of the one file) whose names match a pattern (of fnmatch)."""
    root = path.rstrip("/")

    def of_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = opened(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                own = base + folder[len(root) :]
                infos = [i for i in system.get_file_info([own]) if i.type == fs.FileType.File] or system.get_file_info(fs.FileSelector(own))
                infos = [i for i in infos if (hidden or not _hidden(i.base_name)) and (i.type == fs.FileType.Directory or (i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern)))]
                for at in range(0, len(infos), 10_000):
                    rows = [{"path": root + i.path[len(base) :], "is_folder": i.type == fs.FileType.Directory, "size_bytes": i.size, "modified": i.mtime} for i in infos[at : at + 10_000]]
                    yield pa.RecordBatch.from_pylist(rows, schema=LISTING)

    level, n, out = spark.createDataFrame([(root,)], "folder string"), 1, None
    while n:
        seen = settled(level.repartition(min(n, 200)).mapInArrow(of_folders, "path string, is_folder boolean, size_bytes long, modified timestamp"), "listing")
        found = seen.where("NOT is_folder").drop("is_folder")
        out = found if out is None else out.unionByName(found)
        level = seen.where("is_folder").select(F.col("path").alias("folder"))
        n = level.count()
    return out


def ranges_of(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE, largest: int = LARGEST, hidden: bool = True) -> DataFrame:
    """``SCHEMA`` rows without digests, dealt to tasks by bytes and number; a file that is too large is one row with that problem."""
    files = listed(spark, path, pattern, hidden).withColumn("problem", F.when(F.col("size_bytes") > largest, "too_large"))
    n_parts = F.when(F.col("problem").isNull(), F.greatest(F.lit(1), F.ceil(F.col("size_bytes") / size))).otherwise(F.lit(1)).cast("long")
    parts = files.withColumn("n_parts", n_parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    begin = F.col("part") * size
    n_bytes = F.when(F.col("problem").isNull(), F.least(F.lit(size), F.col("size_bytes") - begin)).otherwise(F.lit(0)).cast("long")
    parts = parts.select("path", "size_bytes", "modified", "part", "n_parts", begin.alias("begin"), n_bytes.alias("n_bytes"), F.lit(None).cast("string").alias("sha256"), "problem")
    n, total = parts.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return parts.repartition(max(1, -(-n // TOGETHER), -(-total // size)), "path", "part")


def read_ranges(parts: DataFrame, root: str, use: Callable[[Iterator[bytes]], object], name: str, kind: str, beyond: int = 0) -> DataFrame:
    """The ranges with a column: what ``use`` makes of a range's blocks (and ``beyond`` bytes after it, as far as the file goes)."""
    root = root.rstrip("/")
    schema = parts.withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        base, at = base.rstrip("/"), len(root)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r.setdefault(name, None)
                if r["problem"] is not None:
                    continue
                left = [r["n_bytes"], min(r["size_bytes"] - r["begin"], r["n_bytes"] + beyond)]
                try:
                    with system.open_input_file(base + r["path"][at:]) as f:
                        f.seek(r["begin"])

                        def blocks(f=f, left=left):
                            while left[1] and (block := f.read(min(BLOCK, left[1]))):
                                left[:] = left[0] - len(block), left[1] - len(block)
                                yield block

                        r[name] = use(blocks())
                    if left[1]:
                        r[name], r["problem"] = None, "shorter_than_listed"
                except OSError as e:
                    r["problem"] = f"unreadable: {type(e).__name__}"
            extra = [] if name in batch.schema.names else [pa.field(name, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, *extra]))

    return parts.mapInArrow(run, schema)


def _digest(blocks: Iterator[bytes]) -> str:
    own = hashlib.sha256()
    for block in blocks:
        own.update(block)
    return own.hexdigest()


def ranges(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE, largest: int = LARGEST, hidden: bool = True, of_large: bool = True) -> DataFrame:
    """``SCHEMA`` rows of all files below a folder, one for each range; problems are rows too.  Written once, so files are read once.

    Without ``of_large``, ranges of files that have several are not read and have no digest.
    """
    parts = ranges_of(spark, path, pattern, size, largest, hidden)
    read = read_ranges(parts if of_large else parts.where("n_parts = 1"), path, _digest, "sha256", "string")
    done = settled(read if of_large else read.unionByName(parts.where("n_parts > 1")), "ranges")
    if done.isEmpty():
        return spark.createDataFrame([(path.rstrip("/"), 0, None, 0, 0, 0, 0, None, "no_files")], SCHEMA)
    return done


class _Sha256:
    """A SHA-256 whose state is bytes that another task can carry on: OpenSSL's context, which Python's ``hashlib`` doesn't show."""

    SIZE = 112  #: bytes of a context: digest, length, block, what is in it

    def __init__(self, state: bytes | None):
        import _hashlib
        import ctypes

        self.lib, self.own = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state or b"", self.SIZE)
        self.lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        if state is None:
            self.lib.SHA256_Init(self.own)

    @staticmethod
    def there() -> bool:
        """Whether this Python shows the functions."""
        import ctypes

        try:
            import _hashlib

            return hasattr(ctypes.CDLL(_hashlib.__file__), "SHA256_Init")
        except (ImportError, OSError, AttributeError):
            return False

    def update(self, block: bytes) -> None:
        self.lib.SHA256_Update(self.own, block, len(block))

    def state(self) -> bytes:
        return self.own.raw

    def hexdigest(self) -> str:
        out = bytearray(32)
        self.lib.SHA256_Final((type(self.own)._type_ * 32).from_buffer(out), self.own)
        return out.hex()


def chained(files: DataFrame, root: str, step: int = STEP) -> DataFrame:
    """path, sha256 of whole files (path, size_bytes): a chain over the bytes, of which each round's tasks read at most ``step`` and hand on the state.

    Where no state can be handed on, a task reads its files to their ends, block by block.
    """
    root, carried = root.rstrip("/"), _Sha256.there()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        base, budget = base.rstrip("/"), step
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                left = min(budget, r["size_bytes"] - r["at"]) if carried else r["size_bytes"]
                if not left and r["size_bytes"]:
                    continue  # a later round's
                own = _Sha256(r["state"]) if carried else hashlib.sha256()
                with system.open_input_file(base + r["path"][len(root) :]) as f:
                    f.seek(r["at"])
                    while left:
                        block = f.read(min(BLOCK, left))
                        if not block:
                            raise OSError(f"{r['path']} is shorter than listed")
                        own.update(block)
                        left, budget, r["at"] = left - len(block), budget - len(block), r["at"] + len(block)
                if carried:
                    r["state"] = own.state()
                if r["at"] == r["size_bytes"]:
                    r["sha256"] = own.hexdigest()
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    now = files.select("path", "size_bytes", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    out, n = None, now.count()
    while n or out is None:
        now = settled(now.repartition(max(1, min(n, 1000))).mapInArrow(run, now.schema), "chains")
        done = now.where("sha256 IS NOT NULL").select("path", "sha256")
        out = done if out is None else out.unionByName(done)
        now = now.where("sha256 IS NULL")
        n = now.count()
    return out


def whole(parts: DataFrame, root: str, step: int = STEP) -> DataFrame:
    """path, sha256, size_bytes, modified of the files of ``ranges``; one that could not be read is an error."""
    bad = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "problem")))
    files = parts.where("part = 0 AND NOT problem <=> 'no_files'").withColumn("sha256", F.coalesce(bad, F.when(F.col("n_parts") == 1, F.col("sha256"))))
    large = files.where("n_parts > 1")
    small = files.where("n_parts = 1").select("path", "sha256", "size_bytes", "modified")
    if large.isEmpty():
        return small
    return small.unionByName(large.drop("sha256").join(chained(large, root, step), "path").select("path", "sha256", "size_bytes", "modified"))


def digests(parts: DataFrame) -> DataFrame:
    """path, size_bytes, n_parts, tree_sha256 of files all of whose ranges were read.

    Digests of up to ``FAN`` neighbours are hashed into one, level by level, so no row ever holds those of all ranges; the number of levels is
    that of the file with the most ranges.
    """
    whole = parts.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.max("n_parts").alias("n_parts"), F.count("sha256").alias("read"), F.count("problem").alias("bad")).where("bad = 0 AND read = n_parts")
    now = parts.where("sha256 IS NOT NULL").select("path", F.col("part").alias("k"), F.col("sha256").alias("d"), "n_parts")
    most = parts.agg(F.max("n_parts")).first()[0] or 1
    width = 1  # ranges below a digest of this level
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        done = (F.col("n_parts") <= width) & F.lit(width > 1)  # a smaller file's root is as it was
        now = now.groupBy("path", "n_parts", F.floor(F.col("k") / FAN).alias("k")).agg(F.when(done, F.max("d")).otherwise(F.sha2(joined, 256)).alias("d"))
        most, width = -(-most // FAN), width * FAN
        if most <= 1:
            return whole.join(now.select("path", F.col("d").alias("tree_sha256")), "path").select("path", "size_bytes", "n_parts", "tree_sha256")


def problems(parts: DataFrame) -> DataFrame:
    """path, size_bytes, problem of files that weren't read whole."""
    return parts.where("problem IS NOT NULL").select("path", "size_bytes", "problem").distinct()
