"""Media columns: payloads as grey images in content-addressed tar shards, rows that point into them.

``store`` writes, from each task, one tar shard after another to a folder that all executors share.  A payload becomes
an 8-bit grey PNG of 64 samples a row (lossless), named by the payload's SHA-256.  ``owners`` picks, of the rows with a payload that is
there again, the one that stores it: only digests and ids are compared, payloads are never shuffled.  Within a task equal
payloads are written once; so only rows of one id and payload in several tasks are stored more than once.  ``canonical`` gives
every digest one place.  Rows carry digest, shard, offset and length.  ``headers`` reads the fixed-length head of each stored image
only and fills width and height; ``read_back`` reads whole images and gives the payload back.

A shard is written under a name of its own attempt and, when it is whole, moved to a name made from the digests it holds.  A
task that runs again writes the same shards, so it replaces what it has left, and no half shard has a final name; the index
is settled as a table before anyone reads a shard.

Defined results: a null or empty text is the payload of 64 zero bytes; equal payloads have equal digests and stored bytes
wherever they lie; rows may repeat; a payload of any length is one entry of its shard; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH = 64
SHARD_BYTES = 64 << 20  #: a shard is closed when it holds more
HEAD = 33  #: fixed by the format: signature, length and type of the first chunk, its 13 bytes and checksum
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def payload(text: Column) -> Column:
    """The text's UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    short = F.pmod(-F.length(raw), F.lit(WIDTH))
    zeros = F.substring(F.lit(bytes(WIDTH)), F.lit(1), F.when(F.length(raw) == 0, WIDTH).otherwise(short))
    return F.concat(raw, zeros)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(samples: bytes) -> bytes:
    """A grey image of 8 bits a sample, 64 samples a row, without filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def size_of(head: bytes) -> tuple[int, int]:
    """Width and height from an image's first bytes."""
    if head[:8] != SIGNATURE:
        raise ValueError("no image at this offset")
    return struct.unpack(">II", head[16:24])


def from_image(image: bytes) -> bytes:
    width, height = size_of(image[:HEAD])
    at, packed = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


class _Shards:
    """Tar shards of one task attempt, one after another."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.out, self.at, self.places, self.name = None, 0, {}, hashlib.sha256()

    def add(self, digest: str, image: bytes) -> tuple[int, int]:
        """Offset and length in the open shard."""
        if self.out is None:
            self.part = posixpath.join(self.folder, f"_{uuid.uuid4().hex}.part")
            self.out, self.at, self.name = self.files.open_output_stream(self.part), 0, hashlib.sha256()
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + bytes(-len(image) % 512))
        self.name.update(digest.encode())
        place = (self.at + len(head), len(image))
        self.at = place[1] + place[0] + -len(image) % 512
        return place

    def full(self) -> bool:
        return self.at >= SHARD_BYTES

    def close(self) -> str | None:
        """The name of the shard, now that it is known what it holds."""
        if self.out is None:
            return None
        self.out.write(bytes(1024))
        self.out.close()
        self.out, name = None, f"{self.name.hexdigest()[:40]}.tar"
        self.files.move(self.part, posixpath.join(self.folder, name))
        return name


def owners(df: DataFrame, id_col: str, payload: str = "payload") -> DataFrame:
    """Add ``stores``: whether the row stores its payload; of equal payloads the one with the smallest id does."""
    digest, first, own = common.fresh(df, "own_digest", "first_id", "stores")
    known = df.select(F.sha2(F.col(payload), 256).alias(digest), F.col(id_col).alias(first))
    again = known.groupBy(digest).agg(F.count("*").alias("n"), F.min(first).alias(first)).where("n > 1").drop("n")
    again = common.narrow(common.settled(again, "media-again"))
    out = df.withColumn(digest, F.sha2(F.col(payload), 256)).join(again, digest, "left")
    return out.withColumn(own, F.coalesce(F.col(id_col) == F.col(first), F.col(first).isNull())).drop(digest, first)


def store(df: DataFrame, folder: str, payload: str = "payload", keep: list[str] | None = None, stores: str | None = None) -> DataFrame:
    """Write the payloads to shards under ``folder``; rows get digest, shard, offset, length.  Settle the result before you read a shard.

    ``stores``: a column that says which rows store their payload; the others only get its digest.
    """
    keep = [c for c in df.columns if c not in (payload, stores)] if keep is None else keep
    writes = F.lit(True) if stores is None else F.col(stores)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.sha2(F.col(payload), 256).alias("_digest"), F.when(writes, F.col(payload)).alias("_payload"))
    names = common.fresh(source.select(*keep), "digest", "shard", "offset", "length")
    kinds = (T.StringType(), T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*source.schema.fields[:-2], *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places, waiting = _Shards(folder), {}, []  # a place has its shard's name once that is closed
        open_: list[str] = []

        def placed() -> Iterator[pa.RecordBatch]:
            name = shards.close()
            for digest in open_:
                places[digest] = (name, *places[digest][1:])
            open_.clear()
            for kept, digests in waiting:
                found = [places.get(d, (None, None, None)) for d in digests]
                columns = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*schema.names])
            waiting.clear()

        for batch in batches:
            digests = batch.column(batch.num_columns - 2).to_pylist()
            for digest, data in zip(digests, batch.column(batch.num_columns - 1)):
                if data.is_valid and digest not in places:
                    places[digest] = (None, *shards.add(digest, to_image(data.as_py())))
                    open_.append(digest)
            waiting.append((batch.columns[:-1], digests))
            if shards.full():
                yield from placed()
        yield from placed()

    return source.mapInArrow(run, schema)


def canonical(index: DataFrame) -> DataFrame:
    """One place for every digest, however many tasks have stored its payload."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return index.where("shard IS NOT NULL").groupBy("digest").agg(place).select("digest", "place.*")


def _ranges(places: DataFrame, folder: str, read, schema: str) -> DataFrame:
    """Read a byte range for each row; a task's rows are in order of shard and offset."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for part in parts:
            rows = []
            for x in part.itertuples():
                if x.shard != name:
                    if source is not None:
                        source.close()
                    name, source = x.shard, files.open_input_file(posixpath.join(root, x.shard))
                rows.append((x.digest, *read(source, x)))
            yield pd.DataFrame(rows, columns=names)
        if source is not None:
            source.close()

    names = [x.split()[0] for x in schema.split(", ")]
    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInPandas(run, schema)


def headers(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height: from the head of each stored image, nothing else is read."""

    def read(source, x):
        source.seek(x.offset)
        return size_of(source.read(HEAD))

    return _ranges(places, folder, read, "digest string, width long, height long")


def features(samples: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and how many differ from the one above."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    counts = np.bincount(rows.reshape(-1), minlength=256)
    share = counts[counts > 0] / rows.size
    values = np.arange(256)
    mean = float((counts * values).sum() / rows.size)
    deviation = float(np.sqrt(max(0.0, (counts * values**2).sum() / rows.size - mean * mean)))
    moved = int((rows[1:] != rows[:-1]).sum())
    return f"rows={len(rows)};mean={mean:.4f};std={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};moved={moved}"


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes hold, by digest: sizes, digests of stored form and payload, checksum of the last 64 samples, features."""

    def read(source, x):
        source.seek(x.offset)
        image = source.read(x.length)
        samples = from_image(image)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)

    return _ranges(places, folder, read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def open_shard(folder: str, shard: str) -> tarfile.TarFile:
    """A shard is a plain tar file; this reads it whole (for small ones and tests)."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(posixpath.join(root, shard)) as source:
        return tarfile.open(fileobj=io.BytesIO(source.read()))
