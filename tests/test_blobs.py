"""Large files by ranges, and tables with one commit."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from formledger.sources import blobs, once


def tree(data, size):
    level = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + blobs.FAN]).encode()).hexdigest() for i in range(0, len(level), blobs.FAN)]
        if len(level) == 1:
            return level[0]


def test_ranges_and_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "FAN", 4)
    (tmp_path / "sub").mkdir()
    data = {"a.bin": os.urandom(10_001), "sub/b.bin": b"", "sub/c.bin": b"x" * 1000, "d.txt": b"no", "huge.bin": b"y" * 50_000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    parts = blobs.ranges(spark, f"file://{tmp_path}", "*.bin", size=500, largest=20_000)
    rows = parts.collect()
    assert {r.path.removeprefix(f"file://{tmp_path}/"): r.n_parts for r in rows} == {"a.bin": 21, "sub/b.bin": 1, "sub/c.bin": 2, "huge.bin": 1}
    got = {r.path.removeprefix(f"file://{tmp_path}/"): (r.size_bytes, r.tree_sha256) for r in blobs.digests(parts).collect()}
    assert got == {n: (len(data[n]), tree(data[n], 500)) for n in ("a.bin", "sub/b.bin", "sub/c.bin")}
    assert [(r.path.rsplit("/")[-1], r.problem) for r in blobs.problems(parts).collect()] == [("huge.bin", "too_large")]
    assert [r.problem for r in blobs.ranges(spark, f"file://{tmp_path}", "*.none").collect()] == ["no_files"]


def test_a_large_file_takes_little_memory(spark, tmp_path):
    import resource

    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate(3 << 30)  # a hole, read as zeros
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    (row,) = blobs.digests(blobs.ranges(spark, f"file://{tmp_path}", size=512 << 20)).collect()
    assert (row.size_bytes, row.n_parts) == (3 << 30, 6)
    zeros = hashlib.sha256()
    for _ in range(512):
        zeros.update(bytes(1 << 20))
    assert row.tree_sha256 == hashlib.sha256((zeros.hexdigest() * 6).encode()).hexdigest()
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss <= max(before, 300 << 10)


def visible(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_equal_tables_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.array(F.col("id")).alias("a"))
    once.write(df.repartition(4), path)
    files = visible(tmp_path / "t")
    assert len(files) == 5 and sorted(map(tuple, once.read(spark, path).select("id", "s").collect())) == sorted((i, str(i % 7)) for i in range(1000))
    once.write(df.repartition(3, "s").sortWithinPartitions(F.desc("id")), path)  # equal rows, dealt otherwise
    assert visible(tmp_path / "t") == files
    with pytest.raises(Exception, match="never change"):
        once.write(df.where("id > 0"), path)
    with pytest.raises(Exception, match="never change"):
        once.write(df.unionAll(df.limit(1)), path)
    assert visible(tmp_path / "t") == files and once.read(spark, path).count() == 1000


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        once.write(bad, path)
    assert once.manifest(path) is None and [f for f in visible(tmp_path / "f") if not f.startswith(".")] == []
    with pytest.raises(FileNotFoundError):
        once.read(spark, path)
    once.write(spark.range(5), path)
    assert sorted(r.id for r in once.read(spark, path).collect()) == [0, 1, 2, 3, 4]
    once.write(spark.range(0), f"file://{tmp_path}/none")
    assert once.read(spark, f"file://{tmp_path}/none").collect() == []


def test_a_file_is_hashed_by_tasks_that_read_a_part_each(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    data = {"a.bin": os.urandom(10_001), "sub dir/b 100%.bin": os.urandom(7_777), "c.bin": b"", "d.bin": b"z" * 1000, ".e.bin": b"hidden", "_f.bin": b"hidden"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    root = f"file://{tmp_path}"
    for step in (500, 64, 1 << 20):
        if step == 64:
            data["a.bin"] = data["a.bin"][:900]
            (tmp_path / "a.bin").write_bytes(data["a.bin"])
            (tmp_path / "sub dir/b 100%.bin").write_bytes(b"")
            data["sub dir/b 100%.bin"] = b""
        got = {r.path.removeprefix(root + "/"): (r.sha256, r.size_bytes) for r in blobs.whole(blobs.ranges(spark, root, "*.bin", size=500, hidden=False), root, step).collect()}
        assert got == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in data.items() if d != b"hidden"}


def test_inventory_beyond_what_a_row_holds(spark, tmp_path):
    from formledger.sources import files

    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((2 << 30) + 5)  # a hole, read as zeros; binaryFile ends at 2 GB
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    (row,) = files.inventory(spark, f"file://{tmp_path}").collect()
    assert (row.sha256, row.size_bytes) == (zeros.hexdigest(), (2 << 30) + 5) and row.modified is not None


def test_tokens_across_ranges_and_few_tasks(spark, tmp_path, monkeypatch):
    from formledger.sources import files

    for i in range(100):
        (tmp_path / f"{i}.md").write_text("x" * 9 + ("###" if i % 2 else "#.##") + "é" * 5)
    monkeypatch.setattr(blobs.ranges_of, "__defaults__", ("*", 10, blobs.LARGEST, True))
    parts = blobs.ranges_of(spark, f"file://{tmp_path}", "*.md")
    assert parts.select("n_parts").distinct().collect()[0][0] == 3
    got = {(r.path.rsplit("/")[-1], r.code) for r in files.token_scan(spark, f"file://{tmp_path}", [("marker", "###", True), ("need", "éé", False), ("none", "é", True)]).collect()}
    assert got == {(f"{i}.md", "marker") for i in range(1, 100, 2)} | {(f"{i}.md", "none") for i in range(100)}
    monkeypatch.undo()
    assert blobs.ranges_of(spark, f"file://{tmp_path}", "*.md").rdd.getNumPartitions() == 1


def test_a_python_without_states_hashes_to_the_end(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(data := os.urandom(10_001))
    monkeypatch.setattr(blobs._Sha256, "there", staticmethod(lambda: False))
    root = f"file://{tmp_path}"
    (row,) = blobs.whole(blobs.ranges(spark, root, size=500), root, 700).collect()
    assert row.sha256 == hashlib.sha256(data).hexdigest()
