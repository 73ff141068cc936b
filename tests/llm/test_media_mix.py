import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formledger.llm import common, media, mix, queries


def test_images_come_back():
    for n in (1, 2, 100):
        samples = bytes(range(64)) * n
        image = media.to_image(samples)
        assert media.from_image(image) == samples
        assert media.size_of(image[: media.HEAD]) == (64, n)
    with pytest.raises(ValueError):
        media.size_of(b"not an image at all, but long enough")


def test_rows_with_copies_nulls_and_clashing_columns(spark):
    rows = [(1, "abc", "d"), (2, "abc", "e"), (3, None, "f"), (4, "", "g"), (5, "é" * 5000, "h"), (5, "é" * 5000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Digest string").repartition(3).withColumn("payload", media.payload(F.col("text")))
    folder = common.shared_folder(spark, "media-test")
    index = common.settled(media.store(docs, folder), "index")
    assert index.columns == ["doc_id", "text", "Digest", "_digest", "shard", "offset", "length"]
    places = media.canonical(index.withColumnRenamed("Digest", "other").withColumnRenamed("_digest", "digest"))
    back = {r.digest: r for r in media.read_back(places, folder).collect()}
    heads = {r.digest: r for r in media.headers(places, folder).collect()}
    assert len(back) == 3
    for r in index.collect():
        raw = (r.text or "").encode()
        want = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        got = back[r["_digest"]]
        assert got.payload_sha256 == hashlib.sha256(want).hexdigest() == r["_digest"]
        assert (got.payload_bytes, got.tail_crc32) == (len(want), zlib.crc32(want[-64:]))
        assert (heads[r["_digest"]].width, heads[r["_digest"]].height) == (64, len(want) // 64)
    shard = index.first().shard
    names = media.open_shard(folder, shard).getnames()
    assert all(n.endswith(".png") for n in names) and len(names) == len(set(names))


def test_media_query(spark, small):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op8_media(spark, small).collect()
    assert len(out) == len(docs)
    for r in out:
        raw = docs[r.doc_id]
        want = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        image = media.to_image(want)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), plain_features(want))


def plain_features(samples):
    """The features again, in plain Python."""
    import math
    from collections import Counter

    n, counts = len(samples), Counter(samples)
    mean = sum(samples) / n
    deviation = math.sqrt(max(0.0, sum(x * x for x in samples) / n - mean * mean))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    moved = sum(a != b for a, b in zip(samples[64:], samples))
    return f"rows={n // 64};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};moved={moved}"


def test_payloads_are_stored_once_and_again_under_the_same_name(spark):
    rows = [(i, f"text {i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).withColumn("payload", media.payload(F.col("text")))
    folder = common.shared_folder(spark, "media-once")
    owned = common.settled(media.owners(docs, "doc_id"), "owned")
    first = common.settled(media.store(owned, folder, stores="stores"), "index").collect()
    assert len({(r.shard, r.offset) for r in first if r.shard}) == 7
    entries = [n for s in {r.shard for r in first if r.shard} for n in media.open_shard(folder, s).getnames()]
    assert len(entries) == len(set(entries)) == 7
    again = common.settled(media.store(owned, folder, stores="stores"), "index").collect()
    assert sorted(map(str, again)) == sorted(map(str, first))  # the same shards, so nothing is left over
    back = media.read_back(media.canonical(spark.createDataFrame(first, "doc_id long, text string, digest string, shard string, offset long, length long")), folder).count()
    assert back == 7


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 10, 1000):
        at = np.arange(n)
        key = mix.key_of(np.full(n, 3), np.full(n, 1), 9)
        there = mix.permuted(at, key, np.full(n, n))
        assert sorted(there.tolist()) == at.tolist()
        assert (mix.permuted(there, key, np.full(n, n), back=True) == at).all()


@pytest.mark.parametrize("size, target, block", [(10, 4, 4), (10, 30, 4), (1, 3, 256), (1000, 1234, 64), (64, 64, 64), (65, 1, 64), (100, 0, 7)])
def test_plans_take_their_target(size, target, block):
    p = mix.plan(2, size, target, block, 5)
    words = 0
    for j in range(p.slots):
        turn, at = divmod(j, p.blocks)
        b = int(mix.permuted([at], mix.key_of([2], [turn], 5), [p.blocks])[0])
        words += min(min(block, size - b * block), p.last if j == p.slots - 1 else block)
    assert words == target


def test_targets():
    assert mix.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mix.targets([1000, 10, 10], [1, 2, 3]) == [960, 30, 30]
    assert mix.targets([0, 10], [1, 2]) == [0, 10]
    assert mix.targets([0], [1]) == [0]


def plain_mix_bounds(rows, out):
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for source, some in by.items():
        size = sum(r.size for r in some)
        assert all(r.source_size == size for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.5
    assert len(out) == len(rows)


def test_mix_of_odd_rows(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 17)) for i in range(90)] + [(1, "s1", "w"), (1, "s1", "w"), (None, "s0", "a b"), (500, None, "x y z"), (501, None, None), (502, "empty", ""), (503, "s0", "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(1))
    out = mix.mix(docs, block=8, slots=4).collect()
    plain_mix_bounds(rows, out)
    weights = {None: 2, "empty": 1, "s0": 2, "s1": 3, "s2": 1}
    total = sum(r.size for r in out)
    targets = dict(zip(sorted(weights, key=lambda x: (x is None, x or "")), mix.targets([sum(r.size for r in out if r.source == s) for s in sorted(weights, key=lambda x: (x is None, x or ""))], [1, 2, 3, 1, 2])))
    assert abs(sum(targets.values()) - total) < 1e-6
    assert all(abs(r.target - targets[r.source]) < 1e-9 for r in out)
    again = mix.mix(docs.repartition(5), block=8, slots=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mix.mix(docs.limit(0)).count() == 0


def test_mix_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    plain_mix_bounds(rows, queries.op9_mix(spark, small).collect())


def plain_mix(rows, block, slots, seed):
    """What is taken, by walking over slots and words one by one."""
    names = sorted({s for _, s, _ in rows}, key=lambda x: (x is None, (x or "").encode()))
    by = {s: [(i, len((t or "").split())) for i, own, t in rows if own == s] for s in names}
    sizes = [sum(n for _, n in by[s]) for s in names]
    aims = mix.targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(names))])
    plans = [mix.plan(k, size, aim, block, seed) for k, (size, aim) in enumerate(zip(sizes, aims))]
    words = {s: 0 for s in names}
    for s, p in zip(names, plans):
        for j in range(p.slots):
            turn, at = divmod(j, p.blocks)
            b = int(mix.permuted([at], mix.key_of([p.rank], [turn], seed), [p.blocks])[0])
            words[s] += min(min(block, p.size - b * block), p.last if j == p.slots - 1 else block)
    return words, dict(zip(names, aims)), plans


def test_mix_against_plain_python(spark):
    """Words of each source, and of each document by the order in which documents are packed."""
    rows = [(i, f"s{i % 3}", "w " * (i * 7 % 41)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    words, aims, plans = plain_mix(rows, 8, 4, mix.SEED)
    out = mix.mix(docs, block=8, slots=4).collect()
    for s in words:
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == words[s] and own[0].target == aims[s]
    sized = spark.createDataFrame([(i, len(t.split()), int(s[1])) for i, s, t in rows], "doc_id long, size long, rank int")
    begins = {r.doc_id: r.begins for r in mix.lined_up(sized).collect()}
    taken = {r.doc_id: r.taken for r in out}
    for p in plans:
        count = [0] * p.size
        for j in range(p.slots):
            turn, at = divmod(j, p.blocks)
            b = int(mix.permuted([at], mix.key_of([p.rank], [turn], mix.SEED), [p.blocks])[0])
            for w in range(b * 8, min(p.size, b * 8 + (p.last if j == p.slots - 1 else 8))):
                count[w] += 1
        for i, s, t in rows:
            if s == f"s{p.rank}":
                n = len(t.split())
                assert taken[i] == sum(count[begins[i] : begins[i] + n])
