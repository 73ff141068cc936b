import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from formledger.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def test_every_kind_of_code_point(both):
    v, known = both
    points = [c for c in range(0, 0x110000, 101) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points]
    assert [ids(x) for x in v.encode_all(texts)] == [known.encode_ordinary(t) for t in texts]


def test_random_texts_and_small_windows(both, monkeypatch):
    v, known = both
    draw = random.Random(5)
    texts = ["".join(draw.choice(" 's't're'll  \n\n\t ab1é漢٣’!-　dmvl") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    want = [known.encode_ordinary(t) for t in texts]
    assert [ids(x) for x in v.encode_all(texts)] == want
    monkeypatch.setattr(bpe, "WINDOW", 7)
    assert [ids(x) for x in v.encode_all(texts)] == want


def test_long_pieces_and_round_trip(both):
    v, known = both
    for text in ("ab" * 4000, " " * 5000, "!?" * 3000 + "x", "", "\n"):
        got = v.encode(text)
        assert ids(got) == known.encode_ordinary(text)
        assert v.decode(got, v.offsets(got)) == v.decode(got) == text.encode()


def test_composition_is_associative():
    _, then, result, _ = bpe._automaton()
    n = len(result)
    a, b, c = (x.reshape(-1) for x in np.meshgrid(*[np.arange(n)] * 3))
    assert (then[then[a, b], c] == then[a, then[b, c]]).all()


def test_columns_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "it's", "x", b"i"), (1, "it's", "x", b"i"), (2, None, "y", None), (3, "", "z", None)], "doc_id long, text string, IDS string, bpe_text binary")
    out = bpe.decode(bpe.encode(rows, PATH), PATH, ids="_ids")
    assert out.columns == ["doc_id", "text", "IDS", "bpe_text", "_ids", "offsets", "decoded"]
    assert out.count() == 4
    empty = bpe.encode(rows.limit(0), PATH)
    assert empty.count() == 0


def test_query(spark, small):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    assert len(got) == len(docs)
    for r in docs:
        want = known.encode_ordinary(r.t)
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.t.encode()).hexdigest()
