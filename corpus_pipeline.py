"""The corpus pipeline: stages that each read what the stage before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm import bpe, common, jaccard, mix, pii, toxicity

TOXIC_FROM = 0.5  #: documents with this score or more go
WORDS, NUM, DEN = 5, 8, 10  #: near duplicates: five-word shingles, similarity 8 / 10 or more


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, into="toxic_score")
    return scored.where(F.col(scored.columns[-1]) < TOXIC_FROM).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect the one with the smallest id; of rows with equal id and text one."""
    kept = jaccard.kept(docs, k=WORDS, num=NUM, den=DEN)
    return kept


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    out = pii.pseudonymised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: each source's words are within about its largest document of its target.

    Documents without words stay as they are; columns may have any names.
    """
    copies = common.settled(mix.whole_documents(mix.mix(docs)), "copies", rows=docs.count())
    id_, source, size, times = common.fresh(docs, "mix_doc_id", "mix_source", "mix_size", "mix_copies")
    copies = common.narrow(copies.where("copies > 0").toDF(id_, source, size, times))
    same = docs["doc_id"].eqNullSafe(copies[id_]) & docs["source"].eqNullSafe(copies[source]) & (common.words(docs["text"]) == copies[size])
    again = F.explode(F.sequence(F.lit(1), F.col(times)))
    return docs.join(copies, same).withColumn(times, again).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and their digest for every document of the mix."""
    common.small_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=["doc_id"])
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", one_of_near_copies),
    ("personal data", hide_personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]
#: SQL can't express the classifier, the surrogates' stream or the merges; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not encode:
            docs = common.settled(docs, "stage-" + name.replace(" ", "-"), free=True)
    return docs
