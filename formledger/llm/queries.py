"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, graph_ann, html_text, jaccard, lexical, licenses, media, mix, pii, quality, runs, secrets, toxicity


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their way back, as digests."""
    common.small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    return bpe.decode(encoded, path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return pii.pseudonymised(common.table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_ann.search(vectors, lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored image, and what the stored bytes say about it."""
    common.small_batches(spark)
    folder = common.shared_folder(spark, "media")
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.payload(F.col("text")).alias("payload")
    )
    index = common.settled(media.store(media.owners(docs, "doc_id"), folder, stores="stores"), "media-index")
    places = media.canonical(index)
    stored = media.read_back(places, folder).join(media.headers(places, folder), "digest")
    return index.select("doc_id", "n_bytes", "digest").join(stored, "digest").drop("digest")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes from every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.mix(docs)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    common.small_batches(spark)
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document: its own, or that of the nearest folder above; folders are source, thousand and hundred of ids."""
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path"))).withColumnRenamed("id", "doc_id")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by links of three-word shingles at 90 of 100."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.join(docs, k=3, num=90, den=100).withColumnRenamed("id", "doc_id").drop("digest")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows of one fold are never fitted on."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of every document."""
    found = secrets.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.listed("assign", "access", "hex")
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.listed("assign", "access", "hex", "random").alias("spans"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, one id in ten with a repeated tail."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.detect(docs, tails=True).withColumnRenamed("id", "doc_id").drop("n_words")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every item of the benchmark."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lexical.search(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether the rules of its language and source keep it."""
    found = quality.judged(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_licenses": op3_licenses, "op4_jaccard": op4_jaccard, "op5_toxicity": op5_toxicity, "op6_pii": op6_pii, "op7_ann": op7_ann, "op8_media": op8_media, "op9_mix": op9_mix, "op10_secrets": op10_secrets, "op11_runs": op11_runs, "op12_search": op12_search, "op13_quality": op13_quality}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": jaccard.oracle(3, 90, 100),
    "op12_search": lexical.oracle(),
    "op13_quality": quality.oracle(),
    "op3_licenses": licenses.oracle("coalesce(source, '') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id"),
}
