"""Files and tables that queries write into the shared folder and read back: texts, contracts, evidence, published tables, heavy writes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, repair
from ..sources import blobs, contract, files, once
from ..sources.tables import scratch, table
from . import products


def _texts(spark: SparkSession, folder: str) -> str:
    """A folder with five of six documents as text files."""
    path = scratch(spark, "texts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = blobs.opened(path)
        made = set()
        for batch in batches:
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                sub = f"{lang}/{doc_id // 5000}"  # folders are listed by tasks, so none holds too many files
                if sub not in made:
                    system.create_dir(f"{base}/{sub}", recursive=True)
                    made.add(sub)
                with system.open_output_stream(f"{base}/{sub}/{doc_id}.md") as f:
                    f.write(text or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    docs = table(spark, folder, "documents").where("doc_id % 6 <> 5")
    docs.select("doc_id", F.coalesce("lang", F.lit("none")), F.col("text").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


def _doc(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([0-9]+)\.md$", 1).cast("long").alias("doc_id")


def q51_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that texts may not or must have, by file."""
    rules = [("marker", "###", True), ("marker", " | ", True), ("no_article", " the ", False)]
    return files.token_scan(spark, _texts(spark, folder), rules).select(_doc(), "token", "code")


def q51b_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files with size and digest, and the digest of their ranges' tree."""
    path = _texts(spark, folder)
    parts = blobs.ranges(spark, path, "*.md")  # one reading for both
    own = blobs.whole(parts, path).select(_doc(), "sha256", "size_bytes")
    trees = blobs.digests(parts).select(_doc(), "n_parts", "tree_sha256")
    return own.join(trees, "doc_id")


def q51c_evidence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Expected evidence files that no file stands for, and how many tests have theirs."""
    expected = table(spark, folder, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("test_id"), F.concat(F.lit("evidence/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    lost = ledger.missing_files(expected, files.inventory(spark, _texts(spark, folder), "*.md"))
    return lost.select("test_id", "path")


def q51d_retired_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of pages in folders that are no longer used."""
    k = F.col("page_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("format_runs/r"), k.cast("string"), F.lit("/rules"))).when(k % 5 == 1, F.lit("a/format_rules/b")).when(k % 5 == 2, F.lit("format_runs/rules/x")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return files.retired_paths(table(spark, folder, "pages").select("page_id", path.alias("path")))


def q51e_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Slots of a contract written as JSON lines: brands are roles, types of parts slots, sizes say what is required."""
    kind = F.when(F.col("p_size") < 15, "required").when(F.col("p_size") < 35, "optional").otherwise("forbidden")
    of = lambda k: F.array_sort(F.collect_set(F.when(kind == k, F.col("p_type")))).alias(f"{k}_slots")
    path = scratch(spark, "contract")
    table(spark, folder, "part").groupBy(F.col("p_brand").alias("role_kind")).agg(F.lit("brand").alias("category"), *[of(k) for k in ("required", "optional", "forbidden")]).write.json(path)
    return contract.slots(spark, path)


def q51f_published(spark: SparkSession, folder: str) -> DataFrame:
    """A table published twice, dealt otherwise the second time, as it is read back."""
    path = scratch(spark, "published")
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"))
    once.write(sums.repartition(3), path)
    once.write(sums.repartition(2, "l_returnflag"), path)
    return once.read(spark, path)


def q51g_inverted(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows from brands to parts."""
    return repair.inverted(table(spark, folder, "part").withColumn("brand", F.when(F.col("p_size") > 3, F.col("p_brand"))), "brand", "p_partkey")


def q51h_heavy_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Heavy writes (lines) without what authorises them: path, match, payload, decision, part, batch."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    xml = F.concat(F.lit("<w:p>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</w:p>"))
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("operation_id"), F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "L2").otherwise("L3_WRITE").alias("risk_class"),
        F.when(k % 11 == 0, "set").otherwise("raw-set").alias("command"), F.when(F.col("l_tax") > 0.07, "//w:p").otherwise("/w:body[1]/w:p[2]").alias("xpath"), F.when(F.col("l_discount") > 0.09, 2).otherwise(1).alias("expected_match_count"),
        xml.alias("xml"), F.when(F.col("l_quantity") > 45, F.lit("0")).otherwise(F.sha2(xml, 256)).alias("xml_sha256"), F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("review_id"), F.lit("document").alias("part"),
        F.sha2(F.col("l_linenumber").cast("string"), 256).alias("precondition_sha256"), F.when(F.col("l_linestatus") == "F", 1).otherwise(F.col("l_linenumber") % 2 + 1).alias("n_in_batch"),
    )
    bound = F.sha2(F.concat(F.lit("<w:p>"), F.col("p_size").cast("string"), F.lit("</w:p>")), 256)
    decisions = table(spark, folder, "part").where("p_partkey % 7 > 0").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("review_id"), F.when(F.col("p_retailprice") > 905, "approved").otherwise("rejected").alias("decision_status"), bound.alias("payload_sha256"))
    parts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("document").alias("part_name"), F.sha2((F.col("o_orderkey") % 3 + 1).cast("string"), 256).alias("sha256"))
    return repair.heavy_write_problems(lines.withColumn("operation_id", F.col("operation_id")), decisions, parts)


def q52_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the evidence of runs (customers; their orders are artifacts) is whole."""
    path = F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string"))
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    orders = table(spark, folder, "orders")
    artifacts = orders.select(
        F.col("o_custkey").cast("string").alias("run_id"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("artifact_id"), F.when(F.col("o_orderstatus") == "F", "plan").otherwise("log").alias("kind"),
        path.alias("path"), sha.alias("sha256"), F.floor("o_totalprice").cast("long").alias("size_bytes"),
    )
    inventory = orders.where("o_orderpriority <> '1-URGENT' OR o_totalprice > 50000").select(path.alias("path"), F.when(F.col("o_totalprice") > 480000, "0").otherwise(sha).alias("sha256"), F.floor("o_totalprice").cast("long").alias("size_bytes"))
    references = table(spark, folder, "lineitem").where("l_quantity > 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("run_id"), F.concat(F.when(F.col("l_discount") > 0.08, "B").otherwise("A"), F.col("o_orderkey").cast("string")).alias("artifact_id"))
    found = products.acceptance(artifacts, references, inventory, ["plan", "log"])
    return found.select("run_id", "status", F.array_join("codes", ",").alias("codes"))


QUERIES = {
    "q51_text_files": q51_text_files, "q51b_inventory": q51b_inventory, "q51c_evidence_files": q51c_evidence_files, "q51d_retired_paths": q51d_retired_paths, "q51e_contract": q51e_contract,
    "q51f_published": q51f_published, "q51g_inverted": q51g_inverted, "q51h_heavy_writes": q51h_heavy_writes, "q52_acceptance": q52_acceptance,
}
ORACLE_SQL = {
    "q51_text_files": """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 6 <> 5)
    SELECT doc_id, '###' AS token, 'marker' AS code FROM d WHERE contains(text, '###') UNION ALL SELECT doc_id, ' | ', 'marker' FROM d WHERE contains(text, ' | ') UNION ALL SELECT doc_id, ' the ', 'no_article' FROM d WHERE NOT contains(text, ' the ')
    """,
    "q51b_inventory": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size_bytes, 1::BIGINT AS n_parts, sha256(sha256(coalesce(text, ''))) AS tree_sha256 FROM documents WHERE doc_id % 6 <> 5",
    "q51c_evidence_files": "SELECT 't' || doc_id AS test_id, 'evidence/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 6 = 5",
    "q51d_retired_paths": """
    WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'format_runs/r' || page_id || '/rules' WHEN 1 THEN 'a/format_rules/b' WHEN 2 THEN 'format_runs/rules/x' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)
    SELECT * FROM p WHERE regexp_matches(path, '(^|/)format_runs/[^/]+/rules(/|$)') OR regexp_matches(path, '(^|/)format_rules(/|$)')
    """,
    "q51e_contract": "SELECT DISTINCT p_brand AS role_kind, 'brand' AS category, p_type AS slot, CASE WHEN p_size < 15 THEN 'required' WHEN p_size < 35 THEN 'optional' ELSE 'forbidden' END AS requirement FROM part",
    "q51f_published": "SELECT l_suppkey, l_returnflag, sum(trunc(l_quantity)::BIGINT)::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY ALL",
    "q51g_inverted": "SELECT p_brand AS key, p_partkey FROM part WHERE p_size > 3",
    "q51h_heavy_writes": """
    WITH l AS (SELECT *, '<w:p>' || trunc(l_quantity)::INT || '</w:p>' AS xml, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS operation_id FROM lineitem WHERE l_returnflag <> 'R'),
    x AS (SELECT operation_id, CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 = 0 THEN 'heavy_not_raw' WHEN l_tax > 0.07 THEN 'heavy_xpath' WHEN l_discount > 0.09 THEN 'heavy_match_count' WHEN l_quantity > 45 THEN 'heavy_payload_hash'
        WHEN p_partkey IS NULL OR p_retailprice <= 905 THEN 'heavy_not_approved' WHEN '<w:p>' || p_size || '</w:p>' <> xml THEN 'heavy_not_bound' WHEN o_orderkey IS NULL OR o_orderkey % 3 + 1 <> l_linenumber THEN 'heavy_part_changed'
        WHEN l_linestatus <> 'F' AND l_linenumber % 2 + 1 <> 1 THEN 'heavy_not_alone' END AS code
      FROM l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 > 0) ON p_partkey = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey)
    SELECT * FROM x WHERE code IS NOT NULL
    """,
    "q52_acceptance": """
    WITH k AS (SELECT o_custkey::VARCHAR AS run_id, unnest(list_filter([
        CASE WHEN max((o_orderstatus = 'F')::INT) = 0 OR min((o_orderstatus = 'F')::INT) = 1 THEN 'kinds_missing' END,
        CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_totalprice <= 50000) THEN 'artifact_missing' END,
        CASE WHEN bool_or(o_totalprice > 480000) THEN 'artifact_hash' END,
        CASE WHEN bool_or(floor(o_totalprice) <= 0) THEN 'size_positive' END], lambda c: c IS NOT NULL)) AS code FROM orders GROUP BY o_custkey
      UNION SELECT o_custkey::VARCHAR, 'reference_dangling' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49 AND l_discount > 0.08),
    c AS (SELECT run_id, array_to_string(list_sort(list(code)), ',') AS codes FROM k GROUP BY run_id)
    SELECT DISTINCT o_custkey::VARCHAR AS run_id, CASE WHEN codes IS NULL THEN 'accepted' ELSE 'blocked' END AS status, coalesce(codes, '') AS codes FROM orders LEFT JOIN c ON run_id = o_custkey::VARCHAR
    """,
}
