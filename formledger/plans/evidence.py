"""Evidence manifests made of customers, orders and their lines: three generations, references by type, circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests
from ..sources.tables import settled, table

#: The tables of the manifests, as SQL that Spark and DuckDB both run.  A customer is a manifest, an order an artifact and its
#: evidence (orders of one month share an artifact id), lines are results, objects and relations.
TABLES = {
    "manifests": """
        SELECT c_custkey AS manifest_id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 2 ELSE 1 END AS version,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'pre_acceptance' WHEN 'MACHINERY' THEN 'post_acceptance' WHEN 'FURNITURE' THEN 'later' ELSE 'reporting' END AS generation,
          CASE WHEN c_acctbal < 1000 THEN 'broken' WHEN c_acctbal > 9000 THEN 'fine' ELSE 'complete' END AS status,
          CASE WHEN c_acctbal < 5000 THEN 'passed' ELSE 'failed' END AS gate_status
        FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})""",
    "artifacts": """
        SELECT o_custkey AS manifest_id, 'A' || CAST(100 * year(o_orderdate) + month(o_orderdate) AS VARCHAR(9)) AS artifact_id, o_orderkey AS position,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'final_acceptance' WHEN '2' THEN 'report' WHEN '3' THEN 'plan' WHEN '4' THEN 'log' ELSE 'snapshot' END AS kind,
          CASE o_orderstatus WHEN 'P' THEN 'reporting-result' ELSE 'plan' END AS schema_id,
          CASE WHEN o_totalprice < 450000 THEN 'runs/' || CAST(o_orderkey AS VARCHAR(20)) ELSE '' END AS path,
          CASE WHEN day(o_orderdate) < 28 THEN 'run_relative' ELSE 'absolute' END AS path_kind,
          md5(CAST(o_orderkey AS VARCHAR(20))) || md5(o_orderpriority) AS sha256, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, '1.0' AS schema_version,
          o_totalprice > 100000 AS required, CASE WHEN o_orderstatus <> 'O' THEN 'R' || CAST(o_orderkey AS VARCHAR(20)) END AS producer_result_id
        FROM {orders}""",
    "evidence": """
        SELECT a.manifest_id, 'E' || CAST(o_orderkey AS VARCHAR(20)) AS evidence_id, CASE WHEN day(o_orderdate) = 9 THEN 'A0' ELSE artifact_id END AS artifact_id, path, path_kind, sha256,
          CASE WHEN day(o_orderdate) = 13 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, schema_id, schema_version, required,
          CASE WHEN day(o_orderdate) = 14 THEN NULL ELSE producer_result_id END AS producer_result_id
        FROM {orders} JOIN {artifacts} a ON o_orderkey = position""",
    "depends": """
        SELECT manifest_id, evidence_id, artifact_id AS depends_on FROM {evidence}
        UNION ALL SELECT o_custkey, 'E' || CAST(o_orderkey AS VARCHAR(20)), 'E' || CAST(before AS VARCHAR(20)) FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM {orders}) WHERE before IS NOT NULL
        UNION ALL SELECT o_custkey, 'E' || CAST(min(o_orderkey) AS VARCHAR(20)), 'E' || CAST(max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS VARCHAR(20)) FROM {orders} GROUP BY o_custkey HAVING max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) IS NOT NULL AND count(*) % 2 = 0
        UNION ALL SELECT o_custkey, 'E' || CAST(o_orderkey AS VARCHAR(20)), 'R' || CAST(o_orderkey AS VARCHAR(20)) FROM {orders} WHERE day(o_orderdate) = 5""",
    "relations": """
        SELECT o_custkey AS manifest_id, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) AS relation_id,
          CASE l_returnflag WHEN 'A' THEN 'artifact' WHEN 'N' THEN 'evidence' ELSE 'result' END AS source_type,
          CASE l_returnflag WHEN 'N' THEN 'E' || CAST(l_orderkey AS VARCHAR(20)) ELSE 'A' || CAST(100 * year(o_orderdate) + CASE WHEN day(l_shipdate) = 3 THEN 13 ELSE month(o_orderdate) END AS VARCHAR(9)) END AS source_id,
          CASE l_linenumber WHEN 1 THEN 'artifact' WHEN 2 THEN 'evidence' WHEN 3 THEN 'issue' WHEN 4 THEN 'action' WHEN 5 THEN 'review' ELSE 'acceptance' END AS target_type,
          CASE l_linenumber WHEN 1 THEN 'A' || CAST(100 * year(o_orderdate) + CASE WHEN day(l_shipdate) = 4 THEN 13 ELSE month(o_orderdate) END AS VARCHAR(9)) WHEN 2 THEN 'E' || CAST(o_orderkey AS VARCHAR(20)) ELSE 'O' || CAST(l_suppkey AS VARCHAR(20)) END AS target_id,
          CASE WHEN l_quantity > 45 THEN 'resembles' WHEN l_linestatus = 'F' THEN 'derived_from' ELSE 'supports' END AS relation_type
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "results": "SELECT DISTINCT o_custkey AS manifest_id, 'R' || CAST(l_orderkey AS VARCHAR(20)) AS result_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'",
    "objects": "SELECT o_custkey AS manifest_id, CASE l_linenumber WHEN 3 THEN 'issue' WHEN 4 THEN 'action' WHEN 5 THEN 'review' ELSE 'acceptance' END AS object_type, 'O' || CAST(l_suppkey AS VARCHAR(20)) AS object_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber > 2 AND l_discount < 0.08",
    "missing": "SELECT o_custkey AS manifest_id, 'plan' AS kind FROM {orders} GROUP BY o_custkey HAVING max(CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 1 ELSE 0 END) = 0",
}


def q43_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All that is wrong with the manifests."""
    known = {t: table(spark, folder, t) for t in ("customer", "orders", "lineitem")}
    made: dict[str, DataFrame] = {}
    for name, sql in TABLES.items():
        made[name] = settled(spark.sql(sql, **{k: v for k, v in (known | made).items() if "{%s}" % k in sql}), name)
    found = manifests.violations(**made).withColumn("manifest_status", F.lit(None).cast("string"))
    status = manifests.statuses(made["manifests"], found).select("manifest_id", F.lit("*").alias("entity_id"), F.array_join("codes", ",").alias("code"), F.col("status").alias("manifest_status"))
    return found.unionByName(status)


def _listed(values: tuple) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _oracle() -> str:
    names = {t: t for t in ("customer", "orders", "lineitem")} | {t: f"m_{t}" for t in TABLES}
    made = ",\n".join(f"m_{t} AS ({sql.format(**names)})" for t, sql in TABLES.items())
    bad = " OR ".join(f"(generation = '{g}' AND {f} = '{v}')" for g, f, v in manifests.FORBIDDEN)
    needed = "\n".join(f"UNION ALL SELECT manifest_id, artifact_id, '{f}_required' FROM m_artifacts WHERE required AND ({f} IS NULL OR {f}::VARCHAR = '')" for f in manifests.WHEN_REQUIRED)
    differs = "\n".join(f"UNION ALL SELECT manifest_id, evidence_id, '{f}_differs' FROM pairs WHERE position IS NOT NULL AND {f} IS DISTINCT FROM a_{f}" for f in manifests.REPEATED)
    copies = ", ".join(f"a.{f} AS a_{f}" for f in manifests.REPEATED)
    ends = " UNION ALL ".join(f"SELECT r.manifest_id, relation_id || '.{s}' AS name, CASE WHEN version = 2 THEN 'artifact' ELSE {s}_type END AS object_type, {s}_id AS object_id FROM m_relations r JOIN m_manifests USING (manifest_id)" for s in ("source", "target"))
    return f"""
    WITH RECURSIVE {made},
    pairs AS (SELECT e.*, a.position, {copies} FROM m_evidence e LEFT JOIN (SELECT * FROM m_artifacts QUALIFY row_number() OVER (PARTITION BY manifest_id, artifact_id ORDER BY position DESC) = 1) a USING (manifest_id, artifact_id)),
    ids AS (SELECT manifest_id, 'artifact' AS object_type, artifact_id AS object_id FROM m_artifacts UNION SELECT manifest_id, 'evidence', evidence_id FROM m_evidence UNION SELECT manifest_id, object_type, object_id FROM m_objects),
    ends AS ({ends}),
    edges AS (SELECT DISTINCT manifest_id, evidence_id AS a, depends_on AS b FROM m_depends SEMI JOIN m_evidence e ON m_depends.manifest_id = e.manifest_id AND depends_on = e.evidence_id),
    reach AS (SELECT manifest_id, a, b FROM edges UNION SELECT r.manifest_id, r.a, e.b FROM reach r JOIN edges e ON r.manifest_id = e.manifest_id AND r.b = e.a),
    own AS (SELECT manifest_id, a AS n FROM reach WHERE a = b),
    forward AS (SELECT manifest_id, n FROM own UNION SELECT r.manifest_id, r.a FROM reach r JOIN own ON r.manifest_id = own.manifest_id AND r.b = own.n),
    backward AS (SELECT manifest_id, n FROM own UNION SELECT r.manifest_id, r.b FROM reach r JOIN own ON r.manifest_id = own.manifest_id AND r.a = own.n),
    found AS (
      SELECT manifest_id, manifest_id::VARCHAR AS entity_id, 'status' AS code FROM m_manifests WHERE status NOT IN ({_listed(manifests.STATUSES)})
      UNION ALL SELECT manifest_id, manifest_id::VARCHAR, 'generation' FROM m_manifests WHERE version = 1 AND generation NOT IN ({_listed(manifests.GENERATIONS)})
      UNION ALL SELECT manifest_id, manifest_id::VARCHAR, 'incomplete_not_broken' FROM m_manifests SEMI JOIN m_missing USING (manifest_id) WHERE status <> 'broken'
      UNION ALL SELECT manifest_id, manifest_id::VARCHAR, 'incomplete_gate_passed' FROM m_manifests SEMI JOIN m_missing USING (manifest_id) WHERE gate_status = 'passed'
      UNION ALL SELECT manifest_id, artifact_id, 'artifact_twice' FROM m_artifacts GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT manifest_id, evidence_id, 'evidence_twice' FROM m_evidence GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT manifest_id, artifact_id, 'artifact_forbidden' FROM m_artifacts JOIN m_manifests USING (manifest_id) WHERE version = 1 AND ({bad})
      UNION ALL SELECT manifest_id, artifact_id, 'artifact_kind' FROM m_artifacts JOIN m_manifests USING (manifest_id) WHERE version = 2 AND kind NOT IN ({_listed(manifests.KINDS)})
      UNION ALL SELECT manifest_id, manifest_id::VARCHAR, 'required_kind_absent' FROM m_manifests ANTI JOIN (SELECT * FROM m_artifacts WHERE kind IN ({_listed(manifests.REQUIRED_OF['reporting'])})) USING (manifest_id) WHERE version = 1 AND generation = 'reporting'
      {needed}
      UNION ALL SELECT manifest_id, artifact_id, 'path_kind_run_relative' FROM m_artifacts WHERE required AND path_kind <> 'run_relative'
      {differs}
      UNION ALL SELECT manifest_id, evidence_id, 'artifact_unresolved' FROM pairs WHERE position IS NULL
      UNION ALL SELECT manifest_id, id, 'producer_unresolved' FROM (SELECT manifest_id, artifact_id AS id, producer_result_id AS result_id FROM m_artifacts UNION ALL SELECT manifest_id, evidence_id, producer_result_id FROM m_evidence) ANTI JOIN m_results USING (manifest_id, result_id) WHERE result_id IS NOT NULL
      UNION ALL SELECT d.manifest_id, d.evidence_id || '>' || depends_on, 'dependency_unresolved' FROM m_depends d
        WHERE NOT EXISTS (FROM m_artifacts a WHERE a.manifest_id = d.manifest_id AND artifact_id = depends_on) AND NOT EXISTS (FROM m_evidence e WHERE e.manifest_id = d.manifest_id AND e.evidence_id = depends_on) AND NOT EXISTS (FROM m_results r WHERE r.manifest_id = d.manifest_id AND result_id = depends_on)
      UNION ALL SELECT manifest_id, relation_id, 'relation_type' FROM m_relations JOIN m_manifests USING (manifest_id) WHERE relation_type NOT IN ({_listed(manifests.RELATIONS)}) AND (version = 2 OR relation_type NOT IN ({_listed(manifests.OLD_RELATIONS)}))
      UNION ALL SELECT manifest_id, name, 'object_type' FROM ends WHERE object_type NOT IN ({_listed(manifests.OBJECTS)})
      UNION ALL SELECT manifest_id, name, object_type || '_unresolved' FROM ends ANTI JOIN ids USING (manifest_id, object_type, object_id) WHERE object_type IN ({_listed(manifests.OBJECTS)})
      UNION ALL SELECT manifest_id, n, 'dependency_circle' FROM (SELECT manifest_id, n FROM forward INTERSECT SELECT manifest_id, n FROM backward)),
    each AS (SELECT DISTINCT manifest_id, entity_id, code FROM found),
    codes AS (SELECT manifest_id, list(DISTINCT code) AS codes FROM each GROUP BY manifest_id)
    SELECT manifest_id, entity_id, code, NULL::VARCHAR AS manifest_status FROM each
    UNION ALL SELECT manifest_id, '*', coalesce(array_to_string(list_sort(CASE WHEN status <> 'broken' THEN list_append(codes, 'status_not_broken') ELSE codes END), ','), ''), CASE WHEN codes IS NULL THEN status ELSE 'broken' END
    FROM m_manifests LEFT JOIN codes USING (manifest_id)
    """


QUERIES = {"q43_manifests": q43_manifests}
ORACLE_SQL = {"q43_manifests": _oracle()}
