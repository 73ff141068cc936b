"""Requests against the plans they come from: a user is a run, an event an action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import requests
from ..sources.tables import settled, table

#: Actions as SQL that Spark and DuckDB both run.
ACTIONS = """
SELECT user_id AS run_id, event_id AS position, event_type, value, '{{"action_id":"A' || CAST(event_id AS VARCHAR(20)) || '","status":"executable","execution_status":"' || CASE WHEN value > 95 THEN 'blocked' ELSE 'executable' END
  || '","risk_class":"' || CASE WHEN event_type = 'error' AND value < 10 THEN 'L3_WRITE' ELSE 'L1' END || '","target_binding":{{"path":"/t","node":' || CAST(user_id AS VARCHAR(20)) || '}},"backend_action":{{"command":"'
  || CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'query' ELSE 'raw-set' END || '"' || CASE WHEN value < 50 THEN ',"path":"/p[' || CAST(event_id AS VARCHAR(20)) || ']"' ELSE '' END
  || ',"destination_path":"/d","element_type":"' || event_type || '","index":' || CAST(event_id % 9 AS VARCHAR(20)) || ',"properties":{{"size":' || CAST(value AS VARCHAR(20)) || ',"bold":true,"off":null}},"raw":{{"action":"replace","xml":"<a/>"}}}}}}' AS action
FROM {events}"""


def _plans(actions: DataFrame) -> DataFrame:
    digest = lambda what: F.sha2(F.concat(F.lit(what), F.col("run_id").cast("string")), 256)
    return actions.select("run_id").distinct().select("run_id", digest("plan").alias("plan_sha256"), digest("before").alias("before_sha256"))


def q44_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of each batch rebuilt from its plan, and each value that the requests have otherwise.

    Requests are what the plans give, with other notations of numbers and fields of the run (no difference), changed values, lost
    and added batches.
    """
    actions = spark.sql(ACTIONS, events=table(spark, folder, "events"))
    expected = settled(requests.batches(requests.operations(actions), _plans(actions)), "rebuilt-batches")
    k = F.col("sequence")
    text = F.when(k % 7 == 3, F.replace("batch", F.lit('"timeout_seconds":120'), F.lit('"timeout_seconds":1.2e2'))).when(k % 11 == 5, F.replace("batch", F.lit('"timeout_seconds":120'), F.lit('"timeout_seconds":90')))
    text = F.coalesce(text, F.when(k % 13 == 6, F.replace("batch", F.lit('"raw":null'), F.lit('"raw":{}'))), F.col("batch"))
    changed = expected.where(k % 17 != 8).select("run_id", "sequence", F.regexp_replace(text, r"^\{", '{"checkpoint_ref":"c",').alias("batch"))
    added = expected.groupBy("run_id").agg(F.max("sequence").alias("m")).where("run_id % 5 = 0").select("run_id", (F.col("m") + 100).alias("sequence"), F.lit('{"batch_id":"x"}').alias("batch"))
    found = requests.differences(expected, changed.unionByName(added))
    return expected.select("run_id", "sequence", F.lit("#").alias("json_path"), F.sha2("batch", 256).alias("expected"), F.lit(None).cast("string").alias("actual")).unionByName(
        found.select("run_id", "sequence", "json_path", F.when(F.col("json_path") == "$", F.sha2("expected", 256)).otherwise(F.col("expected")).alias("expected"), "actual")
    )


def q44b_native(spark: SparkSession, folder: str) -> DataFrame:
    """What the editor gets of each operation."""
    actions = spark.sql(ACTIONS, events=table(spark, folder, "events"))
    return requests.operations(actions).select(F.col("position").alias("event_id"), scalars.canonical_json(requests.native()).alias("native"))


_SIZE = "regexp_replace(value::VARCHAR, '\\.0$', '')"


def _op(result: str = "", ids: str = "", rest: str = "") -> str:
    """SQL of an operation's canonical text; what the key leaves out goes in between, by its name's place."""
    return f"""'{{"command":"' || command || '","destination_path":"/d","element_type":"' || event_type || '"{result},"index":' || position % 9 || '{ids},"path":"' || path || '","properties":{{"bold":true,"off":null,"size":' || {_SIZE} || '}},"raw":' || raw || '{rest}}}'"""


_ORACLE = f"""
WITH a AS ({ACTIONS.format(events='events')}),
ops AS (
  SELECT run_id, position, event_type, value, CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'add' ELSE 'raw-set' END AS command,
    CASE WHEN value < 50 THEN '/p[' || position || ']' ELSE '/t' END AS path, event_type = 'error' AND value < 10 AS alone, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN '{{"action":"replace","xml":"<a/>"}}' ELSE 'null' END AS raw
  FROM a WHERE value <= 95 AND event_type <> 'signup'),
o AS (SELECT *, coalesce(sum(alone::INT) OVER (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ops),
p AS (SELECT *, CASE WHEN alone THEN 0 ELSE (row_number() OVER (PARTITION BY run_id, island, alone ORDER BY position) - 1) // 12 END AS part FROM o),
b AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY island, alone, part) AS sequence FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, sequence ORDER BY position) AS i FROM b),
k AS (SELECT *, printf('%03d-%03d', sequence, i) AS no, sha256(sha256('plan' || run_id) || chr(10) || sha256('before' || run_id) || chr(10) || sequence || chr(10) || {_op()}) AS idem FROM n),
"""
_EXPECTED = _op(
    ""","expected_result":{"expected":true,"failure_code":"DFR-POSTCONDITION-FAILED","json_pointer":null,"predicate_id":"POST-OP-' || no || '","target_ref":"' || path || '","type":"property_equals"},"idempotency_key":"' || idem || '\"""",
    ""","manual_confirmation_ref":null,"operation_id":"OP-' || no || '\"""",
    ""","risk_class":"' || CASE WHEN alone THEN 'L3_WRITE' ELSE 'L1' END || '","source_action_id":"A' || position || '","target_binding":{"node":' || run_id || ',"path":"/t"}""",
)
_ORACLE += f"""
e AS (
  SELECT run_id, sequence, '{{"atomicity":"stop_on_first_error","batch_id":"BATCH-' || printf('%03d', sequence) || '","max_operations":' || count(*) || ',"operations":[' || string_agg({_EXPECTED}, ',' ORDER BY i)
    || '],"postconditions":[{{"expected":true,"failure_code":"DFR-VALIDATE-FAILED","json_pointer":null,"predicate_id":"POST-B-' || printf('%03d', sequence) || '","target_ref":"working_docx","type":"validate_clean"}}],"preconditions":[],"sequence":' || sequence || ',"timeout_seconds":120}}' AS batch
  FROM k GROUP BY run_id, sequence)
SELECT run_id, sequence, '#' AS json_path, sha256(batch) AS expected, NULL AS actual FROM e
UNION ALL SELECT run_id, sequence, '$', sha256(batch), NULL FROM e WHERE sequence % 17 = 8
UNION ALL SELECT run_id, max(sequence) + 100, '$', NULL, '{{"batch_id":"x"}}' FROM e WHERE run_id % 5 = 0 GROUP BY run_id
UNION ALL SELECT run_id, sequence, '$.timeout_seconds', '120', '90' FROM e WHERE sequence % 17 <> 8 AND sequence % 7 <> 3 AND sequence % 11 = 5
UNION ALL SELECT run_id, sequence, '$.operations[' || (i - 1) || '].raw', 'null', '{{}}' FROM k WHERE sequence % 17 <> 8 AND sequence % 7 <> 3 AND sequence % 11 <> 5 AND sequence % 13 = 6 AND raw = 'null'
"""

_NATIVE = f"""
SELECT event_id, CASE event_type WHEN 'view' THEN '{{"command":"set"' WHEN 'click' THEN '{{"command":"move"' WHEN 'purchase' THEN '{{"command":"add"' ELSE '{{"action":"replace","command":"raw-set"' END || ',"index":' || event_id % 9
  || ',"path":"' || CASE WHEN value < 50 THEN '/p[' || event_id || ']' ELSE '/t' END || '","props":{{"bold":"True","size":"' || value::VARCHAR || '"}}'
  || CASE event_type WHEN 'click' THEN ',"to":"/d"' WHEN 'purchase' THEN ',"type":"purchase"' WHEN 'view' THEN '' ELSE ',"xml":"<a/>"' END || '}}' AS native
FROM events WHERE value <= 95 AND event_type <> 'signup'
""".replace("{{", "{").replace("}}", "}")

QUERIES = {"q44_requests": q44_requests, "q44b_native": q44b_native}
ORACLE_SQL = {"q44_requests": _ORACLE, "q44b_native": _NATIVE}
