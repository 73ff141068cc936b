"""Orders of lists and sequences of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences
from ..sources.tables import table


def q45_order(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's orders as they should stand and as they do: which are new, which are gone, how many moved."""
    orders = table(spark, folder, "orders")
    expected = orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("at"))
    later, earlier = F.when(F.col("o_totalprice") > 400_000, 1_000_000).otherwise(0), F.when(F.dayofmonth("o_orderdate") == 3, 5000).otherwise(0)
    actual = orders.where("o_orderpriority <> '1-URGENT'").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + later - earlier).alias("at"))
    found = sequences.order_changes(expected, actual, "o_custkey", "o_orderkey", "at")
    ids = F.sum(F.when(F.col("change") != "moved", F.col("o_orderkey")))
    return found.groupBy("o_custkey", "change").agg(F.count("*").alias("n"), ids.alias("sum_of_ids"))


def q45b_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of orders that the lines of the order say otherwise: status and whether there is any line with a discount."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100_000).cast("string").alias("dear"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"), (F.sum("l_quantity") > 100).cast("string").alias("dear"))
    return sequences.field_changes(orders, lines, ["o_orderkey"], "status", "dear")


#: Expected steps of a run, and whether each is optional.
STEPS = [("signup", True), ("view", False), ("click", True), ("view", False), ("error", True), ("purchase", False), ("purchase", True), ("click", False), ("error", False), ("purchase", False)]


def q46_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """How each user's events follow the expected steps; an event of a small value is a step that failed."""
    events = table(spark, folder, "events").where("value > 40 OR event_id % 3 = 0").select("user_id", "event_id", "event_type", (F.col("value") >= 10).alias("ok"))
    return sequences.sequence_report(sequences.matched_steps(events, "user_id", "event_id", "event_type", "ok", STEPS), "user_id", STEPS)


def _steps() -> str:
    to = sequences.steps_table(STEPS)
    rows = [f"({s}, '{name}', {pos})" for name, row in to.items() for s, pos in enumerate(row) if pos >= 0]
    required = [f"({i}, '{name}')" for i, (name, optional) in enumerate(STEPS) if not optional]
    return f"go(pos, name, step) AS (VALUES {', '.join(rows)}), req(step, name) AS (VALUES {', '.join(required)})"


QUERIES = {"q45_order": q45_order, "q45b_fields": q45b_fields, "q46_sequences": q46_sequences}
ORACLE_SQL = {
    "q45_order": """
    WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey, o_orderkey AS pos FROM orders WHERE o_orderstatus <> 'P'),
    a AS (SELECT o_custkey, o_orderkey, o_orderkey + CASE WHEN o_totalprice > 400000 THEN 1000000 ELSE 0 END - CASE WHEN day(o_orderdate) = 3 THEN 5000 ELSE 0 END AS pos FROM orders WHERE o_orderpriority <> '1-URGENT'),
    c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY e.pos, o_orderkey) AS re, row_number() OVER (PARTITION BY o_custkey ORDER BY a.pos, o_orderkey) AS ra FROM e JOIN a USING (o_custkey, o_orderkey)),
    v AS (SELECT o_custkey, list(ra ORDER BY re) AS v FROM c GROUP BY o_custkey),
    l AS (
      SELECT o_custkey, v, 1 AS i, [1] AS best FROM v
      UNION ALL SELECT o_custkey, v, i + 1, list_append(best, 1 + list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] THEN best[j] ELSE 0 END))::INT) FROM l WHERE i < len(v)),
    m AS (SELECT o_custkey, len(v) - list_max(best) AS n FROM l WHERE i = len(v))
    SELECT o_custkey, 'deleted' AS change, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_of_ids FROM e ANTI JOIN a USING (o_custkey, o_orderkey) GROUP BY o_custkey
    UNION ALL SELECT o_custkey, 'inserted', count(*), sum(o_orderkey)::BIGINT FROM a ANTI JOIN e USING (o_custkey, o_orderkey) GROUP BY o_custkey
    UNION ALL SELECT o_custkey, 'moved', n, NULL FROM m WHERE n > 0
    """,
    "q45b_fields": """
    WITH l AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS status, (sum(l_quantity) > 100)::VARCHAR AS dear FROM lineitem GROUP BY l_orderkey),
    o AS (SELECT o_orderkey, o_orderstatus AS status, (o_totalprice > 100000)::VARCHAR AS dear FROM orders)
    SELECT o_orderkey, 'status' AS field, o.status AS expected, l.status AS actual FROM o JOIN l USING (o_orderkey) WHERE o.status IS DISTINCT FROM l.status
    UNION ALL SELECT o_orderkey, 'dear', o.dear, l.dear FROM o JOIN l USING (o_orderkey) WHERE o.dear IS DISTINCT FROM l.dear
    """,
    "q46_sequences": f"""
    WITH RECURSIVE {_steps()},
    e AS (SELECT user_id, event_type, value >= 10 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value > 40 OR event_id % 3 = 0),
    r AS (
      SELECT DISTINCT user_id, 0::BIGINT AS k, 0 AS pos, -1 AS step, true AS ok FROM e
      UNION ALL SELECT r.user_id, e.k, coalesce(go.step + 1, r.pos), coalesce(go.step, -1), e.ok FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 LEFT JOIN go ON go.pos = r.pos AND go.name = e.event_type),
    m AS (SELECT user_id, step, ok FROM r WHERE step >= 0),
    n AS (SELECT user_id, count(*) AS seen FROM e GROUP BY user_id),
    x AS (SELECT user_id, q.step, q.name, m.ok FROM n CROSS JOIN req q LEFT JOIN m USING (user_id, step))
    SELECT user_id, (SELECT count(*) FROM m WHERE m.user_id = n.user_id) AS n_matched, seen - (SELECT count(*) FROM m WHERE m.user_id = n.user_id) AS n_extra,
      coalesce(string_agg(CASE WHEN ok IS NULL THEN step || ':' || name END, ',' ORDER BY step), '') AS missing, coalesce(string_agg(CASE WHEN NOT ok THEN step || ':' || name END, ',' ORDER BY step), '') AS failed,
      CASE WHEN bool_and(coalesce(ok, false)) THEN 'passed' ELSE 'blocked' END AS status
    FROM n JOIN x USING (user_id) GROUP BY user_id, seen
    """,
}
