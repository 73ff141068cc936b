"""Streams over the event log, run to the end of what is there, and tree facts from markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import scratch, table
from ..streaming import stages, tracker

VOID = frozenset("area base br col hr img input link meta source track wbr".split())


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a file stream (its name as a pattern, for a stream reads what matches one)."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder_of(spark: SparkSession, stream: DataFrame, mode: str, what: str) -> str:
    """Run a stream over all that is there now; each batch is written to a folder of its own number, so a batch that runs again replaces itself."""
    out, marks = scratch(spark, what), scratch(spark, f"{what}-marks")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def _drained(spark: SparkSession, stream: DataFrame, mode: str, what: str) -> DataFrame:
    out = _folder_of(spark, stream, mode, what)
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def q25_stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and kind, each event once."""
    events = tracker.once(_stream(spark, folder).withColumnRenamed("event_type", "kind"), key="event_id")
    counts = tracker.gate_counts(events, late=None)
    rows = _drained(spark, counts, "update", "stream-counts")
    return rows.groupBy(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "kind").agg(F.max("n").alias("n"))


def q25b_stream_tracker(spark: SparkSession, folder: str) -> DataFrame:
    """Chain head, number of results and last stage of each run, as the stream leaves them."""
    events = _stream(spark, folder).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("order"), F.col("event_type").alias("stage"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("content"), "ts")
    rows = _drained(spark, tracker.track(events), "update", "stream-tracker").where("alert IS NULL OR alert = 'late'")
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("chain_head", "n_events", "last_stage"), "n_events").alias("s"))
    return last.select("run_id", "s.*")


def q25c_stage_tracker(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of which some results never came and some came twice, in files that mix all times: chain head with markers, late results, alerts.

    A last result, far ahead in time, lets all timers run out.
    """
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    numbered = events.withColumn("order", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")).cast("long"))
    came = numbered.where("order % 17 <> 5").withColumn("content", F.concat_ws("|", "run_id", F.col("order").cast("string"), "stage"))
    twice = F.explode(F.when(F.col("order") % 23 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = came.withColumn("_n", twice).select("run_id", "order", "stage", "content", "ts", F.pmod(F.xxhash64("event_id", "_n"), F.lit(4)).alias("file"))
    source = scratch(spark, "stage-results")
    rows.repartition(4, "file").drop("file").write.parquet(f"{source}/results")
    end = spark.read.parquet(f"{source}/results").agg(F.max("ts").alias("ts")).select(F.lit("~").alias("run_id"), F.lit(1).cast("long").alias("order"), F.lit("purchase").alias("stage"), F.lit("").alias("content"), (F.col("ts") + F.expr("interval 400 days")).alias("ts"))
    end.write.parquet(f"{source}/~end")
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    tracked = _folder_of(spark, stages.track(stream, late="200 days", ends=("purchase",)), "update", "stages")
    found = spark.read.schema(stages.OUT).option("recursiveFileLookup", "true").parquet(tracked).where("run_id <> '~'")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    counts = found.groupBy("run_id").agg(count("missing").alias("n_missing"), count("late").alias("n_late"), count("stuck_stage").alias("n_stuck_stage"), count("stuck_total").alias("n_stuck_total"))
    return stages.last_states(found).select("run_id", "chain_head", "n_events").join(counts, "run_id")


def q25d_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user: events with less than two hours between them, from a stream that a last event, far ahead, closes."""
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source = scratch(spark, "session-events")
    events.repartition(3, F.pmod(F.xxhash64("ts"), F.lit(3))).write.parquet(f"{source}/events")
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 400 days")).alias("ts"))
    end.write.parquet(f"{source}/~end")
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    found = _drained(spark, tracker.sessions(stream, "user_id", silence="2 hours", late="60 days"), "append", "sessions").where("user_id >= 0")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


class _Tree(HTMLParser):
    """(path, depth, type) of each element; what is never closed ends with what is around it."""

    def __init__(self):
        super().__init__()
        self.open, self.rows, self.seen = [], [], [{}]

    def handle_starttag(self, tag, attrs):
        counts = self.seen[-1]
        counts[tag] = counts.get(tag, 0) + 1
        path = (self.open[-1][1] if self.open else "") + f"/{tag}[{counts[tag]}]"
        self.rows.append((path, len(self.open), tag))
        if tag not in VOID:
            self.open.append((tag, path))
            self.seen.append({})

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
            del self.seen[at + 1 :]


def tree_nodes(pages: DataFrame) -> DataFrame:
    """page_id, path, depth, node_type for each element of each page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for page, html in zip(part["page_id"], part["html"]):
                tree = _Tree()
                tree.feed(html or "")
                yield pd.DataFrame([(page, *r) for r in tree.rows], columns=["page_id", "path", "depth", "node_type"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, path string, depth int, node_type string")


def q16_tree_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Elements by type: how many, in how many pages, how deep."""
    nodes = tree_nodes(table(spark, folder, "pages"))
    by_page = nodes.groupBy("node_type", "page_id").agg(F.count("*").alias("c"), F.max("depth").alias("d"))
    return by_page.groupBy("node_type").agg(F.sum("c").alias("n_nodes"), F.count("*").alias("n_pages"), F.max("d").alias("deepest"))


def q21b_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the tables with hash and size, and how often each content is there."""
    rows = files.inventory(spark, folder, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "sha256", "size_bytes")
    copies = rows.groupBy("sha256").agg(F.count("*").alias("n_copies"))
    return rows.join(copies, "sha256")


QUERIES = {"q16_tree_facts": q16_tree_facts, "q21b_inventory": q21b_inventory, "q25_stream_counts": q25_stream_counts, "q25b_stream_tracker": q25b_stream_tracker, "q25c_stage_tracker": q25c_stage_tracker, "q25d_sessions": q25d_sessions}
ORACLE_SQL = {
    "q25_stream_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "q25b_stream_tracker": "SELECT user_id::VARCHAR AS run_id, list_reduce(list_prepend('', list(event_id || '|' || event_type ORDER BY event_id)), lambda acc, x: sha256(concat(acc, '/', x))) AS chain_head, count(*) AS n_events, max_by(event_type, event_id) AS last_stage FROM events GROUP BY user_id",
    "q25c_stage_tracker": """
    WITH e AS (SELECT user_id::VARCHAR AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type AS stage, epoch_ms(ts) AS t FROM events),
    got AS (SELECT * FROM e WHERE k % 17 <> 5),
    runs AS (
      SELECT run_id, max(k) AS last_k, min(t) AS first_t, arg_max(stage, (t, k)) AS last_stage, min(CASE WHEN stage = 'purchase' THEN t END) AS ended_t, count(*) FILTER (WHERE k % 23 = 7) AS n_late
      FROM got GROUP BY run_id),
    places AS (SELECT run_id, unnest(range(1, last_k + 1)) AS k FROM runs),
    chain AS (
      SELECT run_id, list_reduce(list_prepend('', list(CASE WHEN stage IS NULL THEN 'missing|' || k ELSE run_id || '|' || k || '|' || stage END ORDER BY k)), lambda acc, x: sha256(concat(acc, '/', x))) AS chain_head,
        count(*) AS n_events, count(*) FILTER (WHERE stage IS NULL) AS n_missing
      FROM places LEFT JOIN got USING (run_id, k) GROUP BY run_id)
    SELECT run_id, chain_head, n_events, n_missing, n_late, (last_stage <> 'purchase')::BIGINT AS n_stuck_stage, (ended_t IS NULL OR ended_t > first_t + 600000)::BIGINT AS n_stuck_total
    FROM chain JOIN runs USING (run_id)
    """,
    "q25d_sessions": """
    WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true)::INT AS new FROM events),
    i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM i GROUP BY user_id, k
    """,
}
