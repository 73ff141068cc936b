"""Files as rows: inventories, text scans, strict JSON, and sinks that never overwrite other content."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from . import blobs, tables


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, sha256, size_bytes, modified of all files below a folder."""
    return blobs.whole(blobs.ranges(spark, folder, glob, hidden=False, of_large=False), folder)


def rendered_pages(spark: SparkSession, folder: str, least: int = 50_000) -> DataFrame:
    """The newest set of page images by folder: its pages, and how many are too small to be rendered ones."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "page-*.png").option("recursiveFileLookup", "true").load(folder)
    named = pages.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "path", "length", "modificationTime")
    sets = named.groupBy("folder").agg(F.max("modificationTime").alias("newest"), F.count("*").alias("n_pages"), F.count_if(F.col("length") < least).alias("n_small"))
    return sets.agg(F.max_by(F.struct("folder", "n_pages", "n_small"), "newest").alias("s")).select("s.*")


def token_scan(spark: SparkSession, folder: str, rules: list[tuple[str, str, bool]], glob: str = "*.md") -> DataFrame:
    """path, token, code: forbidden tokens that a file has, required ones that it lacks; rules are (code, token, forbidden)."""
    tokens = [token.encode() for _, token, _ in rules]
    beyond = max([1, *map(len, tokens)]) - 1  # a token may begin in a range and end in the next

    def held(blocks: Iterator[bytes]) -> list[bool]:
        found, tail = [False] * len(tokens), b""
        for block in blocks:
            text = tail + block
            found = [f or t in text for f, t in zip(found, tokens)]
            tail = text[-beyond:] if beyond else b""
        return [f or not t for f, t in zip(found, tokens)]  # an empty token is in every text

    parts = blobs.ranges_of(spark, folder, glob, hidden=False)
    read = blobs.read_ranges(parts, folder, held, "has", "array<boolean>", beyond)
    bad = F.when(F.max("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "path", F.max("problem"))))
    texts = read.groupBy("path").agg(F.coalesce(bad, F.array(*[F.bool_or(F.col("has")[i]) for i in range(len(rules))])).alias("has"))
    checks = [F.when(F.col("has")[i] == forbidden, F.struct(F.lit(code).alias("code"), F.lit(token).alias("token"))) for i, (code, token, forbidden) in enumerate(rules)]
    return texts.select("path", F.explode(F.array_compact(F.array(*checks))).alias("v")).select("path", "v.token", "v.code")


def phrase_scan(texts: DataFrame, id_col: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, size: int = 8) -> DataFrame:
    """id_col, phrase_id, once each: texts that hold ``size`` words in a row of a phrase, or the whole of a shorter phrase.

    Words are split at white space and compared in lower case, by 64-bit hashes of the rows of words; windows without a phrase go before
    anything is shuffled if the phrases are small enough for Spark to broadcast them.
    """

    def words(df: DataFrame, key: str, column: str) -> DataFrame:
        split = F.split(F.lower(F.trim(F.col(column))), r"\s+")
        return df.select(F.col(key), F.filter(split, lambda w: w != "").alias("_w")).where(F.size("_w") > 0)

    def windows(df: DataFrame, key: str, n: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.size("_w") - (n - 1))
        hashes = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, n), " "))))
        return df.where(F.size("_w") >= n).select(key, F.explode(hashes).alias("_hash"))

    wanted = words(phrases, phrase_id, phrase)
    whole = wanted.where(F.size("_w") < size).select(phrase_id, F.xxhash64(F.array_join("_w", " ")).alias("_hash"), F.size("_w").alias("_n"))
    known = tables.settled(windows(wanted, phrase_id, size).withColumn("_n", F.lit(size)).unionByName(whole).distinct(), "phrases")
    lengths = [r["_n"] for r in known.select("_n").distinct().collect()]  # at most ``size`` numbers
    source, found = words(texts, id_col, text), known.select(F.lit(None).cast(texts.schema[id_col].dataType).alias(id_col), phrase_id).limit(0)
    for n in sorted(lengths):
        own = known.where(F.col("_n") == n).drop("_n")
        found = found.unionByName(windows(source, id_col, n).join(own, "_hash").select(id_col, phrase_id))
    return found.distinct()


def retired_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths in folders that are no longer used."""
    return paths.where(F.col(column).rlike(r"(^|/)format_runs/[^/]+/rules(/|$)|(^|/)format_rules(/|$)"))


def strict_json(text: Column) -> Column:
    """The one JSON value of a text, or null: empty texts and anything after the value are errors.

    A parser that stops after the first value would accept trailing text; inside brackets it can't, and two levels of
    brackets tell one value from a list of several.
    """
    inner = F.trim(text)
    one = F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]")))
    two = F.try_parse_json(F.concat(F.lit("[["), inner, F.lit("]]")))
    size = lambda v, path: F.size(F.try_variant_get(v, path, "array<variant>"))
    return F.when((inner != "") & (size(one, "$") == 1) & (size(two, "$") == 1) & (size(two, "$[0]") == 1), F.try_variant_get(one, "$[0]", "variant"))


def unwrapped(envelope: Column) -> Column:
    """The data of ``{success, data}``; null unless success is true."""
    return F.when(F.try_variant_get(envelope, "$.success", "boolean"), F.try_variant_get(envelope, "$.data", "variant"))


def node_of(value: Column) -> Column:
    """path, type and native id of a node under any of its alternative key names."""
    first = lambda kind, *keys: F.coalesce(*[F.try_variant_get(value, f"$.{k}", kind) for k in keys])
    text = lambda *keys: first("string", *keys)
    return F.struct(
        text("path", "nodePath", "xpath").alias("path"),
        text("type", "nodeType", "kind").alias("node_type"),
        text("id", "nodeId", "native_id").alias("native_id"),
        first("array<variant>", "children", "nodes", "items").alias("children"),
        first("map<string,string>", "attributes", "attrs", "properties").alias("attributes"),
    )


def new_rows(rows: DataFrame, stored: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): equal key and content is a replay and left out; equal key and other content is a conflict."""
    have = stored.select(F.col(key).alias("_key"), F.col(content).alias("_content")).distinct()
    fresh = rows.join(have, F.col(key) == F.col("_key"), "left_anti")
    conflicts = rows.join(have, (F.col(key) == F.col("_key")) & ~F.col(content).eqNullSafe(F.col("_content"))).drop("_key", "_content")
    return fresh, conflicts


def write_once(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a table; one with the same rows that is there already stays, one with other rows is an error, and nothing is overwritten."""
    try:
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
        if rules.same_rows(df, stored).take(1):
            raise ValueError(f"{path} holds other rows, and tables never change") from e


def at_path(value: Column, dotted: str, kind: str = "string") -> Column:
    """A nested field by its dotted path; null where it is absent or of another kind."""
    return F.try_variant_get(value, f"$.{dotted}", kind)


def json_paths(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, json_path, value (as JSON) of every value in a JSON text, at any depth; each level is one step over all rows."""
    spark = rows.sparkSession
    level = rows.select(F.col(key), F.lit("$").alias("json_path"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    found = []
    while True:
        # variants are written as text, so any reader can read the levels
        texts = tables.settled(level.select(key, "json_path", F.to_json("v").alias("value")), "json-level")
        if not texts.take(1):
            break
        found.append(texts)
        open_ = texts.where(F.left("value", F.lit(1)).isin("{", "[")).withColumn("v", F.parse_json("value"))
        below = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), F.col("_key"))).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = below.select(open_[key], F.concat(F.col("json_path"), step).alias("json_path"), F.col("_value").alias("v"))
    empty = texts.limit(0)
    for part in found:
        empty = empty.unionByName(part)
    return empty
