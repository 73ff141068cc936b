"""Slot facts: from wide tables, from texts, and from layers of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables

#: How sure a value is, by where it comes from, the strongest last.
CONFIDENCE = {"unresolved": 0.0, "legacy": 0.5, "word_ui_default": 0.6, "theme": 0.75, "doc_defaults": 0.85, "style_inherit": 0.9, "direct": 0.98}


def confidence(source: Column) -> Column:
    out = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def from_table(df: DataFrame, fact_id: Column, role: Column, slots: dict[str, Column], source: str = "direct") -> DataFrame:
    """fact_id, role_kind, slot, value_str, source, confidence: one row for each slot; a null value is unresolved."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), c.cast("string").alias("value_str")) for s, c in slots.items()])
    rows = df.select(fact_id.cast("string").alias("fact_id"), role.alias("role_kind"), F.explode(pairs).alias("p"))
    of = F.when(F.col("p.value_str").isNull(), "unresolved").otherwise(source)
    return rows.select("fact_id", "role_kind", "p.slot", "p.value_str", of.alias("source"), confidence(of).alias("confidence"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (1-based, of the lines that aren't blank), line; the columns of the documents but the text stay."""
    kept = F.filter(F.split(F.col(text), "\n"), lambda line: F.trim(line) != "")
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(kept).alias("at", "line")).withColumn("pos", F.col("at") + 1).drop("at")


def style_chains(styles: DataFrame) -> DataFrame:
    """doc_id, style_id, ancestor, level (0: itself): styles with all they inherit from.

    Each round appends to a style's chain the chain of the style it ends at, so chains double; a style that comes again ends its chain.
    """
    step = styles.select("doc_id", "style_id", F.array("style_id").alias("chain"), F.when(F.col("based_on") != F.col("style_id"), F.col("based_on")).alias("next"))
    step = tables.settled(step, "style-chains")
    while step.where("next IS NOT NULL").take(1):
        up = step.select(F.col("doc_id").alias("d"), F.col("style_id").alias("s"), F.col("chain").alias("more"), F.col("next").alias("after"))
        joined = step.join(up, (F.col("doc_id") == F.col("d")) & (F.col("next") == F.col("s")), "left")
        seen = F.array_position(F.transform(F.coalesce("more", F.array().cast("array<string>")), lambda x: F.array_contains("chain", x)), True)
        new = F.when(seen > 0, F.slice("more", F.lit(1), (seen - 1).cast("int"))).otherwise(F.coalesce("more", F.array().cast("array<string>")))
        again = F.array_contains(F.concat("chain", new), F.col("after"))
        longer, then = F.concat("chain", new), F.when((seen == 0) & ~F.coalesce(again, F.lit(False)), F.col("after"))
        # under names of their own: a new column named chain would be what the lambda sees
        step = joined.select("doc_id", "style_id", longer.alias("longer"), then.alias("then")).toDF("doc_id", "style_id", "chain", "next")
        step = tables.settled(step, "style-chains")
    return step.select("doc_id", "style_id", F.posexplode("chain").alias("level", "ancestor"))


def layered(layers: DataFrame, *keys: str) -> DataFrame:
    """Of slot values in layers (precedence: the larger, the stronger) the strongest that isn't empty; false and 0 count.

    Long rows and one aggregation: no maps collide, and partial sums go before the shuffle.
    """
    fine = layers.where(F.col("value_str").isNotNull() & (F.col("value_str") != ""))
    best = fine.groupBy(*keys, "slot").agg(F.max_by(F.struct("value_str", "source"), "precedence").alias("best"))
    return best.select(*keys, "slot", "best.value_str", "best.source", confidence(F.col("best.source")).alias("confidence"))


def with_missing(facts: DataFrame, slots: list[str], *keys: str) -> DataFrame:
    """Every registered slot for each entity; those without a value are unresolved."""
    entities = facts.select(*keys).distinct().withColumn("slot", F.explode(F.array(*[F.lit(s) for s in slots])))
    out = entities.join(facts, [*keys, "slot"], "left")
    return out.withColumn("source", F.coalesce("source", F.lit("unresolved"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def positioned(nodes: DataFrame, *order: str) -> DataFrame:
    """1-based position of each node of a document."""
    return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
