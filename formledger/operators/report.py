"""Readable reports: sections, lint, score, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import files

# Words that no reader should see.
PLACEHOLDERS = ("DIFF_SUMMARY", "TODO", "PLACEHOLDER")
UNITS = ("twip", "twips", "half_pt")
TEMPLATE = r"\{[a-z][a-z0-9_]*(?:_section|_table|_list)?\}"
POINTS = r"\b[0-9]+(?:\.[0-9]+)?\s*pt\b"
VALID_FROM = 95


def sections(lines: DataFrame, report: str, order: str, line: str) -> DataFrame:
    """Add section: the last ``## `` header at or above a line."""
    header = F.when(F.col(line).rlike(r"^##\s+\S"), F.trim(F.regexp_replace(line, r"^##\s+", "")))
    w = Window.partitionBy(report).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("is_header", header.isNotNull()).withColumn("section", F.last(header, True).over(w))


def lint(lines: DataFrame, report: str, line: str, keys: list[str]) -> DataFrame:
    """report, code, word for each word of a line that readers shouldn't see; ``keys`` are names of machine fields."""
    low = F.lower(line)
    checks = [F.when(F.col(line).contains(w), F.struct(F.lit("placeholder").alias("code"), F.lit(w).alias("word"))) for w in PLACEHOLDERS]
    checks += [F.when(F.col(line).contains(k), F.struct(F.lit("machine_key").alias("code"), F.lit(k).alias("word"))) for k in keys]
    checks += [F.when(low.contains(u), F.struct(F.lit("unit").alias("code"), F.lit(u).alias("word"))) for u in UNITS]
    checks += [F.when(F.col(line).rlike(TEMPLATE), F.struct(F.lit("template").alias("code"), F.lit("{}").alias("word")))]
    checks += [F.when(F.col(line).rlike(POINTS), F.struct(F.lit("unit").alias("code"), F.lit("pt").alias("word")))]
    found = lines.select(report, F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return found.select(report, "v.code", "v.word").distinct()


def missing_sections(sectioned: DataFrame, report: str, required: list[str], line: str) -> DataFrame:
    """report, section, code: required sections that are missing or empty."""
    body = sectioned.where(F.col("section").isNotNull()).groupBy(report, "section").agg(F.count_if(~F.col("is_header") & (F.trim(F.col(line)) != "")).alias("n_lines"))
    want = sectioned.select(report).distinct().withColumn("section", F.explode(F.array(*[F.lit(r) for r in required])))
    rows = want.join(body, [report, "section"], "left")
    code = F.when(F.col("n_lines").isNull(), "section_missing").when(F.col("n_lines") == 0, "section_empty")
    return rows.withColumn("code", code).where(F.col("code").isNotNull()).select(report, "section", "code")


def score(*parts: tuple[Column, int]) -> Column:
    """Sum of the points of the conditions that hold."""
    return sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in parts), F.lit(0))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[scalars.markdown_safe(c.cast("string"), 120, True) for c in cells]), F.lit(" |"))


def markdown_table(rows: DataFrame, group: list[str], order: str, headers: list[str], cells: list[Column]) -> DataFrame:
    """One Markdown table for each group (a page of rows; the caller keeps groups to the size of a page)."""
    head = "| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |\n"
    lines = rows.select(*group, F.col(order).alias("k"), table_row(*cells).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n")
    return lines.groupBy(*group).agg(F.concat(F.lit(head), text).alias("markdown"))


_PIECE = "struct<start:int,end:int,json:string>"


def embedded_json(text: Column) -> Column:
    """Array of (start, end, json) of the outermost JSON objects inside a text, in code points, the end exclusive.

    Tokens (brackets, quotes, escaped characters, what is between) move a state of the place, the open brackets and whether
    it is inside a string; quotes count inside brackets only.  Each closing bracket gives a piece, strict parsing keeps the objects.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'\\[\s\S]|[{}"\\]|[^{}"\\]++'), F.lit(0))
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("quoted"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        inside, after = F.size(s["open"]) > 0, (s["at"] + F.length(t)).cast("int")
        opens, closes = (t == "{") & ~s["quoted"], (t == "}") & ~s["quoted"] & inside
        piece = F.struct(F.element_at(s["open"], -1).alias("start"), after.alias("end"))
        return F.struct(
            after.alias("at"),
            F.when((t == '"') & inside, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when(closes, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"),
        )

    found = F.transform(F.aggregate(tokens, none, step)["out"], lambda x: F.struct(x["start"], x["end"], F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("json")))
    valid = F.filter(found, lambda x: F.coalesce(F.schema_of_variant(files.strict_json(x["json"])).startswith("OBJECT"), F.lit(False)))
    outermost = lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["start"] < x["start"]) & (y["end"] >= x["end"])))
    whole = F.transform(F.array(valid), outermost)[0]
    return F.when(F.contains(text, F.lit("{")), whole).otherwise(F.array().cast(f"array<{_PIECE}>"))


#: Names that a plain answer may not show, and the field that marks an internal document.
INTERNAL_NAME, INTERNAL_FIELD = r"\bdocx-[a-z-]+\b", "schema_id"


def leaks(lines: DataFrame, key: list[str], line: str) -> DataFrame:
    """key, code, start, end: internal names and internal JSON in what a user reads; other embedded JSON is told as such."""
    found = lines.select(*key, F.explode(embedded_json(F.col(line))).alias("p"))
    internal = F.array_contains(F.json_object_keys("p.json"), INTERNAL_FIELD)
    json = found.select(*key, F.when(internal, "internal_json").otherwise("embedded_json").alias("code"), "p.start", "p.end")
    names = lines.where(F.col(line).rlike(INTERNAL_NAME)).select(*key, F.lit("internal_name").alias("code"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return json.unionByName(names)


#: Markers of a report and the words one of which must be there too.
MARKERS = {"🔴": ("阻断", "必须先处理"), "🟡": ("待确认", "人工确认"), "🟢": ("可继续", "已通过", "已完成"), "✅": ("已完成", "已修复"), "⚠️": ("风险", "冲突", "警告")}


def marker_problems(lines: DataFrame, report: str, line: str, markers: dict[str, tuple[str, ...]] = MARKERS) -> DataFrame:
    """report, marker: markers in a report none of whose words is in it; flags by line are joined by or, so reports may be long."""
    flags = {}
    for i, (marker, words) in enumerate(markers.items()):
        there = F.lit(False)
        for w in words:
            there = there | F.contains(line, F.lit(w))
        flags |= {f"m{i}": F.contains(line, F.lit(marker)), f"w{i}": there}
    known = lines.groupBy(report).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    off = F.array_compact(F.array(*[F.when(F.col(f"m{i}") & ~F.col(f"w{i}"), F.lit(m)) for i, m in enumerate(markers)]))
    return known.select(report, F.explode(off).alias("marker"))
