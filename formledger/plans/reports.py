"""Reports: labels, Markdown, lint, score, classifiers, paths, hashes, token scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import report
from ..sources import files
from ..sources.tables import table


def q18_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of page addresses by the first rule that they break."""
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    risky = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a/../.."), path)).when(F.col("page_id") % 4 == 1, path).otherwise(F.regexp_replace(path, "^/", ""))
    return table(spark, folder, "pages").select(F.coalesce(scalars.path_problem(risky), F.lit("none")).alias("problem"), scalars.safe_relative_path(risky).alias("safe")).groupBy("problem", "safe").agg(F.count("*").alias("n"))


def q18b_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions from orders against 1.2.3: how many of each relation."""
    k = F.col("o_orderkey")
    version = F.when(k % 10 == 0, "1.2").otherwise(F.concat_ws(".", (k % 2 + 1).cast("string"), (k % 4).cast("string"), (k % 5).cast("string")))
    return table(spark, folder, "orders").select(scalars.semver_relation(version, "1.2.3").alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


def q19_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Readers' labels of sizes, spacings and alignments taken from parts."""
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        scalars.font_size_label(F.col("p_size") / 2).alias("font_size"),
        scalars.line_spacing_label((k % 9 + 2) / 2, F.col("p_size") > 40).alias("line_spacing"),
        scalars.indent_label(k % 4 * 0.36).alias("indent"),
        scalars.alignment_label(F.when(k % 3 == 0, "both").when(k % 3 == 1, "justify").otherwise("start")).alias("alignment"),
    )
    return rows.groupBy("font_size", "line_spacing", "indent", "alignment").agg(F.count("*").alias("n"))


def q19b_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """A Markdown table for each page of 50 parts."""
    parts = table(spark, folder, "part").withColumn("page", F.floor(F.col("p_partkey") / 50))
    return report.markdown_table(parts, ["page"], "p_partkey", ["part", "name", "brand"], [F.col("p_partkey"), F.concat(F.col("p_name"), F.lit("|x")), F.col("p_brand")])


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as the lines of a report for each conversation: user turns are headers."""
    turns = table(spark, folder, "conversations")
    head = F.concat(F.lit("## "), F.when(F.col("turn") == 0, "conclusion").when(F.col("turn") == 2, "evidence").otherwise("appendix"))
    body = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 1, " 12 pt").when(F.col("conv_id") % 5 == 0, " {rules_table} TODO").otherwise(""))
    lines = turns.select("conv_id", F.posexplode(F.array(F.when(F.col("role") == "user", head), body)).alias("part", "line"), "turn").where("line IS NOT NULL")
    return lines.select("conv_id", (F.col("turn") * 2 + F.col("part")).alias("line_no"), "line")


def q20_lint(spark: SparkSession, folder: str) -> DataFrame:
    """Words that readers shouldn't see, by report."""
    return report.lint(_lines(spark, folder), "conv_id", "line", ["font_size_pt", "role_kind"])


def q20b_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Required sections that are missing or empty, by report."""
    lines = report.sections(_lines(spark, folder), "conv_id", "line_no", "line")
    return report.missing_sections(lines, "conv_id", ["conclusion", "evidence", "appendix"], "line")


def q20c_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Internal names and JSON in turns, some of which got pieces of both: nested, with brackets in strings, broken off."""
    t = F.col("turn") + F.col("conv_id")
    plain = F.translate("text", '{}"\\', "()__")
    piece = (
        F.when(t % 7 == 0, F.lit(' {"schema_id": "x", "n": [1, {"k": "v"}]} end'))
        .when(t % 7 == 1, F.lit(' { {"a": "}{", "b": {"schema_id": 1}} {rules_table} {}'))
        .when(t % 7 == 2, F.lit(' {"schema_id": 1'))
        .when(t % 7 == 3, F.lit(' see docx-audit {"q": "a \\" } b", "schema_id": null}{"c": 1}'))
        .when(t % 7 == 4, F.lit(' {"a": 1,} {"b": tru}'))
        .otherwise("")
    )
    return report.leaks(table(spark, folder, "conversations").select("conv_id", "turn", F.concat(plain, piece).alias("line")), ["conv_id", "turn"], "line")


def q20d_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of conversations without one of their words."""
    return report.marker_problems(table(spark, folder, "conversations"), "conv_id", "text", {"!": ("the ", "der "), "?": ("la ",), ",": ("zzz", "ción"), ".": ("que", "on")})


def q22_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of messages, whether they may be tried again, and how many."""
    words = ["protected view", "password", "Read-Only", "revision protect", "write protect", "macro", "link update", "convert", "corrupt", "x"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("conv_id") % 10 + 1).cast("int"))
    code = scalars.error_code(F.concat_ws(" ", "text", word))
    return table(spark, folder, "conversations").select(code.alias("code"), scalars.retryable(code).alias("retryable")).groupBy("code", "retryable").agg(F.count("*").alias("n"))


def q23_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Idempotency key and plan revision of each order."""
    parts = [F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")]
    return table(spark, folder, "orders").select("o_orderkey", F.sha2(F.concat_ws("\n", *parts), 256).alias("idempotency_key"), scalars.revision_of(*parts).alias("plan_revision"), scalars.identifier("SA-", 16, *parts).alias("action_id"))


def q26_token_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold eight words in a row of a benchmark text (or a whole shorter one), by item."""
    found = files.phrase_scan(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


QUERIES = {
    "q18_paths": q18_paths,
    "q18b_versions": q18b_versions,
    "q19_labels": q19_labels,
    "q19b_markdown": q19b_markdown,
    "q20_lint": q20_lint,
    "q20b_sections": q20b_sections,
    "q20c_leaks": q20c_leaks,
    "q20d_markers": q20d_markers,
    "q22_errors": q22_errors,
    "q23_hashes": q23_hashes,
    "q26_token_scan": q26_token_scan,
}
_SQL_LINES = """l AS (SELECT conv_id, turn * 2 AS line_no, '## ' || CASE turn WHEN 0 THEN 'conclusion' WHEN 2 THEN 'evidence' ELSE 'appendix' END AS line FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn * 2 + 1, text || CASE WHEN turn % 3 = 1 THEN ' 12 pt' WHEN conv_id % 5 = 0 THEN ' {rules_table} TODO' ELSE '' END FROM conversations)"""
_SIZES = " ".join(f"WHEN p = {s} THEN '{n}'" for s, n in scalars.FONT_SIZES.items()) + " " + " ".join(f"WHEN abs(p - {s}) <= 0.25 THEN '约{n}'" for s, n in scalars.FONT_SIZES.items())
_NUM = "regexp_replace(regexp_replace(printf('%.2f', {v}), '0+$', ''), '\\.$', '')"
ORACLE_SQL = {
    "q18_paths": r"""WITH p AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'a/../..' || x WHEN page_id % 4 = 1 THEN x ELSE regexp_replace(x, '^/', '') END AS r FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS x FROM pages))
SELECT CASE WHEN r = '' THEN 'path_empty' WHEN r LIKE '/%' THEN 'path_absolute' WHEN regexp_matches(r, '(^|/)\.\.(/|$)') THEN 'path_escapes' WHEN NOT regexp_matches(r, '^[A-Za-z0-9_./-]+$') THEN 'path_characters' ELSE 'none' END AS problem, r <> '' AND r NOT LIKE '/%' AND NOT regexp_matches(r, '(^|/)\.\.(/|$)') AS safe, count(*) AS n FROM p GROUP BY ALL""",
    "q18b_versions": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'invalid' WHEN o_orderkey % 2 + 1 <> 1 THEN 'major_mismatch' WHEN o_orderkey % 4 > 2 THEN 'newer_minor' WHEN o_orderkey % 4 < 2 THEN 'older_minor' WHEN o_orderkey % 5 = 3 THEN 'exact' ELSE 'patch' END AS relation, count(*) AS n FROM orders GROUP BY ALL",
    "q19_labels": f"""WITH s AS (SELECT p_size / 2.0 AS p, (p_partkey % 9 + 2) / 2.0 AS v, p_size > 40 AS f, round(p_partkey % 4 * 0.36, 2) AS i, p_partkey % 3 AS a FROM part)
SELECT CASE {_SIZES} ELSE '非标准字号（约 ' || {_NUM.format(v="p")} || ' 磅）' END AS font_size, CASE WHEN f THEN '固定值 ' || {_NUM.format(v="v")} || ' 磅' WHEN v = 1 THEN '单倍行距' ELSE {_NUM.format(v="v")} || ' 倍行距' END AS line_spacing,
CASE WHEN i = 0 THEN '无缩进' WHEN i BETWEEN 0.7 AND 0.75 THEN '约 2 字符' ELSE '约 ' || {_NUM.format(v="i")} || ' 厘米' END AS indent, CASE WHEN a < 2 THEN '两端对齐' ELSE 'start' END AS alignment, count(*) AS n FROM s GROUP BY ALL""",
    "q19b_markdown": r"SELECT p_partkey // 50 AS page, '| part | name | brand |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || '\|x | ' || p_brand || ' |', chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY 1",
    "q20_lint": rf"""WITH {_SQL_LINES} SELECT DISTINCT conv_id, code, word FROM (SELECT conv_id, unnest(list_filter([CASE WHEN contains(line, 'DIFF_SUMMARY') THEN {{'code': 'placeholder', 'word': 'DIFF_SUMMARY'}} END, CASE WHEN contains(line, 'TODO') THEN {{'code': 'placeholder', 'word': 'TODO'}} END, CASE WHEN contains(line, 'PLACEHOLDER') THEN {{'code': 'placeholder', 'word': 'PLACEHOLDER'}} END,
CASE WHEN contains(line, 'font_size_pt') THEN {{'code': 'machine_key', 'word': 'font_size_pt'}} END, CASE WHEN contains(line, 'role_kind') THEN {{'code': 'machine_key', 'word': 'role_kind'}} END, CASE WHEN contains(lower(line), 'twip') THEN {{'code': 'unit', 'word': 'twip'}} END, CASE WHEN contains(lower(line), 'half_pt') THEN {{'code': 'unit', 'word': 'half_pt'}} END,
CASE WHEN regexp_matches(line, '\{{[a-z][a-z0-9_]*\}}') THEN {{'code': 'template', 'word': '{{}}'}} END, CASE WHEN regexp_matches(line, '\b[0-9]+(\.[0-9]+)?\s*pt\b') THEN {{'code': 'unit', 'word': 'pt'}} END], lambda x: x IS NOT NULL)) AS v FROM l), LATERAL (SELECT v.code AS code, v.word AS word)""",
    "q20b_sections": f"""WITH {_SQL_LINES}, s AS (SELECT conv_id, line_no, line, line LIKE '## %' AS h, last_value(CASE WHEN line LIKE '## %' THEN trim(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no) AS section FROM l),
b AS (SELECT conv_id, section, count(*) FILTER (NOT h AND trim(line) <> '') AS n FROM s WHERE section IS NOT NULL GROUP BY ALL), w AS (SELECT conv_id, unnest(['conclusion', 'evidence', 'appendix']) AS section FROM (SELECT DISTINCT conv_id FROM l))
SELECT conv_id, section, CASE WHEN n IS NULL THEN 'section_missing' ELSE 'section_empty' END AS code FROM w LEFT JOIN b USING (conv_id, section) WHERE n IS NULL OR n = 0""",
    "q20c_leaks": r"""
    WITH c AS (SELECT conv_id, turn, (turn + conv_id) % 7 AS t, length(text) AS n, regexp_matches(text, '\bdocx-[a-z-]+\b') AS named FROM conversations),
    p(t, code, a, z) AS (VALUES (0, 'internal_json', 1, 41), (1, 'embedded_json', 3, 37), (1, 'embedded_json', 52, 54), (3, 'internal_json', 16, 52), (3, 'embedded_json', 52, 60))
    SELECT conv_id, turn, code, (n + a)::INT AS start, (n + z)::INT AS "end" FROM c JOIN p USING (t)
    UNION ALL SELECT conv_id, turn, 'internal_name', NULL, NULL FROM c WHERE named OR t = 3
    """,
    "q20d_markers": """
    WITH f AS (SELECT conv_id, bool_or(contains(text, '!')) AND NOT bool_or(contains(text, 'the ') OR contains(text, 'der ')) AS a, bool_or(contains(text, '?')) AND NOT bool_or(contains(text, 'la ')) AS b,
      bool_or(contains(text, ',')) AND NOT bool_or(contains(text, 'zzz') OR contains(text, 'ción')) AS c, bool_or(contains(text, '.')) AND NOT bool_or(contains(text, 'que') OR contains(text, 'on')) AS d FROM conversations GROUP BY conv_id)
    SELECT conv_id, unnest(list_filter([CASE WHEN a THEN '!' END, CASE WHEN b THEN '?' END, CASE WHEN c THEN ',' END, CASE WHEN d THEN '.' END], lambda x: x IS NOT NULL)) AS marker FROM f
    """,
    "q22_errors": """WITH m AS (SELECT lower(text || ' ' || (['protected view', 'password', 'Read-Only', 'revision protect', 'write protect', 'macro', 'link update', 'convert', 'corrupt', 'x'])[conv_id % 10 + 1]) AS m FROM conversations)
SELECT CASE WHEN contains(m, 'protected view') THEN 'protected_view' WHEN contains(m, 'password') THEN 'password_required' WHEN contains(m, 'read-only') OR contains(m, 'read only') OR contains(m, 'readonly') THEN 'readonly_recommended' WHEN contains(m, 'revision') AND contains(m, 'protect') THEN 'revision_protected' WHEN contains(m, 'write') AND contains(m, 'protect') THEN 'write_protected' WHEN contains(m, 'macro') THEN 'macro_prompt'
WHEN contains(m, 'link') AND contains(m, 'update') THEN 'link_update_prompt' WHEN contains(m, 'convert') THEN 'conversion_prompt' WHEN contains(m, 'corrupt') THEN 'document_corrupt' ELSE 'api_incompatible' END AS code, false AS retryable, count(*) AS n FROM m GROUP BY ALL""",
    "q23_hashes": "SELECT o_orderkey, sha256(k) AS idempotency_key, ('0x' || left(sha256(k), 8))::BIGINT AS plan_revision, 'SA-' || left(sha256(k), 16) AS action_id FROM (SELECT o_orderkey, o_orderkey || chr(10) || o_orderpriority || chr(10) || o_orderstatus AS k FROM orders)",
    "q26_token_scan": r"""WITH b AS (SELECT item_id, regexp_split_to_array(lower(trim(text)), '\s+') AS x FROM benchmark), r AS (SELECT item_id, array_to_string(x, ' ') AS phrase, len(x) AS n FROM b WHERE len(x) < 8 AND x <> [''] UNION SELECT item_id, array_to_string(x[i:i + 7], ' '), 8 FROM (SELECT item_id, x, unnest(range(1, len(x) - 6)) AS i FROM b WHERE len(x) >= 8)),
d AS (SELECT doc_id, regexp_split_to_array(lower(trim(text)), '\s+') AS x FROM documents), l AS (SELECT DISTINCT n FROM r), w AS (SELECT doc_id, n, array_to_string(x[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, x, n, unnest(range(1, len(x) - n + 2)) AS i FROM d, l WHERE len(x) >= n))
SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM w JOIN r USING (phrase, n) GROUP BY item_id""",
}
