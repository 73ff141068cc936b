"""Scalar functions on columns: units, defaults, paths, identities, hashes, labels and classifiers.

All are expressions of built-in functions, so they stay inside Spark's generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- units and typed values


def twips_to_cm(twips: Column) -> Column:
    """Twips to centimetres, 2 places; what isn't an integer gives null."""
    return F.round(safe_int(twips) / F.lit(567.0), 2)


def half_points_to_pt(value: Column) -> Column:
    return safe_int(value) / F.lit(2.0)


def twentieths_to_pt(value: Column) -> Column:
    return safe_int(value) / F.lit(20.0)


def safe_int(value: Column) -> Column:
    """An integer or null."""
    return value.cast("string").try_cast("bigint")


def line_spacing(line: Column, rule: Column) -> Column:
    """Struct of multiple and fixed points, of which one is set: ``auto`` (also a missing rule) counts 240ths of a line."""
    n = safe_int(line)
    auto = F.coalesce(rule, F.lit("auto")) == "auto"
    return F.struct(F.when(auto, F.round(n / F.lit(240.0), 3)).alias("multiple"), F.when(rule.isin("exact", "atLeast"), n / F.lit(20.0)).alias("points"))


def three_valued(present: Column, value: Column) -> Column:
    """Null when the mark is absent; false for 0, false, False; else true (also without a value)."""
    return F.when(present, ~F.coalesce(value, F.lit("1")).isin("0", "false", "False"))


def orientation(value: Column) -> Column:
    return F.coalesce(value, F.lit("portrait"))


#: Names of alignments that mean the same.
ALIGNMENT_ALIASES = {"justify": "both", "distributed": "distribute"}


def alignment(value: Column) -> Column:
    out = value
    for name, canonical in ALIGNMENT_ALIASES.items():
        out = F.when(value == name, canonical).otherwise(out)
    return out


# ---- texts and names


def preview(text: Column, size: int = 120) -> Column:
    return F.left(F.trim(text), F.lit(size))


def paragraph_id(number: Column) -> Column:
    return F.format_string("p-%05d", number)


def cell_id(table: Column, row: Column, column: Column) -> Column:
    return F.format_string("table-%04d-r%03d-c%03d", table, row, column)


def section_id(number: Column) -> Column:
    return F.format_string("section-%04d-page-setup", number)


def cell_role(row: Column, column: Column) -> Column:
    """The first row holds headers, the first column names of fields, the rest values."""
    return F.when(row == 1, "header").when(column == 1, "field_name").otherwise("field_value")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")


def result_file(order: Column, name: Column) -> Column:
    return F.format_string("%03d_%s.result.json", order, safe_name(name))


def markdown_safe(text: Column, limit: int | None = 120, cell: bool = False) -> Column:
    """No control characters, single blanks, pipes escaped in cells, an ellipsis at the limit."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.trim(F.regexp_replace(out, r"[\s\x{A0}]+", " "))
    if cell:
        out = F.replace(out, F.lit("|"), F.lit("\\|"))
    if limit is not None:
        out = F.when(F.length(out) > limit, F.concat(F.rtrim(F.left(out, F.lit(limit - 1))), F.lit("…"))).otherwise(out)
    return out


def filled(template: Column, values: Column) -> Column:
    """``{name}`` from a map; unknown names stay; a null value gives nothing."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


# ---- paths and identities


def parent_path(path: Column) -> Column:
    """The path above, or null at the top."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.contains("/") & (up != ""), up)


def ordinal(path: Column) -> Column:
    """0-based number of a step like ``p[3]``; 0 without one."""
    n = F.regexp_extract(path, r"\[([0-9]+)\]$", 1).try_cast("int")
    return F.greatest(F.coalesce(n - 1, F.lit(0)), F.lit(0))


#: Parts of a document by the beginning of a path.
PARTS = (("/styles", "word/styles.xml"), ("/numbering", "word/numbering.xml"), ("/header", "word/header.xml"), ("/footer", "word/footer.xml"), ("/comments", "word/comments.xml"), ("/footnotes", "word/footnotes.xml"))


def part_name(path: Column) -> Column:
    out = F.lit("word/document.xml")
    for prefix, part in reversed(PARTS):
        out = F.when(path.startswith(prefix), part).otherwise(out)
    return out


NATIVE_KEYS = ("id", "paraId", "styleId", "commentId", "bookmarkId")  #: fixed values
LOGICAL_KEYS = ("name", "styleId", "id")


def first_of(attributes: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in keys])


def selector(attributes: Column, path: Column, text: Column) -> Column:
    """How a node is found again: by native id, else by a semantic key, else by its position (then it can't be bound anew)."""
    native, logical = first_of(attributes, NATIVE_KEYS), first_of(attributes, LOGICAL_KEYS)
    kind = F.when(native.isNotNull(), "native_id").when(logical.isNotNull(), "semantic_key").otherwise("positional")
    return F.struct(kind.alias("kind"), F.coalesce(native, logical, path).alias("value"), (kind != "positional").alias("rebindable"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_fingerprint"))


def identifier(prefix: str, size: int, *parts: Column) -> Column:
    """A prefix and the first hex digits of the parts' hash."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(size)))


def content_hash(json: Column) -> Column:
    """Hash of a JSON text with sorted keys; equal content gives equal hashes whatever the order of keys."""
    return F.sha2(canonical_json(json), 256)


def canonical_json(json: Column) -> Column:
    """A JSON text with sorted keys and without white space, in which equal numbers are equal texts; null for what isn't JSON.

    Parsing drops zeros after the point; what it leaves as floating point (``1000.0``, ``1.0E10``, outside of strings) is
    written out without an exponent.
    """
    value = lambda x: x.cast("double")
    small = lambda x: F.rtrim(value(x).cast("decimal(38,20)").cast("string"), F.lit("0"))
    number = lambda x: (
        F.when((F.abs(value(x)) < 1e18) & (value(x) == F.floor(value(x))), value(x).cast("bigint").cast("string")).when(x.contains("E-") & (F.abs(value(x)) > 1e-12), small(x)).otherwise(x)
    )

    def plain(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|-?[0-9]+\.[0-9]+(?:E-?[0-9]+)?|[^"0-9-]+|[0-9-]'), F.lit(0))
        made = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^-?[0-9]+\.[0-9]"), number(p)).otherwise(p)), "")
        return F.when(text.rlike(r"[0-9]\.0(?![0-9])|[0-9]E-?[0-9]"), made).otherwise(text)

    # the text goes in as a lambda's variable, so it is made once, not once for each use
    return F.element_at(F.transform(F.array(F.to_json(F.try_parse_json(json))), plain), 1)


def variant_text(value: Column) -> Column:
    """A variant as text: booleans with a capital, numbers with a fraction keep one."""
    kind = F.schema_of_variant(value)
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.rlike(r"^DECIMAL\(1?[0-9],0\)$"), F.concat(text, F.lit(".0"))).otherwise(text)


#: What a raw write may do.
RAW_ACTIONS = ("append", "prepend", "insertbefore", "insertafter", "replace", "remove", "setattr")


def lf_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def revision_of(*parts: Column) -> Column:
    """A number from the first 8 hex digits of the inputs' hash."""
    return F.conv(F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(8)), 16, 10).cast("bigint")


# ---- checks of strings

HASH = r"^[0-9a-f]{64}$"
NAME = r"^[A-Za-z0-9_-]{1,80}$"
#: Fixed value: a path that names one node, each step with its number.
SINGLE_NODE_XPATH = r"^(/[A-Za-z_][\w.-]*:[A-Za-z_][\w.-]*\[[1-9][0-9]*\])+$"


def safe_relative_path(path: Column) -> Column:
    """No absolute path, no drive, no step upwards."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return (path != "") & ~plain.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def path_problem(path: Column) -> Column:
    """The first rule that a path breaks, or null."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(path.isNull() | (path == ""), "path_empty").when(plain.rlike("^/|^[A-Za-z]:"), "path_absolute").when(plain.rlike(r"(^|/)\.\.(/|$)"), "path_escapes").when(~plain.rlike(r"^[A-Za-z0-9_./-]+$"), "path_characters")


def semver_relation(version: Column, known: str) -> Column:
    """exact, patch, older_minor, newer_minor, major_mismatch or invalid, against a known version."""
    major, minor, patch = (int(x) for x in known.split("."))
    ok = version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")
    part = lambda i: F.regexp_extract(version, r"^([0-9]+)\.([0-9]+)\.([0-9]+)$", i).try_cast("int")
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "invalid")
        .when(part(1) != major, "major_mismatch")
        .when(part(2) > minor, "newer_minor")
        .when(part(2) < minor, "older_minor")
        .when(part(3) == patch, "exact")
        .otherwise("patch")
    )


#: Other names of contracts.
ALIASES = {"state": "run-state", "repair-plan-draft": "repair-plan", "repair-plan-finalized": "repair-plan"}


def canonical_id(name: Column) -> Column:
    out = name
    for alias, canonical in ALIASES.items():
        out = F.when(name == alias, canonical).otherwise(out)
    return out


# ---- labels for readers

# What readers see.
FONT_SIZES = {9.0: "小五", 10.5: "五号", 12.0: "小四", 14.0: "四号", 15.0: "小三", 16.0: "三号", 18.0: "小二", 22.0: "二号"}
ALIGNMENTS = {"left": "左对齐", "center": "居中", "right": "右对齐", "both": "两端对齐", "justify": "两端对齐", "distributed": "分散对齐", "distribute": "分散对齐"}
STATUS = {"blocked": "[阻断]", "waiting_user": "[待确认]", "passed": "[可继续]", "accepted": "[已通过]", "accepted_with_warnings": "[风险]", "done": "[已完成]"}


def _number(value: Column) -> Column:
    """Without a fraction if it has none, else with 2 places at most."""
    r = F.round(value, 2)
    return F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", r), "0+$", ""))


def font_size_label(points: Column) -> Column:
    p = F.round(points.cast("double"), 2)
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for size, label in reversed(FONT_SIZES.items()):
        exact = F.when(p == size, label).otherwise(exact)
        near = F.when(F.abs(p - size) <= 0.25, "约" + label).otherwise(near)
    return F.when(p.isNull(), "未指定").otherwise(F.coalesce(exact, near, F.concat(F.lit("非标准字号（约 "), _number(p), F.lit(" 磅）"))))


def line_spacing_label(value: Column, points: Column) -> Column:
    """``points``: whether the value is a fixed number of points."""
    v = value.cast("double")
    return (
        F.when(v.isNull(), "未指定")
        .when(points, F.concat(F.lit("固定值 "), _number(v), F.lit(" 磅")))
        .when(v == 1, "单倍行距")
        .otherwise(F.concat(_number(v), F.lit(" 倍行距")))
    )


def indent_label(cm: Column) -> Column:
    v = cm.cast("double")
    return F.when(v.isNull(), "未指定").when(v == 0, "无缩进").when(v.between(0.70, 0.75), "约 2 字符").otherwise(F.concat(F.lit("约 "), _number(v), F.lit(" 厘米")))


def _label(value: Column, labels: dict[str, str], missing: str, unknown: Column) -> Column:
    out = unknown
    for key, label in labels.items():
        out = F.when(value == key, label).otherwise(out)
    return F.when(value.isNull() | (value == ""), missing).otherwise(out)


def alignment_label(value: Column) -> Column:
    return _label(value, ALIGNMENTS, "未指定", value)


def status_label(value: Column) -> Column:
    return _label(value, STATUS, "[状态未知]", F.lit("[状态未知]"))


# ---- classifiers

#: All words must be in the lower-cased message; the first row that fits counts.
ERROR_RULES = (
    (("protected view",), "protected_view"),
    (("password",), "password_required"),
    (("read-only",), "readonly_recommended"),
    (("read only",), "readonly_recommended"),
    (("readonly",), "readonly_recommended"),
    (("revision", "protect"), "revision_protected"),
    (("write", "protect"), "write_protected"),
    (("macro",), "macro_prompt"),
    (("link", "update"), "link_update_prompt"),
    (("convert",), "conversion_prompt"),
    (("corrupt",), "document_corrupt"),
)
ERROR_DEFAULT = "api_incompatible"
RETRYABLE = ("viewer_busy", "temporary_file_lock", "process_start_failed")


def error_code(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(ERROR_DEFAULT)
    for words, code in reversed(ERROR_RULES):
        fits = low.contains(words[0])
        for w in words[1:]:
            fits = fits & low.contains(w)
        out = F.when(fits, code).otherwise(out)
    return out


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(*RETRYABLE), F.lit(False))


def risk_class(properties: Column, command: Column) -> Column:
    """Raw writes, borders and shading are L3_WRITE; moves of structure L2; formats of body text L1."""
    heavy = F.exists(F.map_keys(properties), lambda k: k.startswith("border.") | (k == "shd.fill"))
    return F.when((command == "raw-set") | F.coalesce(heavy, F.lit(False)), "L3_WRITE").when(command.isin("add", "remove", "move", "swap"), "L2").otherwise("L1")


def native_projection(properties: Column) -> Column:
    """Properties as an operation carries them: nulls gone, values as text."""
    return F.transform_values(F.map_filter(properties, lambda k, v: v.isNotNull()), lambda k, v: v.cast("string"))


def review_state(required: Column, status: Column, open_items: Column) -> Column:
    return F.when(~F.coalesce(required, F.lit(False)), "not_required").when(status == "blocked", "blocked").when((status == "pending") | (open_items > 0), "pending").otherwise("cleared")


def selected_action_hash(action: Column) -> Column:
    """Hash of a decision's action (a struct) without its own hash, who decided and when."""
    return F.sha2(F.to_json(action.dropFields("selected_action_sha256", "decided_by", "decided_at")), 256)


def viewer(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.contains("wps"), "wps").when(low.contains("word"), "word")


#: Elements whose warnings block.
BLOCKING = ("sectPr", "tbl", "hdr", "ftr", "fld", "sdt", "numPr", "style")


def warning_severity(target: Column) -> Column:
    low = F.lower(F.coalesce(target, F.lit("")))
    hit = F.lit(False)
    for token in BLOCKING:
        hit = hit | low.contains(token.lower())
    return F.when(hit, "blocking").otherwise("advisory")


def outcome_ok(exit_code: Column, success: Column, severities: Column) -> Column:
    """Exit 0, or a success whose warnings are all advisory."""
    return F.coalesce(exit_code == 0, F.lit(False)) | (F.coalesce(success, F.lit(False)) & F.forall(severities, lambda s: s == "advisory"))


def rule_path_problem(path: Column) -> Column:
    """Why a path is no place for a rule package, or null."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path_problem(path).isNotNull(), path_problem(path))
        .when(plain.rlike("(^|/)format_runs/[^/]+/rules(/|$)|(^|/)format_rules(/|$)"), "path_retired")
        .when(~F.element_at(F.split(plain, "/"), -1).rlike(NAME), "rule_id_pattern")
    )


def final_name_ok(name: Column) -> Column:
    """Names of final files: a base, the word final, a number."""
    return name.rlike(r"^[^/\\\\]+_final_v[0-9]+\.docx$")


def slot_value(json: Column) -> Column:
    """The value of a slot that is either bare or wrapped in an object with a field ``value``."""
    v = F.try_parse_json(json)
    wrapped = F.coalesce(F.schema_of_variant(v).rlike(r"^OBJECT<(.*, )?value:"), F.lit(False))
    return F.when(wrapped, F.try_variant_get(v, "$.value", "string")).otherwise(F.try_variant_get(v, "$", "string"))


def outside(items: Column, allowed: Column) -> Column:
    """What an array has beyond the allowed values, sorted; empty if it is a subset."""
    return F.array_sort(F.array_except(items, allowed))


def shared(items: Column, others: Column) -> Column:
    """What two arrays have in common, sorted."""
    return F.array_sort(F.array_intersect(items, others))
