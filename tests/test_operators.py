import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from formledger.functions import scalars
from formledger.operators import audit, facts, ledger, profile, repair, report, rules, tree
from formledger.sources import contract, documents, files
from formledger.streaming import tracker

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="21"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="A"><w:name w:val="Base"/><w:pPr><w:jc w:val="justify"/><w:spacing w:line="360" w:lineRule="auto"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="Below"/><w:basedOn w:val="A"/><w:rPr><w:b w:val="0"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="C"><w:basedOn w:val="D"/></w:style><w:style w:type="paragraph" w:styleId="D"><w:basedOn w:val="C"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>"""
BODY = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="B"/><w:spacing w:line="400" w:lineRule="exact"/></w:pPr><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:pStyle w:val="C"/><w:jc w:val="center"/></w:pPr></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838" w:orient="landscape"/><w:pgMar w:top="1417" w:left="x"/></w:sectPr></w:body></w:document>"""


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", BODY)
        z.writestr("word/styles.xml", STYLES)
    with zipfile.ZipFile(folder / "plain.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p/></w:body></w:document>")
    with zipfile.ZipFile(folder / "none.docx", "w") as z:
        z.writestr("other.xml", "<x/>")
    with zipfile.ZipFile(folder / "broken.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    (folder / "text.docx").write_text("not a container")
    return documents.scan(spark, f"file://{folder}")


def test_problems_are_rows(scanned):
    assert sorted(r.problem for r in scanned[1].collect()) == ["broken_xml", "no_document_part", "not_a_container"]


def test_paragraphs_cells_sections(scanned):
    nodes = scanned[0]
    doc = nodes.where("file LIKE '%/a.docx'").select("doc_id").distinct()
    p = documents.paragraphs(nodes).join(doc, "doc_id").orderBy("paragraph_index").collect()
    assert [(r.element_id, r.style_id, r.text_preview, r.in_cell) for r in p] == [("p-00001", "B", "First line", False), ("p-00002", None, "h1", True), ("p-00003", None, "", True), ("p-00004", None, "", True), ("p-00005", None, "", True), ("p-00006", "C", "", False)]
    cells = documents.cells(nodes).orderBy("cell_id").collect()
    assert [(r.cell_id, r.cell_role) for r in cells] == [("table-0001-r001-c001", "header"), ("table-0001-r001-c002", "header"), ("table-0001-r002-c001", "field_name"), ("table-0001-r002-c002", "field_value"), ("table-0002-r001-c001", "header")]
    assert {(r.table_index, r.n_rows, r.n_columns, r.n_cells) for r in documents.table_shapes(documents.cells(nodes)).collect()} == {(1, 2, 2, 4), (2, 1, 1, 1)}
    got = {(r.page_orientation, r.page_width_twips, r.margin_top_cm, r.margin_left_cm) for r in documents.sections(nodes).collect()}
    assert got == {("landscape", 11906, 2.5, None), ("portrait", None, None, None)}


def test_formats_by_layer(scanned):
    rows = documents.paragraph_formats(scanned[0]).join(scanned[0].where("file LIKE '%/a.docx'").select("doc_id").distinct(), "doc_id").collect()
    got = {(r.element_id, r.slot): (r.value_str, r.source) for r in rows}
    assert got["p-00001", "bold"] == ("false", "style_inherit")
    assert got["p-00001", "alignment"] == ("both", "style_inherit")
    assert got["p-00001", "line_spacing_multiple"] == ("1.5", "style_inherit")  # both layers' spacings stay
    assert got["p-00001", "line_spacing_pt"] == ("20.0", "direct")
    assert got["p-00001", "font_size_pt"] == ("10.5", "doc_defaults")
    assert got["p-00006", "alignment"] == ("center", "direct")
    assert got["p-00006", "outline_level"] == ("1", "style_inherit")  # through a loop of styles


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_scalars(spark):
    L = F.lit
    assert one(spark, scalars.twips_to_cm(L("567")), scalars.twips_to_cm(L("x")), scalars.half_points_to_pt(L("21")), scalars.twentieths_to_pt(L(None))) == (1.0, None, 10.5, None)
    assert one(spark, scalars.three_valued(L(False), L("1")), scalars.three_valued(L(True), L(None)), scalars.three_valued(L(True), L("0"))) == (None, True, False)
    assert one(spark, scalars.parent_path(L("/body/p[3]")), scalars.parent_path(L("/body")), scalars.ordinal(L("/body/p[3]")), scalars.ordinal(L("/body"))) == ("/body", None, 2, 0)
    assert one(spark, scalars.part_name(L("/styles/style[1]")), scalars.part_name(L("/body"))) == ("word/styles.xml", "word/document.xml")
    assert one(spark, *[scalars.semver_relation(L(v), "1.2.3") for v in ("1.2.3", "1.2.9", "1.1.0", "1.3.0", "2.2.3", "1.2")]) == ("exact", "patch", "older_minor", "newer_minor", "major_mismatch", "invalid")
    assert one(spark, *[scalars.safe_relative_path(L(p)) for p in ("a/b", "/a", "a/../b", "C:\\x", "a..b")]) == (True, False, False, False, True)
    assert one(spark, *[scalars.font_size_label(L(v)) for v in (12.0, 12.2, 13.0, 13.13, None)]) == ("小四", "约小四", "非标准字号（约 13 磅）", "非标准字号（约 13.13 磅）", "未指定")
    assert one(spark, scalars.line_spacing_label(L(1.0), L(False)), scalars.line_spacing_label(L(1.5), L(False)), scalars.line_spacing_label(L(20.0), L(True))) == ("单倍行距", "1.5 倍行距", "固定值 20 磅")
    assert one(spark, scalars.markdown_safe(L(" a\n b|c\x01 "), 120, True), scalars.markdown_safe(L("x" * 200), 10)) == ("a b\\|c", "x" * 9 + "…")
    assert one(spark, scalars.filled(L("{a} and {b}"), F.create_map(L("a"), L("1")))) == ("1 and {b}",)
    assert one(spark, *[scalars.error_code(L(m)) for m in ("In Protected View", "revision is protected", "please CONVERT", None)]) == ("protected_view", "revision_protected", "conversion_prompt", "api_incompatible")
    assert one(spark, scalars.content_hash(L('{"b": 1, "a": 2}')) == scalars.content_hash(L('{"a":2,"b":1}'))) == (True,)
    assert one(spark, scalars.lf_hash(L("a\r\nb\rc")) == scalars.lf_hash(L("a\nb\nc"))) == (True,)
    assert one(spark, scalars.risk_class(F.create_map(L("border.top"), L("1")), L("set")), scalars.risk_class(F.create_map(L("bold"), L("1")), L("set")), scalars.risk_class(F.create_map(L("bold"), L("1")), L("raw-set"))) == ("L3_WRITE", "L1", "L3_WRITE")
    sel = spark.range(1).select(scalars.selector(F.create_map(L("name"), L("n")), L("/p"), L("t")).alias("s")).first().s
    assert (sel.kind, sel.value, sel.rebindable) == ("semantic_key", "n", True)


def test_rules_gate_and_references(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 9.0)], "id string, v double")
    found = rules.violations(rows, "x", "id", [rules.Rule("range", "v", "v < 5"), rules.Rule("set", "v", "v IS NOT NULL", "warning")])
    assert {(r.entity_id, r.code, r.severity) for r in found.collect()} == {("b", "range", "error"), ("b", "set", "warning"), ("c", "range", "error")}
    gates = {r.entity_id: (r.status, r.failed_codes, r.n_warnings) for r in rules.gate(found).collect()}
    assert gates == {"b": ("blocked", ["range"], 1), "c": ("blocked", ["range"], 0)}
    refs = spark.createDataFrame([("r1", "a"), ("r2", "z"), ("r3", None)], "ref string, to string")
    assert [r.ref for r in rules.dangling(refs, "to", rows, "id").collect()] == ["r2"]
    assert {(r.id, r.side) for r in rules.missing_and_extra(rows, spark.createDataFrame([("a",), ("q",)], "id string"), "id").collect()} == {("q", "missing"), ("b", "extra"), ("c", "extra")}
    assert rules.same_rows(rows, rows).count() == 0


def test_profile_statuses(spark):
    def fact(role, slot, values):
        return [(f"{role}{slot}{i}", role, slot, v, "direct" if v else "unresolved", 0.98 if v else 0.0) for i, v in enumerate(values)]

    rows = fact("r", "one", ["1.5"] * 3) + fact("r", "half", ["a", "b"]) + fact("r", "most", ["a", "a", "b"]) + fact("r", "none", [None]) + fact("r", "tie", ["b", "a", "c"])
    facts_ = spark.createDataFrame(rows, "fact_id string, role_kind string, slot string, value_str string, source string, confidence double")
    got = {r.slot: r for r in profile.slot_summary(facts_, samples=2).collect()}
    assert {s: r.status for s, r in got.items()} == {"one": "resolved", "half": "conflict", "most": "resolved_with_conflicts", "none": "unresolved", "tie": "conflict"}
    assert (got["one"].mode_coverage, got["one"].confidence) == (1.0, 0.98)
    assert (got["none"].confidence, got["none"].total_samples, got["none"].requires_confirmation) == (0.0, 0, True)
    assert got["tie"].mode_value == "a"
    for r in got.values():
        assert abs(sum(h.ratio for h in r.value_histogram) - (1 if r.total_samples else 0)) < 1e-5
        assert all(len(h.sample_fact_ids) <= 2 for h in r.value_histogram)
    wanted = spark.createDataFrame([("r", "one", "required"), ("r", "half", "required"), ("r", "gone", "required"), ("r", "most", "forbidden"), ("r", "none", "required")], "role_kind string, slot string, requirement string")
    assert {(r.slot, r.code) for r in audit.missing_slots(wanted, profile.slot_summary(facts_)).collect()} == {("half", "required_slot_conflict"), ("gone", "required_slot_missing"), ("most", "forbidden_slot_present"), ("none", "required_slot_unresolved")}
    assert audit.deviations(facts_.where("slot = 'one'"), profile.slot_summary(facts_)).count() == 0


def test_diff_of_a_table_with_itself_and_drift(spark):
    t = spark.createDataFrame([(1, "a", None), (2, None, "x")], "k long, a string, b string")
    assert audit.diff(t, t, "k", ["a", "b"]).count() == 0
    other = spark.createDataFrame([(1, "b", None), (3, "n", "x")], "k long, a string, b string")
    assert {(r.k, r.change, r.fields) for r in audit.diff(t, other, "k", ["a", "b"]).collect()} == {(1, "changed", "a"), (2, "removed", None), (3, "added", None)}
    assert {(r.k, r.code, r.field, r.expected, r.actual) for r in audit.drift(other, t, "k", ["a", "b"]).collect()} == {(1, "field_differs", "a", "a", "b"), (2, "missing", None, None, None), (3, "unknown", None, None, None)}


@pytest.mark.parametrize("alone", ["", "0", "12", "0,1,2", "5,13", "24", "0,24,25"])
def test_batches(spark, alone):
    single = {int(x) for x in alone.split(",") if x}
    rows = [("r", i, i in single) for i in range(26)]
    got = repair.batches(spark.createDataFrame(rows, "run string, i long, alone boolean"), "run", "i", "alone").orderBy("i").collect()
    want, batch, size = [], 0, 12
    for _, i, s in rows:
        if s or size >= 12 or (want and rows[i - 1][2]):
            batch, size = batch + 1, 0
        size += 1
        want.append((batch, size))
    assert [(r.batch, r.position) for r in got] == want


def test_chain_changes_with_any_event(spark):
    rows = [("r", i, f"e{i}") for i in range(5)]
    head = lambda rs: ledger.chain_heads(spark.createDataFrame(rs, "run string, i long, e string"), "run", "i", "e").first().chain_head
    base = head(rows)
    assert head(rows[::-1]) == base
    assert all(head(rows[:k] + [("r", k, "other")] + rows[k + 1 :]) != base for k in range(5))


def test_alignment_problems(spark):
    ops = spark.createDataFrame([("b", i, "set") for i in range(4)], "batch string, index int, command string")
    results = spark.createDataFrame([("b", 0, True, "set"), ("b", 1, False, "set"), ("b", 1, False, "set"), ("b", 9, True, None)], "batch string, index int, success boolean, command string")
    assert [r.status for r in repair.aligned(ops, results.where("index < 4"), "batch").orderBy("index").collect()] == ["executed", "failed", "not_run", "not_run"]
    assert {(r["index"], r.code) for r in repair.result_problems(ops, results, "batch").collect()} == {(1, "duplicate_index"), (9, "out_of_range")}
    gap = spark.createDataFrame([("b", 2, True, "set"), ("b", 3, True, "other")], "batch string, index int, success boolean, command string")
    assert [r.status for r in repair.aligned(ops, gap, "batch").orderBy("index").collect()] == ["mismatch", "mismatch", "executed", "mismatch"]


def test_report_sections_and_score(spark):
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(["## A", "text 12 pt", "## B", "", "## C", "{x_table} TODO"])], "rep string, i int, line string")
    s = report.sections(lines, "rep", "i", "line")
    assert [r.section for r in s.orderBy("i").collect()] == ["A", "A", "B", "B", "C", "C"]
    assert {(r.section, r.code) for r in report.missing_sections(s, "rep", ["A", "B", "D"], "line").collect()} == {("B", "section_empty"), ("D", "section_missing")}
    assert {(r.code, r.word) for r in report.lint(lines, "rep", "line", []).collect()} == {("unit", "pt"), ("template", "{}"), ("placeholder", "TODO")}
    assert spark.range(1).select(report.score((F.lit(True), 15), (F.lit(None).cast("boolean"), 20), (F.lit(True), 5))).first()[0] == 20


def test_files_and_json(spark, tmp_path):
    (tmp_path / "a.md").write_text("good words")
    (tmp_path / "b.md").write_text("bad words")
    folder = f"file://{tmp_path}"
    assert {(r.path[-4:], r.code) for r in files.token_scan(spark, folder, [("no_bad", "bad", True), ("has_good", "good", False)]).collect()} == {("b.md", "no_bad"), ("b.md", "has_good")}
    listed = files.inventory(spark, folder, "*.md")
    declared = listed.withColumn("sha256", F.when(F.col("path").endswith("a.md"), F.col("sha256")).otherwise("x")).unionByName(spark.createDataFrame([("gone", "y", 1, None)], listed.schema))
    assert sorted(r.code for r in ledger.verified(declared, listed).collect()) == ["artifact_hash", "artifact_missing"]
    texts = ['{"a": 1}', '{"a": 1} x', "", "[1, 2]", "1, 2", "]["]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(files.strict_json(F.col("t")))).collect()
    assert [r[0] for r in got] == ['{"a":1}', None, None, "[1,2]", None, None]
    rows = spark.createDataFrame([("k1", "c1"), ("k2", "other"), ("k3", "c3")], "key string, content string")
    fresh, conflicts = files.new_rows(rows, spark.createDataFrame([("k1", "c1"), ("k2", "c2")], "key string, content string"), "key", "content")
    assert ([r.key for r in fresh.collect()], [r.key for r in conflicts.collect()]) == (["k3"], ["k2"])
    files.write_once(rows, f"{folder}/once")
    files.write_once(rows.orderBy(F.desc("key")), f"{folder}/once")  # equal rows: nothing happens
    with pytest.raises(ValueError, match="never change"):
        files.write_once(rows.limit(2), f"{folder}/once")
    assert spark.read.parquet(f"{folder}/once").count() == 3


def test_contract_tables(spark, tmp_path):
    (tmp_path / "roles.json").write_text('{"role_kind": "title", "category": "cover", "required_slots": ["size"], "forbidden_slots": ["level"]}\n')
    (tmp_path / "registry.json").write_text('{"slot": "size", "data_type": "number", "nullable": false, "min": 5, "max": 72}\n{"slot": "align", "data_type": "enum", "nullable": true, "enum_values": ["left"]}\n')
    assert {(r.slot, r.requirement) for r in contract.slots(spark, f"file://{tmp_path}/roles.json").collect()} == {("size", "required"), ("level", "forbidden")}
    rows = spark.createDataFrame([("1", "size", "4"), ("2", "size", "x"), ("3", "size", None), ("4", "size", "12"), ("5", "align", "up"), ("6", "align", None), ("7", "odd", "1")], "fact_id string, slot string, value_str string")
    got = {r.fact_id: r.code for r in contract.value_problems(rows, contract.registry(spark, f"file://{tmp_path}/registry.json")).collect()}
    assert got == {"1": "slot_range", "2": "slot_type", "3": "slot_null", "5": "slot_enum", "7": "slot_unknown"}


def test_trees(spark):
    nodes = spark.createDataFrame([(1, "/document", None), (1, "/document/p", "/document"), (1, "/document/p/r", "/document/p"), (1, "/lost/x", "/lost"), (2, "/body", None)], "doc_id long, path string, parent_path string")
    assert [r.path for r in tree.orphans(nodes, ["/document", "/body"]).collect()] == ["/lost/x"]
    assert [(r.doc_id, r.path) for r in tree.missing_roots(nodes, ["/document"]).collect()] == [(2, "/document")]


def test_layers_keep_false_and_zero(spark):
    rows = spark.createDataFrame([(1, "bold", "true", "doc_defaults", 1), (1, "bold", "false", "direct", 3), (1, "bold", "", "direct", 4), (1, "n", "0", "direct", 2), (1, "n", None, "direct", 9)], "id long, slot string, value_str string, source string, precedence int")
    assert {(r.slot, r.value_str, r.source, r.confidence) for r in facts.layered(rows, "id").collect()} == {("bold", "false", "direct", 0.98), ("n", "0", "direct", 0.98)}
    full = facts.with_missing(facts.layered(rows, "id"), ["bold", "n", "x"], "id")
    assert {(r.slot, r.source, r.confidence) for r in full.collect()} == {("bold", "direct", 0.98), ("n", "direct", 0.98), ("x", "unresolved", 0.0)}


def test_stuck_runs_are_told(spark, tmp_path):
    """A run without results becomes an alert when event time has passed its timer."""
    t0 = datetime.datetime(2024, 1, 1)
    source = tmp_path / "in"
    schema = "run_id string, order long, stage string, content string, ts timestamp"
    batches = [[("a", 1, "init", "x", t0), ("b", 1, "init", "x", t0)], [("b", 2, "review", "y", t0 + datetime.timedelta(seconds=400))], [("b", 3, "review", "z", t0 + datetime.timedelta(seconds=410)), ("b", 2, "review", "y", t0 + datetime.timedelta(seconds=405))]]
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = tracker.track(spark.readStream.schema(schema).parquet(f"file://{source}"))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start()
        query.awaitTermination()
    assert ("a", 1, "stuck") in {(r.run_id, r.n_events, r.alert) for r in seen}
    last = max((r for r in seen if r.run_id == "b"), key=lambda r: r.n_events)
    assert (last.n_events, last.last_stage) == (3, "review")


def test_rule_packs_parse_and_find(spark):
    from formledger.operators import rulepacks

    kinds = dict(
        run_id="string", result_id="string", stage="string", idempotency_key="string", status="string", next_kind="string", order_no="int", attempt="int", error_code="string", gate_passed="boolean", next_stage="string", retry_of="string", mode="string", chain_head="string",
        final_acceptance_path="string", applied_result_id="string", last_result_id="string", rule_id="string", role="string", write_strategy="string", confidence="double", requires_user_confirmation="boolean", manual_confirmation_reason="string", issue_id="string", element_id="string",
        semantic_role="string", current_problem="string", action_type="string", auto_fix_policy="string", risk_level="string", evidence="array<string>", expected_role="string", review_id="string", proposal_id="string", category="string", problem="string", decision_status="string",
        source_refs="array<string>", allows_continue="boolean", blocking="boolean", decided_by="string", decided_at="timestamp", selected_action="string", selected_action_sha256="string", plan_id="string", plan_state="string", backend="string", backend_version="string", plan_revision="long",
        snapshot_sha256="string", capability_sha256="string", finalized_from_plan_id="string", finalized_at="timestamp", blocking_count="long", pending_count="long", action_id="string", command="string", target_path="string", risk_class="string", target_node_id="string",
        expected_match_count="int", xml="string", xml_sha256="string", plan_run_id="string", request_revision="long", request_snapshot_sha256="string", request_capability_sha256="string", n_operations="long", has_heavy="boolean", artifact_id="string", kind="string", path="string", sha256="string",
        size_bytes="long", toc_mode="string", toc_required="boolean", refresh_attempted="boolean", refresh_succeeded="boolean", placeholder_removed="boolean", field_count="int", visible_count="int", reason="string", acceptance_type="string", blocking_categories="array<string>", n_warnings="long",
        doc_id="string", node_type="string", node_id="string", ordinal="int", selector_kind="string", rebindable="boolean", content_fingerprint="string", attempt_no="int", after_ref="string", n_failed="long",
        retry_reason="string", resume_allowed="boolean", message="string", source="string", reason_code="string", source_artifact_id="string", source_sha256="string", source_size_bytes="long", snapshot_source_artifact_id="string", snapshot_source_sha256="string", snapshot_source_size_bytes="long",
        plan_path="string", plan_sha256="string", document_path="string", document_sha256="string", schema_id="string", contract_version="string", plan_size_bytes="long", document_size_bytes="long", check_id="string", check_type="string", review_status="string", gate_status="string",
        source_action_status="string", source_execution_status="string", report_path="string", acceptance_sha256="string", accepted_sha256="string", acceptance_fields="array<string>", report_exists="boolean",
    )
    empty = rulepacks.with_columns(spark.createDataFrame([("e",)], "id string"), **kinds)
    for name, pack in rulepacks.PACKS.items():
        assert rules.violations(empty, name, "id", pack).count() > 0 or name == "source"  # there two absent values agree
    draft = lambda **v: {r.code for r in rules.violations(rulepacks.with_columns(spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {kinds[k]}" for k in v)).withColumn("id", F.lit("x")), **kinds), "rule_draft", "id", rulepacks.RULE_DRAFT).collect()}
    assert draft(rule_id="r", role="t", write_strategy="direct", confidence=0.92) == set()
    assert draft(rule_id="r", role="t", write_strategy="audit-only", confidence=0.92) == {"confirmation_required"}
    assert draft(rule_id="r", role="t", write_strategy="direct", confidence=0.74, requires_user_confirmation=True) == {"confirmation_reason"}
    assert draft(rule_id="r", role="t", write_strategy="direct", confidence=1.2) == {"value_range"}


def test_transitions_gaps_and_resume(spark):
    log = spark.createDataFrame([("r", 1, "running"), ("r", 2, "done"), ("r", 3, "executed_ready"), ("r", 5, "running")], "run string, n int, status string")
    assert [(r.n, r.source_status) for r in ledger.bad_transitions(log, "run", "n", "status").collect()] == [(5, "executed_ready")]
    assert [(r.run, r.n) for r in ledger.missing_results(log, "run", "n").collect()] == [("r", 4)]
    cases = [(False, "missing", True, "run_skill", True, 3), (False, "chain_mismatch", True, "run_skill", True, 3), (True, None, False, "run_skill", True, 3), (True, None, True, "wait_user", True, 3), (True, None, True, "retry", True, 0), (True, None, True, "run_skill", False, 3), (True, None, True, "stop", True, 3), (True, None, True, "run_skill", True, 3)]
    rows = spark.createDataFrame(cases, "chain_valid boolean, failure_kind string, contract_valid boolean, next_kind string, agrees boolean, remaining int")
    assert [r[0] for r in rows.coalesce(1).select(ledger.resume_decision()).collect()] == ["synthesize_failure", "manual_recover", "blocked", "wait_user", "blocked", "apply_last_result", "stop", "run_next"]
    plans = spark.createDataFrame([("r", 9, "r9"), ("r", 10, "r10")], "run string, rev int, name string")
    assert ledger.latest(plans, "run", F.col("rev")).first().name == "r10"


def test_decisions_properties_and_heavy_writes(spark):
    t = datetime.datetime(2024, 1, 1)
    items = spark.createDataFrame([("R1", "pending", None), ("R2", "pending", None)], "review_id string, decision_status string, selected_action string")
    decisions = spark.createDataFrame([("R1", "rejected", None, "p", t), ("R1", "approved", '{"b": 1, "a": 2}', "p", t + datetime.timedelta(1)), ("R9", "approved", None, "p", t)], "review_id string, decision_status string, selected_action string, decided_by string, decided_at timestamp")
    done, unknown = repair.applied_decisions(items, decisions)
    assert {(r.review_id, r.decision_status, r.selected_action_sha256 is None) for r in done.collect()} == {("R1", "approved", False), ("R2", "pending", True)}
    assert [r.review_id for r in unknown.collect()] == ["R9"]
    maps = spark.createDataFrame([({"a": "1", "b": "2", "c": None}, {"a": "1", "b": "3"})], "e map<string,string>, a map<string,string>")
    row = maps.select(repair.property_mismatches(F.col("e"), F.col("a")).alias("m"), repair.expected_changes(F.col("e")).alias("x")).first()
    assert (row.m, row.x) == (["b"], ["a=1", "b=2", "c=null"])
    import hashlib

    sha = hashlib.sha256(b"<x/>").hexdigest()
    good = ("r", "o1", "L3_WRITE", "raw-set", "/w:document[1]/w:p[2]", 1, "<x/>", sha, "p.xml", "s1", "R1", 1)
    bad = [good[:1] + ("o2",) + good[2:3] + ("set",) + good[4:], good[:1] + ("o3",) + good[2:4] + ("//p",) + good[5:], good[:1] + ("o4",) + good[2:9] + ("s2",) + good[10:], good[:1] + ("o5",) + good[2:11] + (2,)]
    ops = spark.createDataFrame([good, *bad], "run_id string, operation_id string, risk_class string, command string, xpath string, expected_match_count int, xml string, xml_sha256 string, part string, precondition_sha256 string, review_id string, n_in_batch int")
    approved = spark.createDataFrame([("R1", "approved", sha)], "review_id string, decision_status string, payload_sha256 string")
    parts = spark.createDataFrame([("r", "p.xml", "s1"), ("r", "q.xml", "s2")], "run_id string, part_name string, sha256 string")
    assert {(r.operation_id, r.code) for r in repair.heavy_write_problems(ops, approved, parts).collect()} == {("o2", "heavy_not_raw"), ("o3", "heavy_xpath"), ("o4", "heavy_part_changed"), ("o5", "heavy_not_alone")}


RUN_STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="21"/><w:rFonts w:eastAsia="Base"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="P"><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:b/><w:sz w:val="24"/></w:rPr></w:style><w:style w:type="character" w:styleId="R"><w:rPr><w:sz w:val="28"/><w:i/></w:rPr></w:style></w:styles>"""
RUN_BODY = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="P"/></w:pPr><w:r><w:t>plain</w:t></w:r><w:r><w:rPr><w:rStyle w:val="R"/></w:rPr><w:t> styled</w:t></w:r>
<w:r><w:rPr><w:rStyle w:val="R"/><w:sz w:val="32"/><w:b w:val="0"/></w:rPr><w:t>direct</w:t></w:r></w:p></w:body></w:document>"""


def test_runs_have_four_layers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", RUN_BODY)
        z.writestr("word/styles.xml", RUN_STYLES)
    nodes, _ = documents.scan(spark, f"file://{tmp_path}")
    assert [(r.element_id, r.run_index, r.run_style_id, r.text_preview) for r in documents.runs(nodes).orderBy("run_index").collect()] == [("p-00001", 1, None, "plain"), ("p-00001", 2, "R", "styled"), ("p-00001", 3, "R", "direct")]
    got = {(r.run_index, r.slot): (r.value_str, r.source) for r in documents.run_formats(nodes).collect()}
    assert [got[i, "font_size_pt"] for i in (1, 2, 3)] == [("12.0", "style_inherit"), ("14.0", "style_inherit"), ("16.0", "direct")]
    assert [got[i, "bold"] for i in (1, 2, 3)] == [("true", "style_inherit"), ("true", "style_inherit"), ("false", "direct")]
    assert got[1, "font_east_asia"] == ("Base", "doc_defaults") and (1, "italic") not in got and got[3, "italic"] == ("true", "style_inherit")
    assert (1, "alignment") not in got  # no format of runs


def test_no_depth_is_too_deep(spark):
    chain = spark.createDataFrame([("d", f"s{i}", f"s{i + 1}") for i in range(100)] + [("d", "s100", "s90")], "doc_id string, style_id string, based_on string")
    found = facts.style_chains(chain)
    assert found.where("style_id = 's0'").count() == 101 and found.where("style_id = 's95'").count() == 11
    nodes = spark.createDataFrame([(1, f"/n{i}", f"/n{i - 1}" if i else None) for i in range(70)], "doc_id long, path string, parent_path string")
    assert tree.orphans(nodes, ["/n0"]).count() == 0
    deep = spark.createDataFrame([(1, '{"a":' * 12 + "1" + "}" * 12)], "id long, j string")
    assert files.json_paths(deep, "id", "j").where("value = '1'").first().json_path == "$" + ".a" * 12


def test_decided_heavy_writes_arent_joined(spark, monkeypatch):
    """What an operation says of itself decides before the joins: only open ones are written between them."""
    import hashlib

    from formledger.operators import repair

    sha = hashlib.sha256(b"x").hexdigest()
    rows = [(f"o{i}", 1, "L3_WRITE", "set" if i else "raw-set", "/w:body[1]", 1, "x", sha, "R", "document", "p", 1) for i in range(50)]
    ops = spark.createDataFrame(rows, "operation_id string, run_id long, risk_class string, command string, xpath string, expected_match_count int, xml string, xml_sha256 string, review_id string, part string, precondition_sha256 string, n_in_batch int")
    decisions = spark.createDataFrame([("R", "approved", sha)], "review_id string, decision_status string, payload_sha256 string")
    parts = spark.createDataFrame([(1, "document", "q")], "run_id long, part_name string, sha256 string")
    written, settled = [], repair.settled

    def counted(df, what):
        out = settled(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(repair, "settled", counted)
    got = sorted(tuple(r) for r in repair.heavy_write_problems(ops, decisions, parts).collect())
    assert got == sorted([(f"o{i}", "heavy_not_raw") for i in range(1, 50)] + [("o0", "heavy_part_changed")]) and written == [1]
