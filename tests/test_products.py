import zipfile

from pyspark.sql import functions as F

from formledger.plans import products

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write(folder, name, sizes):
    body = "".join(f'<w:p><w:pPr><w:jc w:val="{a}"/><w:ind w:left="{i}"/></w:pPr><w:r><w:t>line</w:t></w:r></w:p>' for a, i in sizes)
    with zipfile.ZipFile(folder / name, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def test_from_standard_to_verdicts(spark, tmp_path):
    standard, targets, after = (tmp_path / n for n in ("standard", "targets", "after"))
    for f in (standard, targets, after):
        f.mkdir()
    write(standard, "s.docx", [("center", 0), ("both", 567), ("both", 567)])
    write(targets, "t.docx", [("center", 0), ("left", 567), ("both", 1134)])
    write(after, "t.docx", [("center", 0), ("both", 567), ("both", 1134)])
    role = F.when(F.col("paragraph_index") == 1, "title").otherwise("body")
    known, problems = products.format_facts(spark, f"file://{standard}", role)
    assert problems.count() == 0
    contract = spark.createDataFrame([("title", "alignment", "required"), ("body", "bold", "required")], "role_kind string, slot string, requirement string")
    rules, missing = products.rule_summary(known, contract)
    assert [(r.role_kind, r.slot, r.code) for r in missing.collect()] == [("body", "bold", "required_slot_missing")]
    assert products.audit_items(known, rules).count() == 0
    issues = products.audit_items(products.format_facts(spark, f"file://{targets}", role)[0], rules)
    rows = {(r.element_id, r.slot): (r.actual, r.expected, r.auto_fix_policy) for r in issues.collect()}
    assert rows == {("p-00002", "alignment"): ("left", "both", "auto-fix"), ("p-00003", "left_indent_cm"): ("2.0", "1.0", "auto-fix")}
    ops = products.repair_operations(issues, spark.createDataFrame([], "issue_id string, decision_status string"))
    assert [(r.batch, r.position, r.risk_class) for r in ops.orderBy("sequence").collect()] == [(1, 1, "L1"), (1, 2, "L1")]
    now = products.format_facts(spark, f"file://{after}", role)[0].drop("doc_id").join(issues.select("doc_id").distinct())
    results = issues.select("issue_id", F.lit(True).alias("success"))
    verdicts = {r.verdict_code for r in products.review(ops, results, now).collect()}
    assert verdicts == {None, "after_property_mismatch"}


def test_acceptance(spark):
    from formledger.operators import ledger
    from formledger.sources import files

    sha = "a" * 64
    artifacts = spark.createDataFrame([("r1", "A1", "plan", "r1/p", sha, 5), ("r1", "A2", "log", "r1/l", sha, 5), ("r2", "A3", "plan", "../p", sha, 0)], "run_id string, artifact_id string, kind string, path string, sha256 string, size_bytes long")
    inventory = spark.createDataFrame([("r1/p", sha, 5), ("r1/l", sha, 5)], "path string, sha256 string, size_bytes long")
    refs = spark.createDataFrame([("r1", "A1"), ("r2", "A9")], "run_id string, artifact_id string")
    got = {r.run_id: (r.status, r.codes) for r in products.acceptance(artifacts, refs, inventory, ["plan", "log"]).collect()}
    assert got == {"r1": ("accepted", []), "r2": ("blocked", ["artifact_missing", "kinds_missing", "path_unsafe", "reference_dangling", "size_positive"])}
    expected = spark.createDataFrame([("t1", "x/p"), ("t2", "x/q")], "test_id string, path string")
    assert [r.test_id for r in ledger.missing_files(expected, inventory).collect()] == ["t2"]
    tests = spark.createDataFrame([("t1", "ok"), ("t2", "ok"), ("t3", "open")], "test_id string, status string")
    assert {(r.status, r.n, tuple(r.ids)) for r in ledger.coverage_summary(tests).collect()} == {("ok", 2, ("t1", "t2")), ("open", 1, ("t3",))}
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, "broken")], "id long, j string")
    assert {(r.json_path, r.value) for r in files.json_paths(rows, "id", "j").collect()} == {("$", '{"a":[1,{"b":null}],"c":"x"}'), ("$.a", '[1,{"b":null}]'), ("$.a[0]", "1"), ("$.a[1]", '{"b":null}'), ("$.a[1].b", "null"), ("$.c", '"x"')}


def test_word_files_lie_together_and_are_read_like_single_ones(spark, tmp_path):
    from formledger.plans import wordfiles
    from formledger.sources import documents

    docs = spark.createDataFrame([(i, f"Title {i}\n\nbody text {i}.") for i in range(60)], "doc_id long, text string").coalesce(1)
    files = wordfiles.written(docs, f"file://{tmp_path}/packed")
    assert len(list((tmp_path / "packed").glob("*.parquet"))) < 5
    single = tmp_path / "single"
    single.mkdir()
    for r in files.collect():
        (single / r.file.rsplit("/", 1)[1]).write_bytes(r.content)
    columns = ["doc_id", "part_name", "pos", "path", "parent_path", "node_type", "text", "attributes", "size_bytes"]
    rows = lambda pair: (sorted(map(str, pair[0].select(columns).collect())), sorted(pair[1].select("doc_id", "problem", "size_bytes").collect()))
    packed = rows(documents.told_apart(documents.flattened(files)))
    assert packed == rows(documents.scan(spark, f"file://{single}")) and len(packed[1]) == 2
    got = lambda df: sorted(df.select("part_name", "sha256", "size_bytes").collect())
    assert got(documents.parts_of(files)) == got(documents.parts(spark, f"file://{single}"))


def test_formats_need_only_their_own_nodes(spark, tmp_path):
    from formledger.sources import documents

    runs = '<w:r><w:rPr><w:b/><w:sz w:val="30"/></w:rPr><w:t>text</w:t></w:r>'
    body = f'<w:p><w:pPr><w:pStyle w:val="A"/><w:jc w:val="both"/><w:rPr><w:i/></w:rPr><w:pPrChange><w:pPr><w:ind w:left="9"/></w:pPr></w:pPrChange></w:pPr>{runs}</w:p><w:tbl><w:tr><w:tc><w:p>{runs}</w:p></w:tc></w:tr></w:tbl><w:p/>'
    styles = '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="21"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="A"><w:name w:val="a"/><w:basedOn w:val="B"/><w:pPr><w:spacing w:before="40"/></w:pPr></w:style><w:style w:styleId="B"><w:name w:val="b"/><w:rPr><w:b/></w:rPr></w:style>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    (tmp_path / "b.docx").write_bytes(b"x")
    rows = documents.flattened(documents.files_below(spark, f"file://{tmp_path}"))
    nodes, problems = documents.told_apart(rows)
    got = lambda df: sorted(map(str, df.collect()))
    for texts in (True, False):
        kept, bad = documents.told_apart(documents.format_nodes(rows, texts))
        assert kept.count() < nodes.count() and got(bad) == got(problems)
        assert got(documents.paragraph_formats(kept)) == got(documents.paragraph_formats(nodes)) and got(documents.styles(kept)) == got(documents.styles(nodes))
        columns = [c for c in documents.paragraphs(nodes).columns if texts or c != "text_preview"]
        assert got(documents.paragraphs(kept).select(columns)) == got(documents.paragraphs(nodes).select(columns))


def test_word_files_that_are_read_once_are_not_written(spark, small, monkeypatch):
    from formledger.plans import wordfiles

    monkeypatch.setattr(wordfiles, "written", None)
    for name in ("q49d_summary", "q49e_parts", "q50_products"):
        assert wordfiles.QUERIES[name](spark, small).count() > 0
