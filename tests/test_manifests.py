"""Manifests of three generations, references by type, and circles against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from formledger.operators import manifests

TABLES = {
    "manifests": "manifest_id long, version int, generation string, status string, gate_status string",
    "artifacts": "manifest_id long, artifact_id string, position long, kind string, schema_id string, path string, path_kind string, sha256 string, size_bytes long, schema_version string, required boolean, producer_result_id string",
    "evidence": "manifest_id long, evidence_id string, artifact_id string, path string, path_kind string, sha256 string, size_bytes long, schema_id string, schema_version string, required boolean, producer_result_id string",
    "depends": "manifest_id long, evidence_id string, depends_on string",
    "relations": "manifest_id long, relation_id string, source_type string, source_id string, target_type string, target_id string, relation_type string",
    "results": "manifest_id long, result_id string",
    "objects": "manifest_id long, object_type string, object_id string",
    "missing": "manifest_id long, kind string",
}


def found(spark, **rows):
    made = {t: spark.createDataFrame(rows.get(t, []), schema) for t, schema in TABLES.items()}
    wrong = manifests.violations(**made)
    status = {r.manifest_id: (r.status, r.codes) for r in manifests.statuses(made["manifests"], wrong).collect()}
    return sorted((r.manifest_id, r.entity_id, r.code) for r in wrong.collect()), status


def artifact(m, name, kind, schema="s", required=True, producer="r"):
    return (m, name, 1, kind, schema, "p", "run_relative", "a" * 64, 1, "1", required, producer)


def copy_of(a, name, size=None):
    return (a[0], name, a[1], a[5], a[6], a[7], a[8] if size is None else size, a[4], a[9], a[10], a[11])


def test_generations(spark):
    own = [(1, 1, "pre_acceptance", "complete", "passed"), (2, 1, "post_acceptance", "complete", "passed"), (3, 1, "reporting", "complete", "passed"), (4, 1, "reporting", "broken", "passed"), (5, 2, None, "complete", "failed"), (6, None, "x", None, None)]
    arts = [artifact(m, f"{k}{m}", k) for m in (1, 2, 3) for k in ("final_acceptance", "report", "plan")] + [artifact(1, "by_schema", "plan", "reporting-result"), artifact(4, "a", "plan"), artifact(5, "a", "report"), artifact(5, "b", "docx")]
    rows, status = found(spark, manifests=own, artifacts=arts, results=[(m, "r") for m in range(1, 7)])
    assert rows == [
        (1, "by_schema", "artifact_forbidden"), (1, "final_acceptance1", "artifact_forbidden"), (1, "report1", "artifact_forbidden"),
        (2, "report2", "artifact_forbidden"), (4, "4", "required_kind_absent"), (5, "a", "artifact_kind"), (6, "6", "status"), (6, "6", "version"),
    ]
    assert status[3] == ("complete", []) and status[4] == ("broken", ["required_kind_absent"]) and status[2] == ("broken", ["artifact_forbidden", "status_not_broken"])


def test_references_by_type(spark):
    a, b = artifact(1, "a", "plan"), artifact(1, "b", "log", producer="gone")
    rows, _ = found(
        spark,
        manifests=[(1, 1, "pre_acceptance", "complete", "passed"), (2, 2, None, "complete", "passed")],
        artifacts=[a, b, artifact(2, "a", "plan")],
        evidence=[copy_of(a, "e"), copy_of(a, "f", size=2), copy_of(artifact(1, "zz", "plan"), "g"), copy_of(a, "e")],
        depends=[(1, "e", "a"), (1, "e", "r"), (1, "e", "f"), (1, "f", "issue1")],
        relations=[(1, "x", "artifact", "a", "evidence", "e", "fixes"), (1, "y", "evidence", "a", "issue", "issue1", "fixes"), (1, "z", "result", "r", "action", "issue1", "owns"), (2, "x", "evidence", "a", "issue", "b", "fixes")],
        results=[(1, "r"), (2, "r")],
        objects=[(1, "issue", "issue1")],
        missing=[(2, "log")],
    )
    assert rows == [
        (1, "b", "producer_unresolved"), (1, "e", "evidence_twice"), (1, "f", "size_bytes_differs"), (1, "f>issue1", "dependency_unresolved"), (1, "g", "artifact_unresolved"),
        (1, "y.source", "evidence_unresolved"), (1, "z", "relation_type"), (1, "z.source", "object_type"), (1, "z.target", "action_unresolved"),
        (2, "2", "incomplete_gate_passed"), (2, "2", "incomplete_not_broken"), (2, "x", "relation_type"), (2, "x.target", "artifact_unresolved"),
    ]


def left(edges):
    """Removal of nodes without predecessors or successors, by hand."""
    edges = set(edges)
    while True:
        stay = {(a, b) for a, b in edges if any(y == a for _, y in edges) and any(x == b for x, _ in edges)}
        if stay == edges:
            return {n for e in edges for n in e}
        edges = stay


@pytest.mark.parametrize("seed", range(4))
def test_circles(spark, seed):
    rng = random.Random(seed)
    groups = {g: [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for g, (n, m) in enumerate([(30, 20), (30, 30), (12, 20), (3, 2), (60, 50)])}
    if seed == 0:  # long chains, one of them into a circle and out of it, and two circles with a bridge
        groups[7] = [(i, i + 1) for i in range(200)]
        groups[8] = [(i, i + 1) for i in range(150)] + [(90, 60)]
        groups[9] = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 3), (9, 0), (4, 8)]
    df = spark.createDataFrame([(g, str(a), str(b)) for g, edges in groups.items() for a, b in edges], "g int, a string, b string")
    got = {}
    for r in manifests.circles(df, "g", "a", "b").collect():
        got.setdefault(r.g, set()).add(int(r.node))
    assert got == {g: left(edges) for g, edges in groups.items() if left(edges)}


def test_closed_fields(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"x": 1}, "z": 2}',), ('{"a": null}',), ("[1]",)], "j string")
    need, more = manifests.closed_fields(F.col("j"), ["a", "b"], ["c"])
    assert [(r.n, r.m) for r in df.select(need.alias("n"), more.alias("m")).collect()] == [([], ["z"]), (["b"], []), (["a", "b"], [])]


def test_circles_of_small_groups_take_no_rounds(spark, monkeypatch):
    edges = [(g, str(i), str(i + 1)) for g in range(300) for i in range(40)] + [(g, "40", str(g % 37)) for g in range(0, 300, 3)] + [(1, "x", None), (None, "x", "x")]
    df = spark.createDataFrame(edges, "g int, a string, b string")
    want = {(g, str(i)) for g in range(0, 300, 3) for i in range(g % 37, 41)}
    spark.sparkContext.setJobGroup("circles", "circles")
    rows = [(r.g, r.node) for r in manifests.circles(df, "g", "a", "b").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("circles")) < 15
    spark.sparkContext.setJobGroup("others", "others")
    monkeypatch.setattr(manifests, "LOCAL", 40)  # groups with a circle have 41 edges
    rows = [(r.g, r.node) for r in manifests.circles(df, "g", "a", "b").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_violations_are_computed_once(spark):
    made = {t: spark.createDataFrame([], schema) for t, schema in TABLES.items()}
    wrong = manifests.violations(**made)
    plan = manifests.statuses(made["manifests"], wrong)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # the checks' rows are read, not made again


def test_slices_give_the_same_rows(spark, monkeypatch):
    arts = [artifact(m, f"a{m % 3}", "plan", producer="gone" if m % 4 else "r") for m in range(12)]
    rows = dict(
        manifests=[(m, 2 if m == 5 else 1, "pre_acceptance", "complete", "passed") for m in range(12)],
        artifacts=arts,
        evidence=[copy_of(a, f"e{i}", size=i % 2) for i, a in enumerate(arts)] + [copy_of(artifact(3, None, "plan"), "n"), copy_of(artifact(3, "zz", "plan"), "x.source")],
        relations=[(m, "x", "artifact", f"a{i}", "issue", "i", "owns") for m in range(12) for i in range(4)] + [(3, None, "evidence", "e3", "else", None, "fixes"), (3, "x", "evidence", None, "review", "i", "fixes")],
        results=[(m, "r") for m in range(12)],
        objects=[(m, "issue", "i") for m in range(0, 12, 2)],
    )
    want = found(spark, **rows)
    assert len(want[0]) == len(set(want[0])) and {c for _, _, c in want[0]} >= {"artifact_unresolved", "evidence_unresolved", "issue_unresolved", "object_type", "relation_type", "size_bytes_differs"}
    monkeypatch.setattr(manifests, "SLICE", 5)
    assert found(spark, **rows) == want


def test_shuffle_files_go_when_rows_are_written(spark):
    from pathlib import Path

    from formledger.sources import tables

    def shuffled():
        return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}

    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count()
    before, setting = shuffled(), spark.conf.get(tables.TIDY)
    rows = tables.settled(df, "tidy", df)
    assert spark.conf.get(tables.TIDY) == setting
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and rows.count() == 20


def test_checks_are_written_one_after_another(spark, monkeypatch):
    steps = []
    whole = manifests.settled
    monkeypatch.setattr(manifests, "settled", lambda df, what, *more: steps.append((what, 1 + len(more))) or whole(df, what, *more))
    found(spark, manifests=[(1, 1, "pre_acceptance", "complete", "passed")])
    assert dict(steps)["violations"] >= 6
