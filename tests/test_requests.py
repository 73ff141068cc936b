"""Requests against rebuilt plans: a round trip, each altered field, canonical forms, the editor's form of an operation."""

import json

import pytest
from pyspark.sql import functions as F

from formledger.functions import scalars
from formledger.operators import requests


def action(i, command="set", risk="L1", status="executable", **backend):
    return {"action_id": f"A{i}", "status": status, "execution_status": status, "risk_class": risk, "target_binding": {"path": f"/t{i}"}, "backend_action": {"command": command, **backend}}


def actions(spark, rows):
    return spark.createDataFrame([(run, i, json.dumps(a) if isinstance(a, dict) else a) for run, i, a in rows], "run_id string, position long, action string")


def rebuilt(spark, rows):
    acts = actions(spark, rows)
    plans = acts.select("run_id").distinct().withColumn("plan_sha256", F.lit("p")).withColumn("before_sha256", F.lit("b"))
    return requests.batches(requests.operations(acts), plans)


ROWS = [("r", i, action(i, properties={"size": i + 0.5, "bold": True}, path=f"/p[{i}]")) for i in range(20)]
ROWS[5] = ("r", 5, action(5, "raw-set", "L3_WRITE", raw={"action": "replace", "xml": "<a/>"}))
ROWS += [("r", 30, action(30, status="blocked")), ("r", 31, action(31, "query")), ("r", 32, "broken"), ("s", 1, action(1, "move", index=3, destination_path="/d")), ("t", 1, None)]


def request_of(batches, run):
    return {"batches": [json.loads(b.batch) for b in sorted(batches, key=lambda b: b.sequence) if b.run_id == run]}


def test_batches_and_round_trip(spark):
    made = rebuilt(spark, ROWS)
    got = made.collect()
    sizes = {(b.run_id, b.sequence): (json.loads(b.batch)["max_operations"], [o["source_action_id"] for o in json.loads(b.batch)["operations"]]) for b in got}
    assert sizes == {("r", 1): (5, [f"A{i}" for i in range(5)]), ("r", 2): (1, ["A5"]), ("r", 3): (12, [f"A{i}" for i in range(6, 18)]), ("r", 4): (2, ["A18", "A19"]), ("s", 1): (1, ["A1"])}
    assert json.loads(got[0].batch)["operations"][0]["path"] in ("/p[0]", "/t1", "/t5", "/p[6]", "/p[18]")
    texts = [(run, json.dumps(request_of(got, run))) for run in ("r", "s")]
    back = requests.batches_of(spark.createDataFrame(texts, "run_id string, request string"))
    assert requests.differences(made, back).collect() == []


def test_each_altered_field_is_one_row(spark):
    made = rebuilt(spark, ROWS)
    request = request_of(made.collect(), "r")
    first, second, third, fourth = request["batches"]
    first["checkpoint_ref"] = {"x": 1}  # added by a run
    first["timeout_seconds"] = 120.0  # the same number
    first["operations"][2]["properties"]["size"] = 9
    second["operations"][0]["raw"]["xml"] = "<b/>"
    second["atomicity"] = "none"
    del third["operations"][11]["path"]
    fourth["operations"].append({"command": "set"})
    text = json.dumps({"batches": [first, second, third, fourth, {"batch_id": "more"}]})
    found = requests.differences(made.where("run_id = 'r'"), requests.batches_of(spark.createDataFrame([("r", text)], "run_id string, request string")))
    got = sorted((r.sequence, r.json_path, r.expected, r.actual) for r in found.collect())
    assert got == [
        (1, "$.operations[2].properties.size", "2.5", "9"),
        (2, "$.atomicity", '"stop_on_first_error"', '"none"'),
        (2, "$.operations[0].raw.xml", '"<a/>"', '"<b/>"'),
        (3, "$.operations[11].path", '"/p[17]"', None),
        (4, "$.operations[2].command", None, '"set"'),
        (5, "$", None, '{"batch_id":"more"}'),
    ]
    assert [r.json_path for r in requests.first_differences(found).where("sequence = 2").collect()] == ["$.atomicity"]


@pytest.mark.parametrize("a, b, same", [("[1]", "[1.0]", True), ("[1e3]", "[1000]", True), ('{"b":1,"a":2.50}', '{"a": 2.5, "b": 1.0}', True), ('["1.0E10"]', '["10000000000"]', False), ("[-0.0]", "[0]", True), ("[1.5e-3]", "[0.0015]", True), ('["a\\"1.0E5", 1e5]', '["a\\"1.0E5", 100000]', True), ("[2]", '["2"]', False), ("[12, -3.0, 2e2]", "[12,-3,200]", True), ("[1e-5, 12.50, 7]", "[0.00001,12.5,7.0]", True), ("[1e3, \"1000.0\"]", "[1000, \"1000\"]", False)])
def test_canonical_numbers(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(scalars.canonical_json(F.col("a")).alias("a"), scalars.canonical_json(F.col("b")).alias("b")).first()
    assert (row.a == row.b) is same and json.loads(row.a) == json.loads(a)


def test_native(spark):
    rows = [
        action(1, "add", path="/x", element_type="p", properties={"a": 1, "b": 1.0, "c": None, "d": True, "e": "t"}, index=2, destination_path="/y"),
        action(2, "move", element_type="p", destination_path="/y", index="2"),
        action(3, "raw-set", raw={"action": "replace", "xml": "<a/>", "part": None, "other": 1}, properties={}),
        action(4, "raw-set", raw={"action": "burn"}),
    ]
    ops = requests.operations(actions(spark, [("r", i, a) for i, a in enumerate(rows)]))
    got = [json.loads(r.n) for r in ops.orderBy("position").select(requests.native().alias("n")).collect()]
    assert got[0] == {"command": "add", "path": "/x", "type": "p", "props": {"a": "1", "b": "1.0", "d": "True", "e": "t"}, "index": 2}
    assert got[1] == {"command": "move", "path": "/t2", "to": "/y"}
    assert got[2] == {"command": "raw-set", "path": "/t3", "action": "replace", "xml": "<a/>"}
    assert [(r.position, r.code) for r in requests.raw_problems(ops).collect()] == [(3, "raw_action")]


def test_only_what_differs_is_taken_apart(spark, monkeypatch):
    """Of a batch with many values, those on the way to a difference; one side a value, the other a list or an object."""
    a = {"ops": [{"k": i, "raw": None} for i in range(300)], "x": {"y": [1, {"z": 2}]}, "only": {}}
    b = {"ops": [{"k": i, "raw": {} if i == 7 else None} for i in range(301)], "x": {"y": 5}}
    written, settled = {}, requests.settled

    def counted(df, what):
        out = settled(df, what)
        written[what] = written.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(requests, "settled", counted)
    make = lambda v: spark.createDataFrame([(1, 1, json.dumps(v, sort_keys=True, separators=(",", ":")))], "run_id long, sequence long, batch string")
    got = sorted(tuple(r)[2:] for r in requests.differences(make(a), make(b)).collect())
    assert got == sorted(
        [("$.ops[7].raw", "null", "{}"), ("$.ops[300].k", None, "300"), ("$.ops[300].raw", None, "null"), ("$.x.y", None, "5"), ("$.x.y[0]", "1", None), ("$.x.y[1].z", "2", None), ("$.only", "{}", None)]
    )
    assert written["differing-values"] < 20
