"""Evidence manifests as typed graphs: what each generation may hold, what references must resolve to, what may not go in circles.

Tables, all with ``manifest_id``:

* manifests: version (1 or 2), generation, status, gate_status
* artifacts: artifact_id, kind, schema_id, path, path_kind, sha256, size_bytes, schema_version, required, producer_result_id
* evidence: evidence_id, artifact_id and the fields it repeats of its artifact (``REPEATED``)
* depends: evidence_id, depends_on, one row a dependency
* relations: relation_id, source_type, source_id, target_type, target_id, relation_type
* results: result_id; objects: object_type, object_id (what relations may point at beside artifacts and evidence)
* missing: kind, one row for each required kind that the completeness list calls missing

Every check is a join by manifest and id or a count of keys, so a manifest with most of the rows is spread by its ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

# Generations, kinds and schemas that each may not hold, relation types, statuses.
GENERATIONS = ("pre_acceptance", "post_acceptance", "reporting")
FORBIDDEN = (
    ("pre_acceptance", "kind", "final_acceptance"),
    ("pre_acceptance", "kind", "report"),
    ("pre_acceptance", "kind", "reporting_result"),
    ("pre_acceptance", "schema_id", "final-acceptance"),
    ("pre_acceptance", "schema_id", "reporting-result"),
    ("post_acceptance", "kind", "report"),
    ("post_acceptance", "kind", "reporting_result"),
)
REQUIRED_OF = {"reporting": ("report", "reporting_result")}  #: one of these kinds must be there
STATUSES = ("complete", "complete_with_warnings", "broken")
OBJECTS = ("artifact", "evidence", "issue", "action", "review", "acceptance")
RELATIONS = ("derived_from", "executes", "verifies", "renders", "refreshes", "accepts")
OLD_RELATIONS = ("supports", "fixes", "reviews", "blocks")  #: in version 1 only
KINDS = ("lock", "capability", "snapshot", "plan", "request", "result", "log", "review", "evidence", "toc_acceptance", "final_acceptance", "docx", "html", "png", "raw_xml", "executable", "license")  #: in version 2
REPEATED = ("path", "path_kind", "sha256", "size_bytes", "schema_id", "schema_version", "required", "producer_result_id")
WHEN_REQUIRED = ("path", "path_kind", "sha256", "size_bytes", "producer_result_id")

M = "manifest_id"
SLICE = 25_000_000  #: rows of evidence or relations that are matched at once
LOCAL = 100_000  #: edges of a group whose circles are found in one call; larger groups go round by round


def _rows(df: DataFrame, entity: str | Column, code: str | Column) -> DataFrame:
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.select(M, entity.cast("string").alias("entity_id"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _codes(df: DataFrame, entity: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """A row for each check (a condition that must not hold, and its code); null conditions don't hold."""
    found = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for broken, code in checks]))
    return df.select(M, F.col(entity).cast("string").alias("entity_id"), F.explode(found).alias("code"))


def _unresolved(refs: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """References (not null) without a row of the same manifest."""
    return refs.join(ids.select(M, *on).distinct(), [M, *on], "left_anti")


def _sliced(n_rows: int, *tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """The tables in slices of whole manifests, each with about ``SLICE`` of the rows."""
    n = max(1, -(-n_rows // SLICE))
    for i in range(n):
        yield tables if n == 1 else tuple(t.where(F.pmod(F.xxhash64(M), F.lit(n)) == i) for t in tables)


def _twice(df: DataFrame, key: str, code: str) -> DataFrame:
    return _rows(df.groupBy(M, key).agg(F.count("*").alias("n")).where("n > 1"), key, code)


def forbidden(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifacts of a kind or schema that their manifest's generation may not hold, or that version 2 doesn't know."""
    rows = artifacts.join(manifests.select(M, "generation", "version"), M)
    listed = F.lit(False)
    for generation, field, value in FORBIDDEN:
        listed = listed | ((F.col("generation") == generation) & (F.col(field) == value))
    return _codes(rows, "artifact_id", [((F.col("version") == 1) & listed, "artifact_forbidden"), ((F.col("version") == 2) & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "artifact_kind")])


def required_kinds(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests whose generation needs one of some kinds and has none."""
    out = None
    for generation, kinds in REQUIRED_OF.items():
        need = manifests.where((F.col("generation") == generation) & (F.col("version") == 1))
        lack = need.join(artifacts.where(F.col("kind").isin(*kinds)).select(M).distinct(), M, "left_anti")
        out = _rows(lack, M, "required_kind_absent") if out is None else out.unionByName(_rows(lack, M, "required_kind_absent"))
    return out


def artifact_fields(artifacts: DataFrame) -> DataFrame:
    needed = [(F.col("required") & (F.col(f).isNull() | (F.col(f).cast("string") == "")), f"{f}_required") for f in WHEN_REQUIRED]
    kind = (F.col("required") & ~F.coalesce(F.col("path_kind") == "run_relative", F.lit(False)), "path_kind_run_relative")
    return _codes(artifacts, "artifact_id", [*needed, kind, (F.col("artifact_id").isNull(), "artifact_id_required")])


def repeated_fields(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence whose copy of a field differs from the artifact's (the last of several of one id)."""
    last = artifacts.groupBy(M, "artifact_id").agg(F.max(F.struct("position", *REPEATED)).alias("_own"))
    rows = evidence.join(last, [M, "artifact_id"])
    return _codes(rows, "evidence_id", [(~F.col(f).eqNullSafe(F.col(f"_own.{f}")), f"{f}_differs") for f in REPEATED])


def dependencies(depends: DataFrame, artifacts: DataFrame, evidence: DataFrame, results: DataFrame) -> DataFrame:
    """Dependencies that are no artifact, evidence or result of the manifest."""
    ids = [t.select(M, F.col(c).alias("depends_on")) for t, c in ((artifacts, "artifact_id"), (evidence, "evidence_id"), (results, "result_id"))]
    return _rows(_unresolved(depends, ids[0].unionByName(ids[1]).unionByName(ids[2]), "depends_on"), F.concat_ws(">", "evidence_id", "depends_on"), "dependency_unresolved")


def lookups(relations: DataFrame, manifests: DataFrame, artifacts: DataFrame, evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations of unknown types, and their ends and the artifacts of evidence that aren't there: each is looked up among the ids of its type.

    In version 2 both ends are artifacts, whatever their types say.  What is wrong in itself has no type, so no id meets it.
    """
    rows = relations.join(manifests.select(M, "version"), M)
    new = F.col("version") == 2
    known = F.col("relation_type").isin(*RELATIONS) | (~new & F.col("relation_type").isin(*OLD_RELATIONS))
    row = lambda side, code, kind, name: F.struct(F.lit(side).cast("string").alias("side"), F.lit(code).cast("string").alias("code"), kind.alias("object_type"), name.alias("object_id"))
    none, own = F.lit(None).cast("string"), F.col("relation_id").cast("string")
    asked = [F.when(~F.coalesce(known, F.lit(False)), row(None, "relation_type", none, own))]
    for side in ("source", "target"):
        kind = F.when(new, "artifact").otherwise(F.col(f"{side}_type"))
        supported = F.coalesce(kind.isin(*OBJECTS), F.lit(False))
        asked.append(F.when(supported, row(side, None, kind, F.col(f"{side}_id"))).otherwise(row(side, "object_type", none, own)))
    ends = rows.select(M, own.alias("id"), F.explode(F.array_compact(F.array(*asked))).alias("e")).select(M, "id", "e.*")
    copies = evidence.select(M, F.col("evidence_id").cast("string").alias("id"), none.alias("side"), none.alias("code"), F.lit("artifact").alias("object_type"), F.col("artifact_id").alias("object_id"))
    ids = artifacts.select(M, F.lit("artifact").alias("object_type"), F.col("artifact_id").alias("object_id"))
    ids = ids.unionByName(evidence.select(M, F.lit("evidence").alias("object_type"), F.col("evidence_id").alias("object_id"))).unionByName(objects.where(~F.col("object_type").isin("artifact", "evidence")).select(M, "object_type", "object_id"))
    lost = _unresolved(ends.unionByName(copies), ids, "object_type", "object_id")
    # a relation's own name for its type, with the side for an end
    return _rows(lost, F.concat_ws(".", "id", "side"), F.coalesce("code", F.concat("object_type", F.lit("_unresolved"))))


def reaching_circles(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, node of all nodes from which edges lead into a circle.

    Edges into nodes without successors go, round by round; an edge into a node with one successor skips it, so long chains
    shorten by halves.  While a node remains that reaches no circle, some edge leads into a node without successors: when none
    goes any more, all that remain reach one.  Each round is written and read back.
    """
    now = settled(edges.select(group, F.col(a).alias("_a"), F.col(b).alias("_b")).distinct(), "edges")
    while True:
        out = now.groupBy(group, F.col("_a").alias("_b")).agg(F.count("*").alias("_n"), F.min("_b").alias("_next"))
        step = settled(now.join(out, [group, "_b"], "left").select(group, "_a", F.when(F.col("_n") == 1, F.col("_next")).otherwise(F.col("_b")).alias("_b"), F.col("_n").isNull().alias("_gone")), "edges")
        left = step.where("NOT _gone").select(group, "_a", "_b").distinct()
        if step.where("_gone").isEmpty():
            return left.select(group, F.col("_a").alias("node")).distinct()
        now = settled(left, "edges")


def _core(edges: list[tuple[str, str]]) -> set[str]:
    """Nodes that are left when those without a predecessor or without a successor go, until none is left to go."""
    down, up = {}, {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
        up.setdefault(b, []).append(a)

    def reach(ahead: dict, back: dict) -> set[str]:
        left, ends = {n: len(to) for n, to in ahead.items()}, [n for n in back if n not in ahead]
        while ends:
            for n in back.get(ends.pop(), ()):
                left[n] -= 1
                if not left[n]:
                    ends.append(n)
        return {n for n, k in left.items() if k}

    return reach(down, up) & reach(up, down)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, a, b) in the order of their groups to rows (group, node); one group is held at a time."""
    held, edges = None, []
    for batch in batches:
        groups, nodes = [], []
        for g, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if g != held:
                found = _core(edges)
                groups += [held] * len(found)
                nodes += found
                held, edges = g, []
            edges.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.field(0).type), pa.array(nodes, batch.schema.field(1).type)], names=["group", "node"])
        schema = batch.schema
    if edges:
        found = _core(edges)
        yield pa.RecordBatch.from_arrays([pa.array([held] * len(found), schema.field(0).type), pa.array(list(found), schema.field(1).type)], names=["group", "node"])


def circles(edges: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, node of all nodes in circles or on the way from one to another: what iterated removal from both ends leaves.

    Groups of up to ``LOCAL`` edges are dealt to tasks and done one by one; only larger ones take rounds over all their edges.
    """
    known = settled(edges.select(group, F.col(a).alias("_a"), F.col(b).alias("_b")).dropna(), "edges")
    large = known.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL).select(group)
    some = not large.isEmpty()
    if some:
        large = settled(large, "large-groups")
    small = known.join(large, group, "left_anti") if some else known
    types = {f.name: f.dataType.simpleString() for f in known.schema}
    found = small.repartition(group).sortWithinPartitions(group).mapInArrow(_cores, f"group {types[group]}, node {types['_a']}").withColumnRenamed("group", group)
    if some:
        rest = known.join(large, group, "left_semi")
        found = found.unionByName(reaching_circles(rest, group, "_a", "_b").intersect(reaching_circles(rest, group, "_b", "_a")))
    return found


def violations(manifests: DataFrame, artifacts: DataFrame, evidence: DataFrame, depends: DataFrame, relations: DataFrame, results: DataFrame, objects: DataFrame, missing: DataFrame) -> DataFrame:
    """manifest_id, entity_id, code: everything wrong with each manifest; written once, for both rows and statuses read it."""
    own = [
        (F.col("version").isNull() | ~F.col("version").isin(1, 2), "version"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
        ((F.col("version") == 1) & ~F.coalesce(F.col("generation").isin(*GENERATIONS), F.lit(False)), "generation"),
    ]
    lacking = manifests.join(missing.select(M).distinct(), M, "left_semi")
    incomplete = [(F.col("status") != "broken", "incomplete_not_broken"), (F.col("gate_status") == "passed", "incomplete_gate_passed")]
    producers = [t.where(F.col("producer_result_id").isNotNull()).select(M, F.col(i).alias("_id"), F.col("producer_result_id").alias("result_id")) for t, i in ((artifacts, "artifact_id"), (evidence, "evidence_id"))]
    inner = depends.join(evidence.select(M, F.col("evidence_id").alias("depends_on")).distinct(), [M, "depends_on"], "left_semi")
    plain = [
        [_codes(manifests, M, own), _codes(lacking, M, incomplete), required_kinds(artifacts, manifests)],
        [forbidden(artifacts, manifests), artifact_fields(artifacts), _twice(artifacts.where(F.col("artifact_id").isNotNull()), "artifact_id", "artifact_twice"), _twice(evidence.where(F.col("evidence_id").isNotNull()), "evidence_id", "evidence_twice")],
        [_rows(_unresolved(producers[0].unionByName(producers[1]), results, "result_id"), "_id", "producer_unresolved")],
        [dependencies(depends, artifacts, evidence, results)],
        [_rows(circles(inner, M, "evidence_id", "depends_on"), "node", "dependency_circle")],
    ]
    steps = [reduce(DataFrame.unionByName, step) for step in plain]
    # each step, and each slice of a large one, is written before the next begins, so their shuffles don't lie on disk together;
    # a code comes from one step, and a manifest lies in one slice, so no row comes from two of them
    n_evidence, n_relations = evidence.count(), relations.count()
    steps += [repeated_fields(e, a) for e, a in _sliced(n_evidence, evidence, artifacts)]
    steps += [lookups(*some) for some in _sliced(n_relations, relations, manifests, artifacts, evidence, objects)]
    first, *more = [step.distinct() for step in steps]
    return settled(first, "violations", *more)


def statuses(manifests: DataFrame, found: DataFrame) -> DataFrame:
    """manifest_id, status, codes: broken with any violation; one that doesn't say so itself gets that as a further code."""
    codes = found.groupBy(M).agg(F.collect_set("code").alias("codes"))
    rows = manifests.join(codes, M, "left")
    wrong = F.col("codes").isNotNull()
    more = F.when(F.col("status") != "broken", F.array(F.lit("status_not_broken"))).otherwise(F.array().cast("array<string>"))
    return rows.select(M, F.when(wrong, "broken").otherwise(F.col("status")).alias("status"), F.array_sort(F.when(wrong, F.concat("codes", more)).otherwise(F.array().cast("array<string>"))).alias("codes"))


def closed_fields(json: Column, required: list[str], optional: list[str]) -> tuple[Column, Column]:
    """(missing, unknown): names of an object's fields that it lacks, and of those that it may not have."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    need, may = (F.array(*[F.lit(f) for f in sorted(names)]) for names in (required, [*required, *optional]))
    return F.array_except(need, keys), F.array_sort(F.array_except(keys, may))
