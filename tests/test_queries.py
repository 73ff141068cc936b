"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from formledger.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    known = duckdb.connect()
    for t in TABLES:
        known.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    sql = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(tuple(map(plain, r))) for r in known.sql(f"SELECT {sql} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_elements_of_pages_are_counted(spark):
    import re
    from collections import Counter

    nodes, in_pages = Counter(), Counter()
    for (html,) in duckdb.sql(f"SELECT html FROM '{FOLDER}/pages.parquet'").fetchall():
        plain_html = re.sub(r"<!--.*?-->|(?<=<script>).*?(?=</script>)|(?<=<style>).*?(?=</style>)", "", html or "", flags=re.S)
        own = Counter(m.lower() for m in re.findall(r"<([a-zA-Z][a-zA-Z0-9]*)(?=[^<>]*>)", plain_html))
        nodes.update(own)
        in_pages.update(own.keys())
    got = {r.node_type: (r.n_nodes, r.n_pages) for r in catalog.QUERIES["q16_tree_facts"](spark, FOLDER).collect()}
    assert got == {k: (n, in_pages[k]) for k, n in nodes.items()}


def test_files_are_listed(spark):
    import hashlib
    from pathlib import Path

    want = {}
    for path in Path(FOLDER).rglob("*.parquet"):
        want[path.name] = (hashlib.sha256(path.read_bytes()).hexdigest(), path.stat().st_size)
    copies = [v[0] for v in want.values()]
    got = {r.file: (r.sha256, r.size_bytes, r.n_copies) for r in catalog.QUERIES["q21b_inventory"](spark, FOLDER).collect()}
    assert got == {k: (*v, copies.count(v[0])) for k, v in want.items()}


def test_identity_diff_where_a_moved_path_is_another_orders(spark, tmp_path):
    rows = [(30, 1, "F", "1-URGENT"), (1_000_030, 2, "F", "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(r.path_before, r.path_after, r.change, r.fields) for r in catalog.QUERIES["q37_identity_diff"](spark, str(tmp_path)).collect()]
    assert got == [("/p[30]", None, "removed", None)]
