"""What grows with the input is dealt by its size, read once, or dropped where it is read."""

import re

from pyspark.sql import functions as F

from graphloom import catalog, catalog_enrich, catalog_store  # noqa: F401 (they register their queries)
from graphloom.operators import enrich as E
from graphloom.operators import graph as G
from graphloom.operators import impact as I
from graphloom.operators import store as T
from graphloom.operators import walks as K

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_other_kinds_go_where_they_are_read(spark):
    edges = spark.createDataFrame([("1", "a:1", "b:1"), ("2", "a:1", "c:1"), ("3", "a:2", "b:1"), ("4", None, "b:1")], "id string, source_id string, target_id string")
    nodes = spark.createDataFrame([("a:1",), ("b:1",), (None,)], "id string")
    out = G.induced(edges, nodes)
    assert [r["id"] for r in out.collect()] == ["1"]
    assert "IN (a,b)" in plan(out.select("id"))
    bare = spark.createDataFrame([(f"n{i}",) for i in range(150)], "id string")  # too many kinds to tell
    named = spark.createDataFrame([("1", "n1", "n149"), ("2", "n1", "n150")], "id string, source_id string, target_id string")
    assert [r["id"] for r in G.induced(named, bare).collect()] == ["1"]


def test_only_large_groups_are_dealt_by_range(spark):
    rows = spark.createDataFrame([(k, f"{i:03d}") for k, n in (("a", 40), ("b", 3), (None, 2)) for i in range(n)], "k string, o string")
    for most in (10, 100):
        got = {(r["k"], r["o"]): r["n"] for r in K.numbered_by(rows, "k", ["o"], "n", most).collect()}
        assert got == {(k, f"{i:03d}"): i + 1 for k, n in (("a", 40), ("b", 3), (None, 2)) for i in range(n)}
    assert "join" not in plan(K.numbered_by(rows, "k", ["o"], "n")).lower()


def test_a_manifest_is_read_once(spark):
    text = '{"dependencies": {"x": "1"}, "peerDependencies": {"x": "2", "y": "3"}, "main": "m.js", "bin": {"main": "b.js"}}'
    facts = T.manifest_facts(spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "k int, t string"), "k", "t")
    assert sorted((r["k"], r["block"], r["name"], r["version"]) for r in facts.collect()) == [(1, "dependencies", "x", "1"), (1, "entry", "main", "b.js"), (1, "entry", "main", "m.js"), (1, "peerDependencies", "y", "3")]
    assert len(re.findall("Generate", plan(facts))) == 1


def test_edges_of_a_type_are_read_once(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b"), ("OTHER", "a", "b")], "type string, source_id string, target_id string")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    out = E.references(edges, nodes, {"callers": ("CALLS", "target"), "callees": ("CALLS", "source")})
    assert sorted(map(tuple, out.collect())) == [("callees", "a", "b", "B"), ("callers", "b", "a", "A")]
    assert "Union" not in plan(out)


def test_parts_follow_the_size_of_the_files(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_BYTES", 1000)
    for name in ("cochange_pairs", "cochange_rule_support", "enrichment", "diff_parse"):
        found = [int(x) for x in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan(catalog.QUERIES[name](spark, FOLDER)))]
        assert found and min(found) > 50, name


def test_the_edges_of_a_walk_are_written_once(spark, monkeypatch):
    written, staged = [], I.staged
    monkeypatch.setattr(I, "staged", lambda df: written.append(df.columns) or staged(df))
    edges = spark.createDataFrame([("1", "CALLS", "a", "b")], "id string, type string, source_id string, target_id string")
    matches = spark.createDataFrame([("ex", "b", "exact", False, False)], "concept string, id string, mechanism string, ambiguous boolean, test_only boolean")
    assert {r["id"] for r in I.traverse(edges, matches, 1, 0).collect()} == {"a", "b"}
    assert written[0] == ["id", "type", "source_id", "target_id"]


def test_pairs_of_a_route_are_dealt_over_slices(spark, monkeypatch):
    """A route of very many pairs isn't made by one task, and what has no endpoint or no route stays."""
    monkeypatch.setattr(E, "SLICE_ROWS", 10, raising=False)
    calls = [(i, "get", "/en/7") for i in range(95)] + [(200, "get", "/none"), (201, "post", "/en/8"), (202, "get", None), (203, "get", "/few"), (203, "get", "/few")]
    ends = [(f"p{i}", "get", f"/en/{i}") for i in range(35)] + [("p0", "get", "/en/1"), ("q", "get", "/few"), ("r", "get", None)]
    out = E.linked_calls(spark.createDataFrame(calls, "caller long, verb string, path string"), spark.createDataFrame(ends, "endpoint string, verb string, path string"))
    rows = sorted((r["caller"], str(r["endpoint"]), r["verb"]) for r in out.collect())
    assert rows == sorted([(i, f"p{j}", "GET") for i in range(95) for j in range(35)] + [(200, "None", "GET"), (201, "None", "POST"), (202, "None", "GET"), (203, "q", "GET"), (203, "q", "GET")])
    most = max(r["count"] for r in out.filter("endpoint like 'p%'").groupBy(F.spark_partition_id().alias("part")).count().collect())
    assert most < 95 * 35 / 3
