"""Every graph query against its DuckDB counterpart, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom import catalog, catalog_enrich, catalog_impact, catalog_preflight, catalog_requirements, catalog_review, catalog_rules, catalog_search, catalog_store, catalog_text, catalog_walks  # noqa: F401 (they register their queries)
from graphloom.operators import graph as G
from graphloom.operators import impact as I
from graphloom.operators import rules as R
from graphloom.plans import lift
from graphloom.sources.snapshot import read_graph, write_graph

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(str(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_distances_on_a_cycle_and_empty_anchors(spark):
    edges = spark.createDataFrame([("x", "E", "a", "b"), ("y", "E", "b", "c"), ("z", "E", "c", "a")], "id string, type string, source_id string, target_id string")
    anchors = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in G.distances(edges, anchors, 5, directed=True).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert G.distances(edges, anchors.filter("false"), 3).count() == 0


def test_longest_prefix_takes_whole_segments(spark):
    rows = spark.createDataFrame([("1", "a/b/c"), ("2", "a/bc"), ("3", None)], "id string, path string")
    owners = spark.createDataFrame([("o1", "a"), ("o2", "a/b")], "id string, path string")
    assert {r["id"]: r["owner"] for r in G.longest_prefix(rows, "path", owners).collect()} == {"1": "o2", "2": "o1", "3": None}


def test_impact_walk(spark):
    """Ownership upward only, chain hops of their own budget, state of the first arrival, routes that merge."""
    rows = [("CONTAINS", "own", "x"), ("CONTAINS", "x", "part"), ("CALLS", "y", "x"), ("READS_FROM", "x", "y"), ("CALLS", "z", "y"), ("PUBLISHES", "z", "topic"), ("PUBLISHES", "w", "topic"), ("OWNS", "x", "never")]
    edges = spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b) for t, a, b in rows], "id string, type string, source_id string, target_id string")
    matches = spark.createDataFrame([("ex", "x", "exact", False, False)], "concept string, id string, mechanism string, ambiguous boolean, test_only boolean")
    got = {r.id: r for r in I.traverse(edges, matches, 2, 8).collect()}
    assert {k: r.distance for k, r in got.items()} == {"x": 0, "own": 1, "y": 1, "z": 2, "topic": 3, "w": 4}
    assert got["y"].corroborating == ["CALLS", "READS_FROM"] and not got["y"].weak and got["y"].corroborated and got["topic"].path == "x>y>z>topic"
    assert {r.id for r in I.traverse(edges, matches, 2, 0).collect()} == {"x", "own", "y", "z"}
    assert I.traverse(edges, matches.filter("false"), 2, 8).count() == 0


def test_cursor_of_no_row_starts_at_the_top(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, k int")
    order = [("k", False), ("id", True)]
    whole = [r.id for r in I.after_cursor(rows, order, rows.filter("id = 77"), 10).collect()]
    assert whole == [2, 5, 8, 1, 4, 7, 0, 3, 6, 9] and [r.id for r in I.after_cursor(rows, order, rows.filter("id = 4"), 3).collect()] == [7, 0, 3]


def test_effective_takes_the_later_of_equal_ranks(spark):
    rows = spark.createDataFrame([(1, 2, 10, "a"), (1, 1, 11, "b"), (1, 1, 12, "c"), (2, 3, 13, None)], "k int, level int, pos int, v string")
    assert {tuple(r) for r in R.effective(rows, "k", rows["level"], "pos", "v").collect()} == {(1, "c", 12, 3), (2, None, 13, 1)}


def test_snapshot_round_trip(spark, tmp_path):
    nodes, edges = lift.nodes(spark, DIR), lift.edges(spark, DIR, ("CONTAINS", "PUBLISHES"))
    write_graph(nodes, edges, f"file://{tmp_path}/graph")
    back, linked = read_graph(spark, f"file://{tmp_path}/graph")
    assert back.select(nodes.columns).exceptAll(nodes).isEmpty() and back.count() == nodes.count()
    assert linked.select(edges.columns).exceptAll(edges).isEmpty() and linked.count() == edges.count()
    assert read_graph(spark, f"file://{tmp_path}/graph", ("CONTAINS",))[1].count() == edges.filter("type = 'CONTAINS'").count()
