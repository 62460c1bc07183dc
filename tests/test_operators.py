"""Graph operators on literal rows that the given tables don't have."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import enrich as E
from graphloom.operators import matching as M
from graphloom.operators import review as R
from graphloom.operators import store as T
from graphloom.operators import texts as X
from graphloom.operators import walks as K


def test_rerank_roles_and_diversity(spark):
    rows = [(f"f{i}", "n", "data", "field", "src/a.ts", "conceptual", 0.5 + i / 100) for i in range(4)] + [("t", "n", "application", "test", "tests/a.test.ts", "exact", 1.0), ("x", "n", "governance", "ci-check", "ci/a.yml", "lexical", 0.3)]
    hits = spark.createDataFrame(rows, "id string, name string, category string, type string, path string, match_kind string, score double")
    got = {r.id: (r.role, r.score, r.overflow) for r in M.reranked(hits, "validation").collect()}
    assert got["t"] == ("test", 1.0, False) and got["x"] == ("guard", 0.48, False)
    assert [got[f"f{i}"][2] for i in range(4)] == [True, True, False, False]


def test_runtime_chains_end_in_every_way(spark):
    types = [("u", "service-url"), ("a", "container"), ("b", "container"), ("h", "handler"), ("n", "table"), ("v", "service-url"), ("w", "service-url"), ("z", "service-url")]
    links = [("u", "a"), ("a", "b"), ("b", "a"), ("v", "h"), ("w", "n"), ("z", "h"), ("z", "a")]
    nodes = spark.createDataFrame(types, "id string, type string")
    edges = spark.createDataFrame([("ROUTES_TO", a, b) for a, b in links], "type string, source_id string, target_id string")
    got = {r.start: (r.hops, r.reason) for r in K.runtime_paths(nodes, edges, nodes.filter("type = 'service-url'")).collect()}
    assert got == {"u": ("u>a>b", "cycle"), "v": ("v>h", None)}


def test_members_behind_an_open_boundary(spark):
    nodes = spark.createDataFrame([("c", "class", "C"), ("p", "class", "P"), ("o", K.OPEN, "O"), ("m", "field", "P.size?")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "EXTENDS", "c", "p"), ("2", "EXTENDS", "p", "o"), ("3", "DECLARES_MEMBER", "p", "m")], "id string, type string, source_id string, target_id string")
    wanted = spark.createDataFrame([("c", "size"), ("c", "none")], "id string, member string")
    got = {r.member: (r.outcome, r.provider, r.inherited, r.open, r.supertypes) for r in K.resolve_members(nodes, edges, wanted).collect()}
    assert got == {"size": ("found", "p", True, None, None), "none": ("not-found", None, None, True, 1)}


def test_exports_of_a_cycle(spark):
    rows = [("a", "x", None, "b", "x", 1), ("b", "x", None, "a", "x", 1), ("b", "x", None, "c", "y", 2), ("c", "y", "sym", None, None, 0)]
    exports = spark.createDataFrame(rows, "file string, name string, symbol string, from_file string, from_name string, position int")
    wanted = spark.createDataFrame([("a", "x"), ("a", "q")], "file string, name string")
    assert {(r.name, r.target) for r in E.exported_names(exports, wanted).collect()} == {("x", "sym"), ("q", None)}


def test_architectural_stems_and_globs(spark):
    names = spark.createDataFrame([("OrderService",), ("OrderLine",), ("LineOrder",)], "name string")
    concepts = spark.createDataFrame([("order",), ("order line item",), ("ORDERLINE",)], "concept string")
    assert {tuple(r) for r in M.similar_names(concepts, names).collect()} == {("order", "OrderService"), ("order line item", "OrderLine")}
    assert M.glob_pattern("src/**/*.t?") == r"^src/(?:.*/)?[^/]*\.t[^/]$"


@pytest.mark.parametrize(("text", "wanted"), [("abc", "r-1a47e90b"), ("  A  bC ", None)])
def test_content_ids(spark, text, wanted):
    got = spark.createDataFrame([(text,)], "t string").select(S.content_id("r", F.col("t"))).first()[0]

    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        return f"r-{h:08x}"

    assert got == (wanted or fnv("a bc"))


def test_snapshots_follow_the_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    T.put_snapshot({"nodes": df}, "s1", "2024-01-01", root)
    T.put_snapshot({"nodes": df.withColumn("v", F.lit(2))}, "s2", "2024-01-02", root)
    assert T.current_snapshot(spark, root) == "s2" and [r.id for r in T.snapshots(spark, root).collect()] == ["s2", "s1"]
    assert T.of_snapshot(spark, root, "nodes", "s1").first().v == 1


def test_divergence_and_empty_counts(spark):
    a = spark.createDataFrame([("1", "application"), ("2", "application")], "id string, category string")
    assert tuple(R.divergence(a, a).first()) == (0, None) and tuple(R.divergence(a, a.filter("id = '1'")).first()) == (1, "minor") and R.divergence(a, a.filter("false")).first().severity == "important"


def test_statement_helpers(spark):
    row = spark.createDataFrame([("/a/:id/{x}/7/",)], "p string").select(X.route(F.col("p")).alias("r"), X.escaped_xml(F.lit("<a & 'b'>")).alias("x"), X.clipped(F.lit("abcdef"), 4).alias("c"), X.plural(F.lit(1), "node", "nodes").alias("n")).first()
    assert tuple(row) == ("/a/{}/{}/{}", "&lt;a &amp; &#39;b&#39;&gt;", "abc…", "1 node")


def test_a_repeated_anchor_gives_no_repeated_rows(spark):
    edges = spark.createDataFrame([("e", "CALLS", "a", "b")], "id string, type string, source_id string, target_id string")
    got = K.shortest_paths(edges, spark.createDataFrame([("a",), ("a",)], "id string"), 2).collect()
    assert sorted((r["id"], r["path"]) for r in got) == [("a", "a"), ("b", "a>b")]


def test_distances_write_each_edge_once(spark, monkeypatch):
    """Neither both directions of the edges nor their distinct pairs are written or shuffled as a whole before the walk."""
    from graphloom.operators import graph as G

    written, staged = [], G.staged
    monkeypatch.setattr(G, "staged", lambda df: written.append((df.count(), "Exchange" in df._jdf.queryExecution().executedPlan().toString())) or staged(df))
    edges = spark.createDataFrame([("CONTAINS", "a", "b"), ("CALLS", "a", "b"), ("CALLS", "b", "a"), ("CALLS", "b", "c"), ("CALLS", "d", "c")], "type string, source_id string, target_id string")
    got = G.distances(edges, spark.createDataFrame([("a",)], "id string"), 5)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)] and written[0] == (5, False)
