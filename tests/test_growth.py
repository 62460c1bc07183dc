"""Steps whose cost follows the input: what they must not do again, and the same results at their edges."""

import pytest

from graphloom.operators import matching as M
from graphloom.operators import walks as K


@pytest.mark.parametrize("place, met", [(24, True), (25, False)])
def test_neighbours_are_counted_not_ranked(spark, place, met):
    """A hub with 30 neighbours, of which only the one in ``place`` is met; outgoing edges first."""
    nodes = [("hub", "c", "service", "hub", "p")] + [(f"n{i:02d}", "c", "service", "blue bolts" if i == place else "grey", "q") for i in range(1, 31)] + [("leaf", "c", "service", None, None)]
    edges = [(f"e{i:02d}", "hub", f"n{i:02d}") if i <= 20 else (f"e{i:02d}", f"n{i:02d}", "hub") for i in range(1, 31)] + [("a", "leaf", f"n{place:02d}"), ("b", "leaf", "gone")]
    out = M.search(spark.createDataFrame(nodes, "id string, category string, type string, name string, path string"), spark.createDataFrame(edges, "id string, source_id string, target_id string"), "blue bolts", ["blue", "bolts"])
    got = {r["id"]: r["match_kind"] for r in out.collect()}
    assert got == {f"n{place:02d}": "exact", "leaf": "related"} | ({"hub": "related"} if met else {})
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_members_look_types_up_once(spark, monkeypatch):
    """Dotted names, optional members and open boundaries."""
    kinds = [("a", "class", "A"), ("b", "class", "B"), ("c", "class", "C"), ("x", K.OPEN, "X"), ("c.m", "field", "C.m?"), ("c.n", "field", "other.m"), ("b.p", "field", "p.q"), ("nameless", "field", None)]
    nodes = spark.createDataFrame(kinds, "id string, type string, name string")
    links = [("EXTENDS", "a", "b"), ("EXTENDS", "b", "c"), ("IMPLEMENTS", "b", "x"), ("DECLARES_MEMBER", "c", "c.m"), ("DECLARES_MEMBER", "c", "c.n"), ("DECLARES_MEMBER", "b", "b.p"), ("DECLARES_MEMBER", "b", "nameless")]
    edges = spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b) for t, a, b in links], "id string, type string, source_id string, target_id string")
    wanted = spark.createDataFrame([("a", "m"), ("a", "p.q"), ("a", "q"), ("c", "m"), ("c", "other.m")], "id string, member string")
    written, staged = [], K.staged
    monkeypatch.setattr(K, "staged", lambda df: written.append(df.columns) or staged(df))
    got = {(r["id"], r["member"]): (r["provider"], r["open"], r["supertypes"]) for r in K.resolve_members(nodes, edges, wanted).collect()}
    assert got == {("a", "m"): ("c", None, None), ("a", "p.q"): ("b", None, None), ("a", "q"): (None, True, 2), ("c", "m"): ("c", None, None), ("c", "other.m"): ("c", None, None)}
    assert ["provider", "next", "hop", "next_closed"] in written


def test_nodes_where_chains_meet_are_broadcast(spark, monkeypatch):
    """Many starts, one resource: from the second step on, no side of a join is shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(f"u{i}", "service-url") for i in range(40)] + [("r", "cloud-run-service"), ("p", "runtime-process"), ("h", "handler")], "id string, type string")
        edges = spark.createDataFrame([("ROUTES_TO", f"u{i}", "r") for i in range(39)] + [("ROUTES_TO", "u39", "nowhere"), ("RESOLVES_TO", "r", "p"), ("RUNS_IN", "p", "h")], "type string, source_id string, target_id string")
        plans, staged = [], K.staged
        monkeypatch.setattr(K, "staged", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or staged(df))
        got = {r["start"]: (r["hops"], r["reason"]) for r in K.runtime_paths(nodes, edges, nodes.filter("type = 'service-url'")).collect()}
        assert got == {f"u{i}": (f"u{i}>r>p>h", None) for i in range(39)}
        steps = [p for c, p in plans if "ended" in c]
        assert len(steps) == 4 and not any("SortMergeJoin" in p for p in steps[1:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
