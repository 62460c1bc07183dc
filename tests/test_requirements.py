"""The requirement-keyed walk against a walk that is done step by step."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import impact as I
from graphloom.operators import requirements as R
from graphloom.plans import vocabulary as V

KINDS = ("CONTAINS", "IMPORTS", "CALLS", "PUBLISHES", "FLOWS_TO", "USES_UNKNOWN", "DEPENDS_ON")


def sequential(edges, seeds):
    """Routes (seed, node, distance, path) and the flag, one expansion after the other."""
    out, tried, cut = [], 0, False
    steps = {}
    for id_, kind, a, b in edges:
        if kind not in V.UPWARD_ONLY:
            steps.setdefault(a, []).append(("0" + id_, b, kind))
        steps.setdefault(b, []).append(("1" + id_, a, kind))
    for moves in steps.values():
        moves.sort()
    for rank, node, depth_most, chain_most, most in seeds:
        out.append((rank, node, 0, node))
        done, frontier = {node}, [(node, node, 0, 0, 0)]
        for _ in range(depth_most + chain_most):
            after = []
            for at, path, depth, chain, distance in frontier:
                for _, other, kind in steps.get(at, ()):
                    tried += 1
                    if tried > most:
                        cut = True
                        break
                    hop = kind in V.CHAIN
                    d, c = (0 if hop else depth + 1), chain + hop
                    if d > depth_most or c > chain_most:
                        continue
                    out.append((rank, other, distance + 1, f"{path}>{other}"))
                    if other not in done:
                        done.add(other)
                        after.append((other, f"{path}>{other}", d, c, distance + 1))
                if cut:
                    break
            if cut or not after:
                break
            frontier = after
        if cut:  # later seeds try one step each in vain
            tried = most + 1
    return sorted(out), min(tried, most), cut


@pytest.mark.parametrize("seed", range(3))
def test_guarded_walk_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"e{i:03}", rng.choice(KINDS), f"n{rng.randint(0, 5)}", f"n{rng.randint(6, 24)}") for i in range(70)})
    wanted, rows = {}, []
    for k in range(8):
        limits = (rng.randint(1, 2), rng.randint(0, 8), rng.choice([3, 10, 25, 60, 5000]))
        mine = [(rank, f"n{rng.randint(0, 30)}", *limits) for rank in range(1, rng.randint(2, 4))]
        wanted[f"r{k}"] = sequential(edges, mine)
        rows += [(f"r{k}", rank, f"c{rank}", "exact", False, False, node, *limits) for rank, node, *_ in mine]
    schema = "requirement string, rank int, concept string, mechanism string, ambiguous boolean, test_only boolean, id string, max_depth int, max_chain int, max_expansions int"
    routes, spent = R.guarded_walk(spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"), spark.createDataFrame(rows, schema))
    found = {}
    for r in routes.collect():
        found.setdefault(r["requirement"], []).append((r["rank"], r["id"], r["distance"], r["path"]))
    told = {r["requirement"]: (r["expansions"], r["exhausted"]) for r in spent.collect()}
    for name, (all_routes, tried, cut) in wanted.items():
        assert sorted(found[name]) == all_routes
        assert told[name] == (tried, cut)


def test_steps_of_a_hub_are_numbered_across_parts(spark):
    edges = [(f"e{i:04}", "CALLS", "hub", f"n{i}") for i in range(500)] + [("x", "CALLS", "n1", "n2")]
    frame = spark.createDataFrame(edges, "id string, type string, source_id string, target_id string")
    steps, degree = R.numbered_steps(frame, 400)
    hub = [(r["place"], r["b"]) for r in steps.filter("a = 'hub'").orderBy("place").collect()]
    assert hub == [(i + 1, f"n{i}") for i in range(400)]
    assert degree.filter("a = 'hub'").first()["degree"] == 500
    assert I.walk_steps(frame).count() == 1002


def test_shapes_without_anchor_and_across_containers(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "requirement string")
    anchors = spark.createDataFrame([("a", "x", "class", "one/x"), ("a", "y", "class", "one/y"), ("b", "x", "class", "one/x"), ("b", "z", "class", "two/z"), ("c", "q", "class", "one/q")], "requirement string, id string, type string, path string")
    edges = spark.createDataFrame([("e", "PUBLISHES", "q", "t")], "id string, type string, source_id string, target_id string")
    rows = {r["requirement"]: (r["shape"], r["max_chain"], r["max_expansions"]) for r in R.change_shapes(asked, anchors, edges).collect()}
    assert rows == {"a": ("contained", 1, 2000), "b": ("distributed", 8, 20000), "c": ("distributed", 8, 20000), "d": ("distributed", 8, 20000)}


def test_predicted_changes(spark):
    cases = {
        "must remove the deprecated `count` method": ("remove-api", "breaking", "remove"),
        "The constructor must accept a clock": ("change-construction", "potentially-breaking", "constructor"),
        "read the connection settings": ("change-configuration", "potentially-breaking", "connection settings"),
        "must take an extra optional argument": ("change-api", "potentially-breaking", "take an extra optional argument"),
        "must change the response shape": ("change-data-shape", "potentially-breaking", "response shape"),
        "exposes a count": ("add-api", "additive", "exposes"),
        "must validate input": ("change-behavior", "unknown", "validate"),
        "must be pleasant": ("unknown", "unknown", V.NO_CUE),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in frame.select("s", *R.predicted_change("s")).collect():
        assert (r["change"], r["compatibility"], r["cue"]) == cases[r["s"]]
    assert frame.filter(F.col("s").isNull()).count() == 0


def test_a_later_seed_takes_no_steps_that_earlier_ones_have_used_up(spark, monkeypatch):
    edges = [(f"e{i:03}", "CALLS", "hub", f"n{i}") for i in range(60)] + [(f"f{i:03}", "CALLS", "other", f"n{i}") for i in range(60)]
    schema = "requirement string, rank int, concept string, mechanism string, ambiguous boolean, test_only boolean, id string, max_depth int, max_chain int, max_expansions int"
    rows = [("r", 1, "hub", "exact", False, False, "hub", 2, 0, 70), ("r", 2, "other", "exact", False, False, "other", 2, 0, 70)]
    written, staged = [], R.staged
    monkeypatch.setattr(R, "staged", lambda df: written.append(staged(df)) or written[-1])
    nodes = spark.createDataFrame([("n1", "data", "table")], "id string, category string, type string")
    routes, spent = R.packed_walk(spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"), spark.createDataFrame(rows, schema), nodes=nodes)
    assert routes.filter("rank = 1").count() == 71 and routes.filter("rank = 2").count() == 1
    assert [tuple(r) for r in routes.filter("node is not null").select("id", "node.type").distinct().collect()] == [("n1", "table")]
    assert spent.first()["exhausted"] and spent.first()["expansions"] == 70
    taken = [df.filter("rank = 2").selectExpr("sum(size(steps)) as n").first()["n"] for df in written if {"rank", "steps", "level"} <= set(df.columns)]
    assert sum(n or 0 for n in taken) <= 10


def test_packed_walk_is_the_guarded_one(spark):
    rng = random.Random(7)
    edges = sorted({(f"e{i:03}", rng.choice(KINDS), f"n{rng.randint(0, 5)}", f"n{rng.randint(6, 24)}") for i in range(70)})
    limits = lambda: (rng.randint(1, 2), rng.randint(0, 3), rng.choice([3, 25, 60, 5000]))
    rows = [(f"r{k}", rank, f"c{rank}", "exact", False, False, f"n{rng.randint(0, 30)}", *own) for k in range(8) for own in [limits()] for rank in (1, 2)]
    schema = "requirement string, rank int, concept string, mechanism string, ambiguous boolean, test_only boolean, id string, max_depth int, max_chain int, max_expansions int"
    given = spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"), spark.createDataFrame(rows, schema)
    (one, told), (other, said) = R.guarded_walk(*given), R.packed_walk(*given)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))
    assert sorted(told.collect()) == sorted(said.collect())


@pytest.mark.parametrize("sign", ["", ">"])
def test_strongest_are_those_of_merged_routes(spark, monkeypatch, sign):
    """Two seeds of unlike strength, names that are no nodes, parallel routes; with ``sign`` ids have the sign that parts paths."""
    rng = random.Random(3)
    name = lambda i: f"n{i}{sign}x"
    edges = sorted({(f"e{i:03}", rng.choice(KINDS), name(rng.randint(0, 9)), name(rng.randint(6, 40))) for i in range(160)})
    rows = [(f"r{k}", rank, f"c{rank}", how, rank == 2, False, name(rng.randint(0, 14)), 2, 2, rng.choice([60, 5000])) for k in range(4) for rank, how in ((1, "name-similarity"), (2, "exact"))]
    schema = "requirement string, rank int, concept string, mechanism string, ambiguous boolean, test_only boolean, id string, max_depth int, max_chain int, max_expansions int"
    nodes = spark.createDataFrame([(name(i), "application", rng.choice(("service", "package"))) for i in range(38)], "id string, category string, type string")
    w = R.walk(spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"), spark.createDataFrame(rows, schema), nodes=nodes)
    whole = [r.asDict() for r in I.confident(I.merged(R.routes_of(w, True), ["requirement"]), nodes).collect()]
    if not sign:
        monkeypatch.setattr(I, "merged", None)  # routes aren't merged as rows with their paths
    most, found = 3, {}
    for r in R.strongest(w, most).collect():
        found.setdefault(r["requirement"], {})[r["id"]] = r.asDict()
    for k in {r["requirement"] for r in whole}:
        mine = [r for r in whole if r["requirement"] == k]
        reached = sorted((-r["confidence"] for r in mine if r["distance"] > 0))
        wanted = {r["id"] for r in mine if r["distance"] == 0 or sum(-c > r["confidence"] for c in reached) + sum(x["distance"] == 0 for x in mine) <= most}
        assert {r["id"] for r in mine if r["distance"] == 0} <= set(found[k]) <= wanted
        ranked = sorted(mine, key=lambda r: (r["distance"] > 0, -r["confidence"], r["id"]))
        for r in ranked:
            if r["id"] in found[k]:
                got = found[k][r["id"]]
                assert all(got[c] == r[c] for c in ("distance", "path", "concept", "mechanism", "corroborating", "weak", "confidence", "type"))
                assert got["over"] == len(mine) - most and got["farthest"] == max((x["confidence"] for x in mine if x["distance"] > 0), default=None)
        alike = lambda r: tuple(map(str, (r["distance"], r["confidence"], r["corroborating"], r["weak"], r["edge_types"], r["mechanism"], r["type"])))
        for r in mine:  # what is left out has enough before it that are like it but for the id
            if r["id"] in wanted - set(found[k]):
                assert sum(alike(x) == alike(r) and x["id"] < r["id"] for x in mine) > most
