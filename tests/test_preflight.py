"""Analyzers of a plan: what each says, and what is said where an input is absent."""

import pytest

from graphloom.operators import preflight as P

TEXTS = {
    "r1": "It uses ItemType.ANGEBOT in the list.", "r2": "Add ItemType.NEW to the enum.", "r3": "It reads Repo.list_rows and Repo.gone here.", "r4": "It uses Loose.anything.", "r5": "See models.py and Node.js for item.id and item.nope.",
    "r6": "It uses Empty.thing.", "r7": "It uses Nowhere.x and uses ItemType.DONE.", "r8": "Uses a. Adds ItemType.LATER when it reads.",
}
NODES = [
    ("enum", "enum", "ItemType"), ("enum.done", "enum-member", "DONE"), ("repo", "class", "Repo"), ("mixin", "class", "Mixin"), ("mixin.rows", "method", "list_rows"), ("loose", "class", "Loose"), ("loose.m", "method", "m"),
    ("ext", P.K.OPEN, "Base"), ("item", "class", "Item"), ("item.id", "field", "id"), ("empty", "class", "Empty"),
]
EDGES = [("DECLARES_MEMBER", "enum", "enum.done"), ("EXTENDS", "repo", "mixin"), ("DECLARES_MEMBER", "mixin", "mixin.rows"), ("DECLARES_MEMBER", "loose", "loose.m"), ("EXTENDS", "loose", "ext"), ("EXTENDS", "enum", "ext"), ("DECLARES_MEMBER", "item", "item.id")]


@pytest.fixture(scope="module")
def inputs(spark):
    return {
        "requirements": spark.createDataFrame(list(TEXTS.items()), "requirement string, statement string"),
        "nodes": spark.createDataFrame(NODES, "id string, type string, name string"),
        "edges": spark.createDataFrame([(f"e{i}", *e) for i, e in enumerate(EDGES)], "id string, type string, source_id string, target_id string"),
    }


def test_members_taken_for_granted(inputs):
    rows = P.check_assumptions(inputs["requirements"], inputs["nodes"], inputs["edges"]).collect()
    assert {(r["requirement"], r["subject"], r["severity"], r["confidence"]) for r in rows} == {
        ("r1", "ItemType.ANGEBOT", "blocking", 90), ("r3", "Repo.gone", "blocking", 90), ("r4", "Loose.anything", "warning", 60), ("r5", "item.nope", "blocking", 90),
    }


def test_absent_inputs_are_told(spark, inputs):
    rows = P.preflight({k: v for k, v in inputs.items() if k != "edges"}, spark).collect()
    assert {(r["analyzer"], r["kind"], r["subject"]) for r in rows} == {
        ("check-constraints", "not-run", "concepts, constraints"), ("check-guidance", "not-run", "concepts, constraints"), ("check-assumptions", "not-run", "edges"),
        ("check-runtime", "not-run", "topology, links, starts, processes, needs, plan"), ("check-config-semantics", "not-run", "declarations"),
    }
    verdicts = {r["verdict"] for r in P.verdicts(inputs["requirements"], P.preflight({}, spark)).collect()}
    assert verdicts == {"READY"}


def test_verdicts_and_order(spark, inputs):
    found = P.preflight(inputs, spark)
    got = {r["requirement"]: (r["verdict"], r["findings"]) for r in P.verdicts(inputs["requirements"], found).collect()}
    assert got["r1"] == ("BLOCKED", 1) and got["r4"] == ("NEEDS_VERIFICATION", 1) and got["r2"] == ("READY", 0)
    first = found.orderBy(*P.by_importance(found)).collect()
    assert [r["severity"] for r in first] == sorted((r["severity"] for r in first), key=["blocking", "warning", "informational"].index)
    assert {r["analyzer"]: r["subject"] for r in P.first_findings(found, 1).collect()}["check-assumptions"] == "ItemType.ANGEBOT"


def test_ends_of_proposed_relationships(spark):
    asked = spark.createDataFrame([
        ("a", "The web app calls the billing api over HTTP."), ("b", "From the user-profile service, newsletter reads rows by HTTP."), ("c", "The user-profile service and user-profile talk."), ("d", "alpha imports beta and gamma."), ("e", "only one imports"),
    ], "requirement string, statement string")
    concepts = spark.createDataFrame([
        ("a", 0, "billing", "n1", "services/billing/x.ts"), ("a", 1, "web app", "n2", "apps/web/y.ts"), ("b", 0, "user-profile service", "n3", "services/user/z.ts"), ("b", 1, "newsletter", None, None), ("b", 2, "user-profile", "n9", "services/user"),
        ("c", 0, "user-profile", "n3", "p"), ("c", 1, "user-profile service", "n3", "p"), ("d", 0, "alpha", "n4", "libs/one/a"), ("d", 1, "beta", "n5", "libs/one/b"), ("d", 2, "gamma", "n6", "libs/two/c"), ("e", 0, "only one", "n7", "x"),
    ], "requirement string, place int, ref string, id string, path string")
    got = {(r["requirement"], r["mechanism"], r["source_ref"], r["target_ref"], r["confidence"]) for r in P.proposed_edges(asked, concepts).collect()}
    assert got == {("a", "http", "web app", "billing", 85), ("b", "http", "newsletter", "user-profile service", 60), ("d", "import", "alpha", "gamma", 85)}


def test_defaults_that_say_nothing(spark):
    cases = [("a", '"{}"', False, "empty-but-truthy-default"), ("b", "[]", False, "empty-but-truthy-default"), ("c", "''", True, "empty-but-truthy-default"), ("d", "None", True, "fail-open-default"), ("e", "None", False, None), ("f", None, True, "fail-open-default"), ("g", None, None, None), ("h", '"x"', True, None), ("i", "0", True, "fail-open-default")]
    frame = spark.createDataFrame([(n, "p", d, t) for n, d, t, _ in cases], "name string, path string, default string, tolerant boolean")
    assert {r["subject"]: r["detail"] for r in P.check_config_semantics(frame).collect()} == {f"p:{n}": m for n, _, _, m in cases if m}
