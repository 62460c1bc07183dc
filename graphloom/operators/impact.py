"""Impact analysis: the bounded walk from matched concepts, and how what it reaches is scored and classified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import small, staged
from graphloom.plans import vocabulary as V


def walk_steps(edges: DataFrame) -> DataFrame:
    """(a, b, hop, type, up): the steps that a walk may take. Upward-only edges are taken from target to source, all others
    both ways; ``up`` steps go toward dependents; ``hop`` orders the steps of a node, outgoing edges first."""
    known = edges.filter(F.col("type").isin(*V.OWNERSHIP, *V.PROPAGATING, *V.SUPPORTING))
    out = known.filter(~F.col("type").isin(*V.UPWARD_ONLY)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.concat(F.lit("0"), "id").alias("hop"), "type", F.lit(False).alias("up"))
    return out.unionByName(known.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.concat(F.lit("1"), "id").alias("hop"), "type", F.lit(True).alias("up")))


def traverse(edges: DataFrame, matches: DataFrame, max_depth: int = 2, max_chain: int = 8) -> DataFrame:
    """One row per node reached: id, distance, path, edge_types (in order), corroborating (sorted), admissible, weak,
    concept, mechanism, ambiguous, test_only, anchor_concepts, corroborated.

    ``matches`` has (concept, id, mechanism, ambiguous, test_only). From every match a breadth-first walk goes over
    ``walk_steps``; a hop over a chain edge has a budget of its own and starts the structural depth anew. A node is
    expanded once a match, with the state of the first route to arrive (in the order of the frontier and then of the edges); all
    arrivals count as routes. Of a node's routes the nearest win, then the stronger mechanism, then the smaller path.
    One join a level; nothing is collected.
    """
    steps = walk_steps(staged(edges))  # written once, taken both ways as it is read
    strength = F.expr(V.case("mechanism", V.MECHANISM_STRENGTH, "0"))
    held = ("concept", "mechanism", "ambiguous", "test_only", "anchor", "strength")
    empty = F.array().cast("array<string>")
    seeds = staged(matches.select(
        "concept", "mechanism", "ambiguous", "test_only", F.col("id").alias("anchor"), strength.alias("strength"), "id", F.lit(0).alias("distance"), F.col("id").alias("path"), empty.alias("edge_types"),
        F.lit(0).alias("depth"), F.lit(0).alias("chain"), F.lit(True).alias("admissible"), F.lit(False).alias("weak"), empty.alias("order"),
    ))
    routes, frontier, seen = seeds, seeds, seeds.select("concept", "anchor", "id")
    chained = F.col("type").isin(*V.CHAIN)
    for level in range(1, max_depth + max_chain + 1):
        first_owned = F.element_at("edge_types", 1).isin(*V.OWNERSHIP)
        near = small(frontier)
        arrived = steps.join(near, near["id"] == steps["a"]).select(
            *held, F.col("b").alias("id"), F.lit(level).alias("distance"), F.concat("path", F.lit(">"), "b").alias("path"), F.concat("edge_types", F.array("type")).alias("edge_types"),
            F.when(chained, 0).otherwise(F.col("depth") + 1).alias("depth"), (F.col("chain") + chained.cast("int")).alias("chain"),
            (F.col("admissible") & ((F.size("edge_types") == 0) | ~F.coalesce(first_owned, F.lit(False)) | F.col("up"))).alias("admissible"),
            ((F.col("distance") == 0) & ((F.col("type") == V.NEVER_STRONG) | F.col("up") & F.col("type").isin(*V.WEAK_REVERSED))).alias("weak"),
            F.concat("order", F.array("hop")).alias("order"),
        )
        arrived = staged(arrived.filter((F.col("depth") <= max_depth) & (F.col("chain") <= max_chain)))
        routes = routes.unionByName(arrived)
        rest = [c for c in arrived.columns if c not in ("concept", "anchor", "id", "order")]
        first = arrived.groupBy("concept", "anchor", "id").agg(F.min_by(F.struct(*rest, "order"), "order").alias("first"))
        frontier = staged(first.join(seen, ["concept", "anchor", "id"], "left_anti").select("concept", "anchor", "id", "first.*"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("concept", "anchor", "id"))
    return merged(routes, [])


def merged(routes: DataFrame, by: list[str]) -> DataFrame:
    """One row for each node (of each group of ``by``) that routes reach: see ``traverse``."""
    key, node = [*by, "id"], ["node"] if "node" in routes.columns else []
    elsewhere = (F.col("anchor") != F.col("id")) & F.exists("edge_types", lambda t: t.isin(*V.PROPAGATING))
    best = F.min_by(F.struct("path", "edge_types", "concept", "mechanism", "ambiguous", "test_only"), F.struct(-F.col("strength"), "path"))
    each = routes.groupBy(*key, "distance").agg(
        best.alias("w"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("edge_types")))).alias("corroborating"), F.bool_or("admissible").alias("admissible"), F.bool_and("weak").alias("weak"),
        F.collect_set("concept").alias("concepts"), F.count("*").alias("n"), F.bool_or(elsewhere).alias("elsewhere"), *(F.any_value(c).alias(c) for c in node),
    )
    near = F.min_by(F.struct("distance", "w", "corroborating", "admissible", "weak"), "distance").alias("near")
    won = each.groupBy(*key).agg(
        near, F.sort_array(F.array_distinct(F.flatten(F.collect_list("concepts")))).alias("anchor_concepts"), ((F.sum("n") > 1) & F.bool_or("elsewhere")).alias("corroborated"), *(F.any_value(c).alias(c) for c in node),
    )
    return won.select(*key, "near.distance", "near.w.*", "near.corroborating", "near.admissible", "near.weak", "anchor_concepts", "corroborated", *node)


def within_any(column: str, values) -> Column:
    return F.arrays_overlap(column, F.array(*(F.lit(v) for v in values)))


def confidence(co_change: Column | None = None) -> Column:
    """Whole percent from the signals of a candidate beside its node's type."""
    container = (F.col("distance") == 0) & F.col("mechanism").isin("exact", "alias") & F.col("type").isin(*V.CONTAINER_TYPES) & ~F.contains("concept", F.lit("/"))
    total = F.when(container, V.CONTAINER_NAME_SIGNAL).otherwise(F.expr(V.case("mechanism", V.MECHANISM_SIGNAL, "50")))
    total += F.when(F.col("ambiguous"), V.AMBIGUITY).otherwise(0) + F.when(F.col("test_only"), V.TEST_ONLY).otherwise(0) + F.col("distance") * V.HOP
    for kind, signal in V.EDGE_SIGNAL.items():  # corroborating holds a type once
        total += F.when(F.array_contains("corroborating", kind), signal).otherwise(0)
    if co_change is not None:
        total += F.when((F.col("distance") > 0) & (co_change >= 2), V.CO_CHANGE).otherwise(0)
    return F.greatest(F.lit(V.LEAST), F.least(F.lit(V.MOST), total)).cast("long")


def evidence_types() -> Column:
    """The bases of a candidate's evidence, beside its node's type: by mechanism at an anchor, else by edges and node."""
    anchor = F.expr(V.case("mechanism", V.MECHANISM_BASIS, "'lexical-only'"))
    some = lambda pairs: F.filter(F.array(*(F.when(c, name) for name, c in pairs)), lambda x: x.isNotNull())
    kinds = ("configuration-asset", "async-event", "external-contract")
    at_anchor = F.concat(F.array(F.lit("direct-structural")), some([(k, F.col("type").isin(*V.BASIS_NODES[k])) for k in kinds]))
    ruled = some([(k, within_any("edge_types", V.BASIS_EDGES[k]) | F.col("type").isin(*V.BASIS_NODES[k])) for k in V.BASIS_EDGES])
    on_route = F.when(F.size(ruled) > 0, ruled).otherwise(F.array(F.when(F.col("distance") == 1, "direct-structural").otherwise("transitive-structural")))
    return F.when(anchor != "direct-structural", F.array(anchor)).when(F.col("distance") == 0, at_anchor).otherwise(on_route)


def primary(types: str) -> Column:
    """The strongest of the evidence types."""
    ranked = F.transform(types, lambda t: F.struct(reduce(lambda out, kv: F.when(t == kv[0], kv[1]).otherwise(out), V.EVIDENCE_RANK.items(), F.lit(99)).alias("rank"), t.alias("name")))
    return F.coalesce(F.array_min(ranked)["name"], F.lit("lexical-only"))


def proposal(change: str | Column = "unknown", co_change: Column | None = None) -> Column:
    """The likelihood that a candidate's route proposes, before evidence caps it; ``change`` is the kind of change."""
    kind = F.lit(change) if isinstance(change, str) else change
    together = F.lit(False) if co_change is None else F.coalesce(co_change >= 2, F.lit(False))
    fan_out = F.col("type").isin(*V.CONTAINER_TYPES) & F.col("mechanism").isin(*V.GUESSED) & (F.size("corroborating") > 0) & F.forall("corroborating", lambda t: t.isin(*V.UPWARD_ONLY))
    named = F.col("mechanism").isin("exact", "alias") & F.col("type").isin(*V.CONTAINER_TYPES) & ~F.contains("concept", F.lit("/"))
    obliges = lambda kinds: F.when(kind.isin(*kinds), "likely").otherwise("possible")
    link = F.coalesce(F.element_at("edge_types", 1), F.lit(V.NEVER_STRONG))
    duty = F.when(link == V.NEVER_STRONG, "possible")
    for edge, kinds in V.OBLIGES.items():
        duty = duty.when(link == edge, obliges(kinds))
    at_anchor = F.when(named, "possible").when(F.col("mechanism").isin("semantic", "lexical"), "possible").otherwise("required")
    return (
        F.when(F.col("distance") == 0, at_anchor).when(fan_out, "unlikely").when((F.col("mechanism") == "path-segment") & ~together, "unlikely")
        .when(F.col("distance") > 1, "possible").when(~F.col("weak") | together, "likely").otherwise(duty.otherwise(obliges(V.REFERENCE_OBLIGES)))
    )


def confident(candidates: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Admissible candidates that are ``nodes`` (or have node, see ``requirements.routes_of``), with category, type and confidence."""
    named = candidates.filter("admissible")
    if "node" in candidates.columns:
        named = named.filter("node is not null").select("*", "node.category", "node.type").drop("node")
    else:
        named = named.join(nodes.select("id", "category", "type"), "id")
    return named.select("*", confidence().alias("confidence"))


def classified(candidates: DataFrame, nodes: DataFrame, change: str | Column = "unknown") -> DataFrame:
    """Admissible candidates (those of ``confident``, or made so) with category, type, directness, confidence, evidence_types, basis, proposed, likelihood (no
    stronger than the basis allows) and impact_type."""
    named = candidates if "confidence" in candidates.columns else confident(candidates, nodes)
    rows = named.select("*", F.sort_array(evidence_types()).alias("evidence_types"), proposal(change).alias("proposed"), F.when(F.col("distance") == 0, "direct").otherwise("indirect").alias("directness"))
    rows = rows.withColumn("basis", primary("evidence_types"))
    ceiling, rank = F.expr(V.case("basis", V.EVIDENCE)), lambda c: V.case(c, V.LIKELIHOOD_RANK)
    rows = rows.withColumn("ceiling", ceiling)
    likelihood = F.when(F.expr(f"{rank('proposed')} >= {rank('ceiling')}"), F.col("proposed")).otherwise(F.col("ceiling"))
    kind = F.coalesce(F.expr(V.case("type", V.IMPACT_BY_TYPE)), F.expr(V.case("category", V.IMPACT_BY_CATEGORY)), F.lit("domain-model"))
    return rows.withColumn("likelihood", likelihood).withColumn("impact_type", kind).drop("ceiling")


def with_role(impacts: DataFrame, named: Column) -> DataFrame:
    """Adds role and rule: what an impact is for a plan. ``named`` tells which the specification names itself."""
    strong = F.col("likelihood").isin("required", "likely")
    predictive = F.col("likelihood").isin("required", "likely", "possible")
    structural = F.col("basis").isin("direct-structural", "transitive-structural", *V.BASIS_EDGES)
    rule = (
        F.when(F.col("likelihood") == "excluded", "non-goal-excluded").when(named & strong, "named-by-specification")
        .when(~structural & (F.col("directness") == "direct") & strong, "resolved-by-resemblance").when(~structural, "resemblance-only").when(strong, "structural-obligation")
        .when(predictive & (F.col("basis").isin(*V.BASIS_EDGES) | F.col("impact_type").isin(*V.CONSEQUENCES)), "architectural-consequence").otherwise("reachable-only")
    )
    role = F.when(F.col("rule").isin("non-goal-excluded", "reachable-only"), "dependency-context").when(F.col("rule") == "resemblance-only", "investigation-lead").otherwise("planning-impact")
    return impacts.withColumn("rule", rule).withColumn("role", role)


#: Order of impacts by strength; node ids break ties.
def by_strength() -> list[Column]:
    roles = {"planning-impact": 0, "dependency-context": 1, "investigation-lead": 2}
    return [F.expr(V.case("role", roles)), F.expr(V.case("likelihood", V.LIKELIHOOD_RANK)), F.expr(V.case("basis", V.EVIDENCE_RANK)), F.desc("confidence"), F.col("id")]


def after_cursor(rows: DataFrame, order: list[tuple[str, bool]], cursor: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows after the cursor's row in the given order ((column, ascending), the last one unique); from the top
    if the cursor is no row. Keys are compared with the cursor's, so that no row before it is numbered or sorted."""
    names = [c for c, _ in order]
    at = cursor.select(*(F.col(c).alias(f"at_{c}") for c in names)).limit(1)
    later, same = F.lit(False), F.lit(True)
    for c, up in order:
        here, there = F.col(c), F.col(f"at_{c}")
        later = later | same & ((here > there) if up else (here < there))
        same = same & (here == there)
    kept = rows.join(F.broadcast(at), F.lit(True), "left").filter(F.col(f"at_{names[-1]}").isNull() | later).drop(*(f"at_{c}" for c in names))
    return kept.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order)).limit(size)


def change_shape(anchors: DataFrame, edges: DataFrame, roots: Column) -> DataFrame:
    """One row: shape, far_reaching, chained, containers, max_depth, max_chain, max_expansions for the nodes of ``anchors`` (id, type, path)."""
    ends = edges.filter(F.col("type").isin(*V.CHAIN))
    chained = ends.select(F.col("source_id").alias("id")).unionByName(ends.select(F.col("target_id").alias("id")))
    held = anchors.join(chained.join(anchors.select("id"), "id", "left_semi").distinct().withColumn("chained", F.lit(True)), "id", "left")
    flags = held.agg(F.count("*").alias("n"), F.count_if(F.col("type").isin(*V.FAR_REACHING)).alias("far_reaching"), F.count_if("chained").alias("chained"), F.count_distinct(F.coalesce(roots, F.lit("(unattributed)"))).alias("containers"))
    shape = F.when((F.col("n") == 0) | (F.col("far_reaching") > 0) | (F.col("chained") > 0) | (F.col("containers") > 1), "distributed").otherwise("contained")
    rows = flags.withColumn("shape", shape)
    return rows.select("shape", "far_reaching", "chained", "containers", *(F.expr(V.case("shape", {k: v[i] for k, v in V.BUDGETS.items()})).alias(name) for i, name in enumerate(("max_depth", "max_chain", "max_expansions"))))
