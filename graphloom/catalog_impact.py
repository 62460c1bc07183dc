"""Registered impact queries and their DuckDB counterparts: the walk, scores, roles, pages and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.operators import impact as I
from graphloom.operators.graph import staged
from graphloom.plans import vocabulary as V
from graphloom.plans.lift import edges, nodes

#: Matched concepts by node: (concept, mechanism).
MATCHED = {"supplier:1": ("Supplier#000000001", "exact"), "nation:1": ("second nation", "alias"), "customer:3": ("customer three", "name-similarity")}
DEPTH, CHAIN_HOPS = 2, 1


def _matches(spark, d):
    rows = nodes(spark, d).filter(F.col("id").isin(*MATCHED))
    concept, mechanism = (F.expr(V.case("id", {k: v[i] for k, v in MATCHED.items()})) for i in (0, 1))
    return rows.select(concept.alias("concept"), "id", mechanism.alias("mechanism"), F.lit(False).alias("ambiguous"), F.lit(False).alias("test_only"))


def _walk_sql() -> str:
    """The walk with one table a level."""
    concept, mechanism = (V.case("id", {k: v[i] for k, v in MATCHED.items()}) for i in (0, 1))
    out = f"""+ steps AS MATERIALIZED (
  SELECT source_id AS a, target_id AS b, '0' || id AS hop, type, false AS up FROM edges WHERE type NOT IN ({V.listed(V.UPWARD_ONLY)})
  UNION ALL SELECT target_id, source_id, '1' || id, type, true FROM edges),
f0 AS MATERIALIZED (SELECT {concept} AS concept, {mechanism} AS mechanism, id AS anchor, id, 0 AS distance, id AS path, []::VARCHAR[] AS edge_types, 0 AS depth, 0 AS chain, true AS admissible, false AS weak, []::VARCHAR[] AS ord
  FROM nodes WHERE id IN ({V.listed(MATCHED)})),
s0 AS MATERIALIZED (SELECT anchor, id FROM f0)"""
    for n in range(1, DEPTH + CHAIN_HOPS + 1):
        chain = f"type IN ({V.listed(V.CHAIN)})"
        out += f""",
c{n} AS MATERIALIZED (SELECT * FROM (SELECT concept, mechanism, anchor, b AS id, {n} AS distance, path || '>' || b AS path, list_append(edge_types, type) AS edge_types,
  CASE WHEN {chain} THEN 0 ELSE depth + 1 END AS depth, chain + ({chain})::INT AS chain, admissible AND (len(edge_types) = 0 OR edge_types[1] NOT IN ({V.listed(V.OWNERSHIP)}) OR up) AS admissible,
  distance = 0 AND (type = '{V.NEVER_STRONG}' OR up AND type IN ({V.listed(V.WEAK_REVERSED)})) AS weak, list_append(ord, hop) AS ord FROM f{n - 1} JOIN steps ON a = id) WHERE depth <= {DEPTH} AND chain <= {CHAIN_HOPS}),
f{n} AS MATERIALIZED (SELECT * FROM c{n} WHERE (anchor, id) NOT IN (SELECT (anchor, id) FROM s{n - 1}) QUALIFY row_number() OVER (PARTITION BY anchor, id ORDER BY ord) = 1),
s{n} AS MATERIALIZED (SELECT anchor, id FROM s{n - 1} UNION ALL SELECT anchor, id FROM f{n})"""
    routes = " UNION ALL ".join(f"SELECT * FROM {x}" for x in ("f0", *(f"c{n}" for n in range(1, DEPTH + CHAIN_HOPS + 1))))
    return out + f", routes AS MATERIALIZED ({routes})"


def scored_sql(by: str = "", change: str = "'unknown'") -> str:
    """From ``routes`` to ``impacts`` with roles; ``by`` names, with commas behind, what else a route belongs to."""
    bases = lambda test: "list_filter([" + ", ".join(test) + "], lambda x: x IS NOT NULL)"
    node_test = lambda k: f"type IN ({V.listed(V.BASIS_NODES[k])})"
    ruled = bases([f"CASE WHEN list_has_any(edge_types, [{V.listed(V.BASIS_EDGES[k])}]) OR {node_test(k)} THEN '{k}' END" for k in V.BASIS_EDGES])
    at_anchor = "list_concat(['direct-structural'], " + bases([f"CASE WHEN {node_test(k)} THEN '{k}' END" for k in ("configuration-asset", "async-event", "external-contract")]) + ")"
    signal = " + ".join(f"CASE WHEN list_contains(corroborating, '{k}') THEN {v} ELSE 0 END" for k, v in V.EDGE_SIGNAL.items())
    container = f"mechanism IN ('exact', 'alias') AND type IN ({V.listed(V.CONTAINER_TYPES)}) AND NOT contains(concept, '/')"
    obliges = lambda kinds: f"CASE WHEN {change} IN ({V.listed(kinds)}) THEN 'likely' ELSE 'possible' END"
    duty = f"CASE edge_types[1] WHEN '{V.NEVER_STRONG}' THEN 'possible' " + " ".join(f"WHEN '{k}' THEN {obliges(v)}" for k, v in V.OBLIGES.items()) + f" ELSE {obliges(V.REFERENCE_OBLIGES)} END"
    rank = lambda c: V.case(c, V.LIKELIHOOD_RANK)
    strong, predictive = "likelihood IN ('required', 'likely')", "likelihood IN ('required', 'likely', 'possible')"
    structural = f"basis IN ('direct-structural', 'transitive-structural', {V.listed(V.BASIS_EDGES)})"
    return f""",
near AS (SELECT {by}id, min(distance) AS distance, list_sort(list_distinct(list(concept))) AS anchor_concepts, count(*) > 1 AND bool_or(anchor <> id AND list_has_any(edge_types, [{V.listed(V.PROPAGATING)}])) AS corroborated FROM routes GROUP BY {by}id),
won AS MATERIALIZED (SELECT {by}id, distance, arg_min({{'path': path, 'edge_types': edge_types, 'concept': concept, 'mechanism': mechanism}}, {{'s': -{V.case("mechanism", V.MECHANISM_STRENGTH, "0")}, 'p': path}}) AS w,
  list_sort(list_distinct(flatten(list(edge_types)))) AS corroborating, bool_or(admissible) AS admissible, bool_and(weak) AS weak, any_value(anchor_concepts) AS anchor_concepts, any_value(corroborated) AS corroborated
  FROM routes JOIN near USING ({by}id, distance) GROUP BY {by}id, distance),
cand AS (SELECT {by}id, distance, w.path AS path, w.edge_types AS edge_types, w.concept AS concept, w.mechanism AS mechanism, corroborating, admissible, weak, anchor_concepts, corroborated FROM won),
named AS (SELECT c.*, n.category, n.type, {V.case("mechanism", V.MECHANISM_BASIS, "'lexical-only'")} AS from_match FROM cand c JOIN nodes n USING (id) WHERE admissible),
scored AS (SELECT *, greatest({V.LEAST}, least({V.MOST}, CASE WHEN distance = 0 AND {container} THEN {V.CONTAINER_NAME_SIGNAL} ELSE {V.case("mechanism", V.MECHANISM_SIGNAL, "50")} END + {V.HOP} * distance + {signal}))::BIGINT AS confidence,
  list_sort(CASE WHEN from_match <> 'direct-structural' THEN [from_match] WHEN distance = 0 THEN {at_anchor} WHEN len({ruled}) > 0 THEN {ruled} WHEN distance = 1 THEN ['direct-structural'] ELSE ['transitive-structural'] END) AS evidence_types,
  CASE WHEN distance = 0 AND {container} THEN 'possible' WHEN distance = 0 AND mechanism IN ('semantic', 'lexical') THEN 'possible' WHEN distance = 0 THEN 'required'
    WHEN type IN ({V.listed(V.CONTAINER_TYPES)}) AND mechanism IN ({V.listed(V.GUESSED)}) AND len(corroborating) > 0 AND len(list_filter(corroborating, lambda x: x NOT IN ({V.listed(V.UPWARD_ONLY)}))) = 0 THEN 'unlikely'
    WHEN mechanism = 'path-segment' THEN 'unlikely' WHEN distance > 1 THEN 'possible' WHEN NOT weak THEN 'likely' ELSE {duty} END AS proposed,
  CASE WHEN distance = 0 THEN 'direct' ELSE 'indirect' END AS directness FROM named),
based AS (SELECT * EXCLUDE (e), arg_min(e, {V.case("e", V.EVIDENCE_RANK)}) AS basis FROM (SELECT *, unnest(evidence_types) AS e FROM scored) GROUP BY ALL),
capped AS (SELECT *, CASE WHEN {rank("proposed")} >= {rank(f"({V.case('basis', V.EVIDENCE)})")} THEN proposed ELSE {V.case("basis", V.EVIDENCE)} END AS likelihood,
  coalesce({V.case("type", V.IMPACT_BY_TYPE)}, {V.case("category", V.IMPACT_BY_CATEGORY)}, 'domain-model') AS impact_type FROM based),
ruled AS (SELECT *, CASE WHEN likelihood = 'excluded' THEN 'non-goal-excluded' WHEN distance = 0 AND mechanism IN ('exact', 'alias', 'path-suffix') AND {strong} THEN 'named-by-specification'
  WHEN NOT {structural} AND directness = 'direct' AND {strong} THEN 'resolved-by-resemblance' WHEN NOT {structural} THEN 'resemblance-only' WHEN {strong} THEN 'structural-obligation'
  WHEN {predictive} AND (basis IN ({V.listed(V.BASIS_EDGES)}) OR impact_type IN ({V.listed(V.CONSEQUENCES)})) THEN 'architectural-consequence' ELSE 'reachable-only' END AS rule FROM capped),
impacts AS (SELECT *, CASE WHEN rule IN ('non-goal-excluded', 'reachable-only') THEN 'dependency-context' WHEN rule = 'resemblance-only' THEN 'investigation-lead' ELSE 'planning-impact' END AS role FROM ruled)
"""


_SQL = _walk_sql() + scored_sql()


def _walked(spark, d):
    """The walk over a folder's graph."""
    return I.traverse(edges(spark, d), _matches(spark, d), DEPTH, CHAIN_HOPS)


def _impacts(spark, d):
    named = (F.col("distance") == 0) & F.col("mechanism").isin("exact", "alias", "path-suffix")
    return I.with_role(I.classified(_walked(spark, d), nodes(spark, d)), named)


@query(_SQL + "SELECT id, distance, path, array_to_string(edge_types, ',') AS edge_types, array_to_string(corroborating, ',') AS corroborating, admissible, weak, concept, array_to_string(anchor_concepts, ',') AS anchor_concepts, corroborated FROM cand")
def impact_candidates(spark, d):
    told = lambda c: F.array_join(c, ",").alias(c)
    return _walked(spark, d).select("id", "distance", "path", told("edge_types"), told("corroborating"), "admissible", "weak", "concept", told("anchor_concepts"), "corroborated")


@query(_SQL + "SELECT id, confidence FROM scored")
def impact_confidence(spark, d):
    return I.classified(_walked(spark, d), nodes(spark, d)).select("id", "confidence")


@query(_SQL + "SELECT id, directness, confidence, array_to_string(evidence_types, ',') AS evidence_types, basis, proposed, likelihood, impact_type FROM impacts")
def impact_classified(spark, d):
    return _impacts(spark, d).select("id", "directness", "confidence", F.array_join("evidence_types", ",").alias("evidence_types"), "basis", "proposed", "likelihood", "impact_type")


@query(_SQL + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY distance > 0, confidence DESC, {V.case("likelihood", V.LIKELIHOOD_RANK)}, id) AS place FROM impacts)
SELECT id, confidence, likelihood, (SELECT count(*) FROM ranked WHERE place > 100) AS dropped, (SELECT max(confidence) FROM ranked WHERE place > 100) AS highest_dropped FROM ranked WHERE place <= 100""")
def impact_capped(spark, d):
    """The hundred strongest impacts, anchors before all others; how many were dropped, and the confidence of the strongest of those."""
    every = staged(_impacts(spark, d).select("id", "confidence", "likelihood", (F.col("distance") > 0).alias("reached")))
    page = staged(every.orderBy("reached", F.desc("confidence"), F.expr(V.case("likelihood", V.LIKELIHOOD_RANK)), "id").limit(100))
    left = every.join(F.broadcast(page.select("id")), "id", "left_anti").agg(F.count("*").alias("dropped"), F.max("confidence").alias("highest_dropped"))
    return page.drop("reached").crossJoin(F.broadcast(left))


@query(_SQL + "SELECT id, rule, role FROM impacts")
def planning_roles(spark, d):
    return _impacts(spark, d).select("id", "rule", "role")


@query(_SQL + """SELECT count(*) AS total, count(*) FILTER (role = 'planning-impact') AS planning, count(*) FILTER (role = 'dependency-context') AS context, count(*) FILTER (role = 'investigation-lead') AS leads,
floor(100.0 * count(*) FILTER (role = 'planning-impact') / count(*) + 0.5) / 100 AS planning_share FROM impacts""")
def planning_signal(spark, d):
    of = lambda r: F.count_if(F.col("role") == r)
    planning = of("planning-impact")
    share = F.when(F.count("*") == 0, 0.0).otherwise(F.floor(planning * 100.0 / F.count("*") + 0.5) / 100)
    return _impacts(spark, d).agg(F.count("*").alias("total"), planning.alias("planning"), of("dependency-context").alias("context"), of("investigation-lead").alias("leads"), share.alias("planning_share"))


@query(_SQL + """, q AS (SELECT count(*) AS shown, count(*) FILTER (likelihood IN ('required', 'likely')) AS strong,
  count(*) FILTER (likelihood IN ('required', 'likely') AND basis NOT IN ('name-similarity', 'semantic-match', 'lexical-only')) AS strong_structural,
  count(*) FILTER (basis = 'name-similarity') AS fuzzy, count(*) FILTER (distance >= 2) AS multi_hop, count(*) FILTER (likelihood <> proposed) AS tier_capped FROM impacts WHERE likelihood NOT IN ('lexical-only', 'excluded'))
SELECT *, CASE WHEN shown = 0 THEN 'evidence-backed' WHEN strong_structural = 0 THEN 'weak' WHEN 2 * fuzzy > shown OR 2 * multi_hop > shown OR tier_capped > 0 THEN 'mixed' ELSE 'evidence-backed' END AS status FROM q""")
def evidence_quality(spark, d):
    shown = _impacts(spark, d).filter(~F.col("likelihood").isin("lexical-only", "excluded"))
    strong = F.col("likelihood").isin("required", "likely")
    counts = shown.agg(
        F.count("*").alias("shown"), F.count_if(strong).alias("strong"), F.count_if(strong & ~F.col("basis").isin("name-similarity", "semantic-match", "lexical-only")).alias("strong_structural"),
        F.count_if(F.col("basis") == "name-similarity").alias("fuzzy"), F.count_if(F.col("distance") >= 2).alias("multi_hop"), F.count_if(F.col("likelihood") != F.col("proposed")).alias("tier_capped"),
    )
    mixed = F.expr("2 * fuzzy > shown or 2 * multi_hop > shown or tier_capped > 0")
    return counts.withColumn("status", F.when(F.col("shown") == 0, "evidence-backed").when(F.col("strong_structural") == 0, "weak").when(mixed, "mixed").otherwise("evidence-backed"))


_ORDERED = _SQL + f""", keyed AS (SELECT *, {V.case("role", {"planning-impact": 0, "dependency-context": 1, "investigation-lead": 2})} AS k1, {V.case("likelihood", V.LIKELIHOOD_RANK)} AS k2, {V.case("basis", V.EVIDENCE_RANK)} AS k3 FROM impacts
  WHERE likelihood IN ('required', 'likely', 'possible')), placed AS (SELECT *, row_number() OVER (ORDER BY k1, k2, k3, confidence DESC, id) AS place FROM keyed)
"""


@query(_ORDERED + "SELECT id, role, likelihood, basis, confidence, (SELECT count(*) FROM keyed) AS total FROM placed WHERE place > (SELECT coalesce(max(place), 0) FROM placed WHERE id = 'customer:42') ORDER BY place LIMIT 20")
def impact_page(spark, d):
    """Twenty impacts by strength after the cursor's, with the number of all."""
    ranks = [F.expr(V.case("role", {"planning-impact": 0, "dependency-context": 1, "investigation-lead": 2})).alias("k1"), F.expr(V.case("likelihood", V.LIKELIHOOD_RANK)).alias("k2"), F.expr(V.case("basis", V.EVIDENCE_RANK)).alias("k3")]
    rows = staged(_impacts(spark, d).filter(F.col("likelihood").isin("required", "likely", "possible")).select("id", "role", "likelihood", "basis", "confidence", *ranks))
    page = I.after_cursor(rows, [("k1", True), ("k2", True), ("k3", True), ("confidence", False), ("id", True)], rows.filter("id = 'customer:42'"), 20)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).select("id", "role", "likelihood", "basis", "confidence", "total")


@query(_SQL + "SELECT likelihood, basis, role, count(*) AS n, min(confidence) AS least, max(confidence) AS most FROM impacts GROUP BY ALL")
def impact_summary_counts(spark, d):
    return _impacts(spark, d).groupBy("likelihood", "basis", "role").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query(_SQL + "SELECT id, role, likelihood FROM impacts WHERE likelihood IN ('required', 'likely', 'possible') AND list_has_any(evidence_types, ['async-event', 'external-contract']) AND role = 'planning-impact' AND confidence >= 60")
def impact_filters(spark, d):
    rows = _impacts(spark, d).filter(F.col("likelihood").isin("required", "likely", "possible") & (F.col("role") == "planning-impact") & (F.col("confidence") >= 60))
    return rows.filter(I.within_any("evidence_types", ("async-event", "external-contract"))).select("id", "role", "likelihood")


_SHAPE = "+ a AS (SELECT * FROM nodes WHERE id IN ({})), c AS (SELECT DISTINCT a.id FROM a JOIN edges e ON e.type IN ('PUBLISHES') AND (source_id = a.id OR target_id = a.id)), f AS (SELECT count(*) FILTER (type IN ('table')) AS far_reaching, (SELECT count(*) FROM c) AS chained, count(DISTINCT split_part(path, '/', 1)) AS containers FROM a)"


@query(_SHAPE.format("'supplier:1', 'nation:1', 'customer:3'") + " SELECT CASE WHEN far_reaching > 0 OR chained > 0 OR containers > 1 THEN 'distributed' ELSE 'contained' END AS shape, far_reaching, chained, containers, 2 AS max_depth, CASE WHEN far_reaching > 0 OR chained > 0 OR containers > 1 THEN 8 ELSE 1 END AS max_chain, CASE WHEN far_reaching > 0 OR chained > 0 OR containers > 1 THEN 20000 ELSE 2000 END AS max_expansions FROM f")
def change_shape(spark, d):
    anchors = nodes(spark, d).filter(F.col("id").isin(*MATCHED))
    return I.change_shape(anchors, edges(spark, d), F.split_part("path", F.lit("/"), F.lit(1)))
