"""Registered queries over the impact model of many requirements, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.catalog_impact import scored_sql
from graphloom.operators import clarify as C
from graphloom.operators import requirements as R
from graphloom.operators.graph import staged
from graphloom.plans import vocabulary as V
from graphloom.plans.lift import edges, nid, nodes, table

#: What a requirement on a supplier says, by its key.
SAYINGS = (
    "must remove the limit of `{0}`", "must pass the constructor of `{0}` a key", "must take another argument in `{0}` for `Depot {1}`", "must sort the lines of `{0}`", "must carry a payload from `{0}` to `{2}`",
)


def _requirements(spark, d):
    """Of each supplier, of each nation, and of each region, whose requirement names nothing that there is."""
    t = lambda n: table(spark, d, n)
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    other = F.concat(F.lit("Customer#"), F.lpad(key, 9, "0"))
    filled = [F.replace(F.replace(F.replace(F.lit(s), F.lit("{0}"), name), F.lit("{1}"), key), F.lit("{2}"), other) for s in SAYINGS]
    said = F.element_at(F.array(*filled), (F.col("s_suppkey") % len(SAYINGS) + 1).cast("int"))
    rows = t("supplier").select(F.concat(F.lit("supplier-"), key).alias("requirement"), F.concat(F.lit("The service "), said).alias("statement"))
    nation = t("nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("requirement"), F.concat(F.lit("Must add a page to `"), "n_name", F.lit("`")).alias("statement"))
    region = t("region").select(F.concat(F.lit("region-"), "r_regionkey").alias("requirement"), F.concat(F.lit("Must keep `Nowhere "), "r_regionkey", F.lit("`")).alias("statement"))
    return rows.unionByName(nation).unionByName(region)


_KINDS = ("remove-api", "change-construction", "change-api", "change-behavior", "change-data-shape")
_ASKED = f"""+ asked AS MATERIALIZED (
  SELECT 'supplier-' || s_suppkey AS requirement, {V.case("(s_suppkey % 5)::VARCHAR", dict(zip("01234", _KINDS)))} AS change, s_name AS concept, 0 AS turn, CASE s_suppkey % 5 WHEN 4 THEN true ELSE false END AS far FROM supplier
  UNION ALL SELECT 'supplier-' || s_suppkey, 'change-api', 'Depot ' || s_suppkey, 1, false FROM supplier WHERE s_suppkey % 5 = 2
  UNION ALL SELECT 'supplier-' || s_suppkey, 'change-data-shape', 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0'), 1, true FROM supplier WHERE s_suppkey % 5 = 4
  UNION ALL SELECT 'nation-' || n_nationkey, 'add-api', n_name, 0, false FROM nation UNION ALL SELECT 'region-' || r_regionkey, 'unknown', 'Nowhere ' || r_regionkey, 0, true FROM region),
seeds AS MATERIALIZED (SELECT requirement, change, concept, n.id, row_number() OVER (PARTITION BY requirement ORDER BY turn) AS rank,
  CASE WHEN far THEN 'distributed' ELSE 'contained' END AS shape, CASE WHEN far THEN 8 ELSE 1 END AS max_chain, CASE WHEN far THEN 20000 ELSE 2000 END AS most FROM asked JOIN nodes n ON concept = name)"""


def walk_sql(levels: int, kinds: str = "true") -> str:
    """The guarded walk from ``seeds`` with one table a level; ends with ``kept`` routes and ``told`` (requirement, tried, most)."""
    chain = f"type IN ({V.listed(V.CHAIN)})"
    out = f""",
moves AS (SELECT source_id AS a, target_id AS b, '0' || id AS hop, type, false AS up FROM edges WHERE type NOT IN ({V.listed(V.UPWARD_ONLY)}) AND {kinds}
  UNION ALL SELECT target_id, source_id, '1' || id, type, true FROM edges WHERE {kinds}),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hop) AS place, count(*) OVER (PARTITION BY a) AS degree FROM moves),
degrees AS MATERIALIZED (SELECT a, count(*) AS degree FROM moves GROUP BY a),
f0 AS MATERIALIZED (SELECT requirement, rank, concept, 'exact' AS mechanism, shape, change, max_chain, most, id AS anchor, id, 0 AS distance, id AS path, []::VARCHAR[] AS edge_types, 0 AS depth, 0 AS chain, true AS admissible, false AS weak, 0::BIGINT AS number, 0::BIGINT AS used FROM seeds),
s0 AS MATERIALIZED (SELECT requirement, rank, id FROM f0)"""
    for n in range(1, levels + 1):
        out += f""",
t{n} AS MATERIALIZED (SELECT f.*, used + coalesce(sum(degree) OVER (PARTITION BY requirement, rank ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin, (used + sum(degree) OVER (PARTITION BY requirement, rank))::BIGINT AS after FROM f{n - 1} f JOIN degrees ON id = a WHERE distance < 2 + max_chain),
c{n} AS MATERIALIZED (SELECT * FROM (SELECT requirement, rank, concept, mechanism, shape, change, max_chain, most, anchor, b AS id, {n} AS distance, path || '>' || b AS path, list_append(edge_types, type) AS edge_types,
  CASE WHEN {chain} THEN 0 ELSE depth + 1 END AS depth, chain + ({chain})::INT AS chain, admissible AND (len(edge_types) = 0 OR edge_types[1] NOT IN ({V.listed(V.OWNERSHIP)}) OR up) AS admissible,
  distance = 0 AND (type = '{V.NEVER_STRONG}' OR up AND type IN ({V.listed(V.WEAK_REVERSED)})) AS weak, (begin + place)::BIGINT AS number, after AS used FROM t{n} JOIN steps ON a = id AND begin + place <= most) WHERE depth <= 2 AND chain <= max_chain),
f{n} AS MATERIALIZED (SELECT * FROM c{n} WHERE used <= most AND (requirement, rank, id) NOT IN (SELECT (requirement, rank, id) FROM s{n - 1}) QUALIFY row_number() OVER (PARTITION BY requirement, rank, id ORDER BY number) = 1),
s{n} AS MATERIALIZED (SELECT requirement, rank, id FROM s{n - 1} UNION ALL SELECT requirement, rank, id FROM f{n})"""
    spent = " UNION ALL ".join(f"SELECT requirement, rank, after FROM t{n}" for n in range(1, levels + 1))
    routes = " UNION ALL ".join(f"SELECT * FROM {x}" for x in ("f0", *(f"c{n}" for n in range(1, levels + 1))))
    return out + f""",
spent AS (SELECT requirement, rank, coalesce(max(after), 0) AS used FROM seeds LEFT JOIN ({spent}) USING (requirement, rank) GROUP BY ALL),
prior AS MATERIALIZED (SELECT *, coalesce(sum(used) OVER (PARTITION BY requirement ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM spent),
told AS (SELECT requirement, sum(used) AS tried, (SELECT max(most) FROM seeds s WHERE s.requirement = prior.requirement) AS most FROM prior GROUP BY requirement),
kept AS MATERIALIZED (SELECT r.* FROM ({routes}) r JOIN prior USING (requirement, rank) WHERE distance = 0 OR number + earlier <= most)"""


_MODEL = _ASKED + walk_sql(10) + ", routes AS (FROM kept)" + scored_sql("requirement, change, shape, ", "change") + f""",
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY requirement ORDER BY distance > 0, confidence DESC, {V.case("likelihood", V.LIKELIHOOD_RANK)}, id) AS strength FROM impacts)
"""


def _model(spark, d):
    none = table(spark, d, "region").select(F.col("r_name").alias("concept"), F.col("r_name").alias("alias")).limit(0)
    return R.impact_model(_requirements(spark, d), nodes(spark, d), edges(spark, d), none)


@query(_MODEL + "SELECT requirement, id, distance, path, concept, mechanism, shape, change, confidence, likelihood, basis, impact_type, role FROM ranked WHERE strength <= 100")
def requirement_impacts(spark, d):
    """From statements to impacts with roles, over all requirements in one walk."""
    return _model(spark, d)[0]


@query(_MODEL + """SELECT requirement, 'unknown-concept' AS code, concept AS subject, NULL::BIGINT AS amount FROM asked WHERE concept NOT IN (SELECT name FROM nodes) AND NOT contains(concept, ' ')
UNION ALL SELECT requirement, 'traversal-exhausted', NULL, most FROM told WHERE tried > most
UNION ALL SELECT requirement, 'traversal-cutoff', coalesce(max(confidence) FILTER (distance > 0), 0)::VARCHAR, count(*) FROM ranked WHERE strength > 100 GROUP BY 1
UNION ALL SELECT DISTINCT requirement, 'unmatched-requirement', NULL, NULL::BIGINT FROM asked WHERE requirement NOT IN (SELECT requirement FROM ranked)""")
def requirement_warnings(spark, d):
    return _model(spark, d)[1]


_RELAYS = """+ hops AS MATERIALIZED (SELECT 'order:' || o_orderkey AS source_id, lead('order:' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn, o_custkey FROM orders),
edges2 AS MATERIALIZED (SELECT 'RELAYS_TO:' || source_id || '->' || target_id AS id, 'RELAYS_TO' AS type, source_id, target_id FROM hops WHERE target_id IS NOT NULL),
seeds AS MATERIALIZED (SELECT 'customer-' || o_custkey AS requirement, 'unknown' AS change, source_id AS concept, source_id AS id, 1 AS rank, 'distributed' AS shape, 8 AS max_chain, 20000 AS most FROM hops WHERE turn = 1)"""


@query(_RELAYS + walk_sql(8).replace("FROM edges WHERE", "FROM edges2 WHERE") + "SELECT requirement, id, min(distance) AS distance, min(chain) AS chain, min(path) AS path FROM kept GROUP BY 1, 2")
def requirement_chains(spark, d):
    """The orders of a customer as a chain of relays, followed from the first one as far as a chain budget of eight goes."""
    order = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    turns = order.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["o_orderkey"]).alias("keys"))
    pairs = turns.select(F.explode(F.filter(F.transform("keys", lambda k, i: F.struct(k.alias("a"), F.get("keys", i + 1).alias("b"))), lambda p: p["b"].isNotNull())).alias("p"))
    ends = pairs.select(nid("order", "p.a").alias("source_id"), nid("order", "p.b").alias("target_id"))
    relays = staged(ends.select(F.concat(F.lit("RELAYS_TO:"), "source_id", F.lit("->"), "target_id").alias("id"), F.lit("RELAYS_TO").alias("type"), "source_id", "target_id"))
    first = nid("order", F.element_at("keys", 1))
    no = F.lit(False)
    seeds = turns.select(
        F.concat(F.lit("customer-"), "o_custkey").alias("requirement"), F.lit(1).alias("rank"), first.alias("concept"), F.lit("exact").alias("mechanism"), no.alias("ambiguous"), no.alias("test_only"), first.alias("id"),
        *(F.lit(n).alias(name) for n, name in zip(V.BUDGETS["distributed"], ("max_depth", "max_chain", "max_expansions"), strict=True)),
    )
    routes, _ = R.guarded_walk(relays, seeds)
    return routes.groupBy("requirement", "id").agg(F.min("distance").alias("distance"), F.min("chain").alias("chain"), F.min("path").alias("path"))


def _readings(spark, d):
    """Readings of a requirement on each supplier: the supplier itself, a nation, and a customer; those of every fifth agree."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    rows = s.join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    customer = F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    reading = lambda title, concept: F.struct(F.lit(title).alias("title"), F.concat(F.lit(f"It is about {title} "), k.cast("string"), F.lit(".")).alias("assumption"), F.array(concept).alias("concepts"))
    every = F.array(reading("the supplier", F.col("s_name")), reading("its place", F.when(k % 5 == 0, F.col("s_name")).otherwise(F.col("n_name"))), reading("a customer", customer))
    drafts = rows.select(F.concat(F.lit("r-"), k.cast("string")).alias("requirement"), F.posexplode(every).alias("place", "r")).select("requirement", "place", "r.*")
    return drafts, nodes(spark, d), edges(spark, d, ("CONTAINS", "PUBLISHES"))


_READ = """+ drafts AS (SELECT s_suppkey AS k, 'r-' || s_suppkey AS req, unnest([0, 1, 2]) AS place, unnest([s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE n_name END, 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0')]) AS concept FROM supplier JOIN nation ON s_nationkey = n_nationkey),
seeds AS MATERIALIZED (SELECT req || '#' || place AS requirement, 'unknown' AS change, concept, n.id, 1 AS rank, 'distributed' AS shape, 8 AS max_chain, 20000 AS most FROM drafts JOIN nodes n ON concept = name)"""
_PRINTS = _READ + walk_sql(10, "type IN ('CONTAINS', 'PUBLISHES')") + """,
best AS (SELECT requirement, id, bool_or(admissible) AS ok FROM (SELECT *, min(distance) OVER (PARTITION BY requirement, id) AS least FROM kept) WHERE distance = least GROUP BY 1, 2),
prints AS MATERIALIZED (SELECT split_part(requirement, '#', 1) AS req, split_part(requirement, '#', 2)::INT AS place, id, category, type, name FROM best JOIN nodes USING (id) WHERE ok),
sides AS (SELECT p.req, o.place, p.id, p.category, p.name FROM prints p, (SELECT unnest([1, 2]) AS place) o WHERE p.place = 0 UNION ALL SELECT req, place, id, category, name FROM prints WHERE place > 0),
apart AS (SELECT req, place, id, any_value(category) AS category, any_value(name) AS name FROM sides GROUP BY ALL HAVING count(*) = 1),
differ AS (SELECT req, place, count(*) AS divergent, CASE WHEN bool_or(category IN ('data', 'integration')) THEN 'blocking' WHEN bool_or(category = 'infrastructure') OR count(*) >= 2 THEN 'important' ELSE 'minor' END AS severity, array_to_string(list(name ORDER BY id)[:4], ', ') AS names FROM apart GROUP BY 1, 2),
titles AS (SELECT unnest([0, 1, 2]) AS place, unnest(['the supplier', 'its place', 'a customer']) AS title)
"""


@query(_PRINTS + """SELECT req AS requirement, place, '''the supplier'' or ''' || title || '''? The readings lead to different changes in ' || names || ' — It is about the supplier ' || split_part(req, '-', 2) || '. Or: It is about ' || title || ' ' || split_part(req, '-', 2) || '.' AS question, divergent, severity FROM differ JOIN titles USING (place)
WHERE NOT (place = 1 AND req = 'r-1')""")
def clarifying_questions(spark, d):
    """What competing readings of suppliers' requirements raise, but for what was asked before."""
    drafts, held, links = _readings(spark, d)
    none = table(spark, d, "region").select(F.col("r_name").alias("concept"), F.col("r_name").alias("alias")).limit(0)
    prints = staged(C.footprints(drafts, held, links, none))
    differences = staged(C.compared(drafts, prints, held))
    known = C.questions(drafts, differences, none.select(F.col("concept").alias("question"))).filter("requirement = 'r-1' and place = 1").select("question")
    return C.questions(drafts, differences, known).drop("id")


@query(_PRINTS + """, held AS (SELECT req, place, count(*) AS components, count(*) FILTER (category = 'data') AS data, count(*) FILTER (type = 'domain-event' OR category = 'integration') AS events FROM prints GROUP BY 1, 2),
used AS (SELECT req, place FROM differ UNION SELECT req, 0 FROM differ)
SELECT req AS requirement, place, title, coalesce(components, 0) AS components, CASE WHEN components + 2 * data + 2 * events >= 15 THEN 'high' WHEN components + 2 * data + 2 * events >= 6 THEN 'medium' ELSE 'low' END AS complexity, CASE WHEN events > 0 THEN 2 ELSE 1 END AS risks
FROM used JOIN titles USING (place) LEFT JOIN held USING (req, place)""")
def clarifying_options(spark, d):
    drafts, held, links = _readings(spark, d)
    none = table(spark, d, "region").select(F.col("r_name").alias("concept"), F.col("r_name").alias("alias")).limit(0)
    _, options = C.clarified(drafts, held, links, none, none.select(F.col("concept").alias("question")))
    return options.select("requirement", "place", "title", "components", "complexity", F.size("risks").alias("risks"))
