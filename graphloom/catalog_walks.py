"""Registered walks and their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.operators import graph as G
from graphloom.operators import preflight as P
from graphloom.operators import walks as K
from graphloom.plans.lift import edges, edges_of, nid, nodes, table


@query("SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS position, id AS edge_id FROM edges")
def adjacency_lists(spark, d):
    return K.adjacency_positions(edges(spark, d)).select("source_id", F.col("position").cast("long").alias("position"), "edge_id")


@query("SELECT DISTINCT target_id AS id, source_id AS neighbour FROM edges JOIN nodes n ON n.id = source_id AND n.category IN ('application', 'repository') WHERE edges.type IN ('CALLS', 'CONTAINS') AND target_id IN (SELECT id FROM nodes WHERE category = 'integration')")
def neighbours_filtered(spark, d):
    every = nodes(spark, d)
    return K.neighbours_of(edges(spark, d), every, every.filter("category = 'integration'"), "in", ("CALLS", "CONTAINS"), ("application", "repository"))


def _levels(depth: int) -> str:
    out = """+ w AS MATERIALIZED (SELECT source_id AS a, target_id AS b, '0' || id AS hop FROM edges WHERE type IN ('CONTAINS', 'CALLS') UNION ALL SELECT target_id, source_id, '1' || id FROM edges WHERE type IN ('CONTAINS', 'CALLS')),
k0 AS MATERIALIZED (SELECT 'region:0' AS id, 0 AS depth, 'region:0' AS path, ['region:0'] AS ord)"""
    for n in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT id FROM k{i}" for i in range(n))
        out += f", k{n} AS MATERIALIZED (SELECT b AS id, {n} AS depth, path || '>' || b AS path, list_append(ord, hop) AS ord FROM k{n - 1} JOIN w ON a = k{n - 1}.id WHERE b NOT IN ({known}) QUALIFY row_number() OVER (PARTITION BY b ORDER BY list_append(ord, hop)) = 1)"
    return out + " " + " UNION ALL ".join(f"SELECT id, depth, path FROM k{n}" for n in range(depth + 1))


@query(_levels(3))
def shortest_path_tree(spark, d):
    return K.shortest_paths(edges(spark, d, ("CONTAINS", "CALLS")), nodes(spark, d).filter("id = 'region:0'"), 3)


@query("+ s AS (SELECT source_id a, target_id b FROM edges UNION SELECT target_id, source_id FROM edges), i AS (SELECT 'supplier:1' AS id UNION SELECT b FROM s WHERE a = 'supplier:1') SELECT id, type, source_id, target_id FROM edges WHERE source_id IN (FROM i) AND target_id IN (FROM i)")
def subgraph_edges(spark, d):
    """The edges among all nodes within one step of an anchor, over all edge types."""
    every = edges(spark, d)
    return G.induced(every, G.distances(every, nodes(spark, d).filter("id = 'supplier:1'"), 1))


def _heritage(spark, d) -> tuple[DataFrame, DataFrame]:
    """Classes of customers: a heritage by key, members named by the brands of the parts they order, and some boundaries."""
    c = table(spark, d, "customer").select("c_custkey")
    bought = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    members = G.staged(bought.select("o_custkey", "p_brand").distinct())  # read for each use of nodes and edges
    kind = F.when(F.col("c_custkey") % 50 == 13, K.OPEN).otherwise("class")
    held = c.select(nid("customer", "c_custkey").alias("id"), kind.alias("type"), F.concat(F.lit("C"), "c_custkey").alias("name"))
    held = held.unionByName(members.select(F.concat_ws("/", nid("customer", "o_custkey"), "p_brand").alias("id"), F.lit("field").alias("type"), F.concat(F.lit("C"), "o_custkey", F.lit("."), "p_brand").alias("name")))
    parent = lambda type_, k: c.filter("c_custkey > 0").select(F.lit(type_).alias("type"), nid("customer", "c_custkey").alias("source_id"), nid("customer", F.floor(F.col("c_custkey") / k)).alias("target_id"))
    links = [parent("EXTENDS", 4), parent("IMPLEMENTS", 9), members.select(F.lit("DECLARES_MEMBER").alias("type"), nid("customer", "o_custkey").alias("source_id"), F.concat_ws("/", nid("customer", "o_custkey"), "p_brand").alias("target_id"))]
    return held, reduce(DataFrame.unionByName, links).select(F.concat("type", F.lit(":"), "source_id", F.lit("->"), "target_id").alias("id"), "type", "source_id", "target_id")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 50 = 13 AS closed FROM customer),
m AS (SELECT DISTINCT o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#7'),
up AS (SELECT k, k // 4 AS p, 'EXTENDS:customer:' || k || '->customer:' || (k // 4) AS hop FROM c WHERE k > 0 UNION ALL SELECT k, k // 9, 'IMPLEMENTS:customer:' || k || '->customer:' || (k // 9) FROM c WHERE k > 0),
w AS (SELECT k AS id, k AS p, 0 AS depth, []::VARCHAR[] AS ord FROM c UNION ALL
  SELECT w.id, up.p, depth + 1, list_append(ord, hop) FROM w JOIN c ON c.k = w.p AND NOT c.closed JOIN up ON up.k = w.p WHERE w.p NOT IN (SELECT k FROM m) AND depth < 16),
f AS (SELECT id, p, depth, ord FROM w QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY depth, ord) = 1),
hit AS (SELECT id, p FROM f JOIN c ON c.k = p AND NOT closed WHERE p IN (SELECT k FROM m) QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, ord) = 1),
miss AS (SELECT id, bool_or(closed) AS open, count(*) FILTER (NOT closed AND p <> id) AS supertypes FROM f JOIN c ON c.k = p GROUP BY id)
SELECT 'customer:' || miss.id AS id, 'Brand#7' AS member, CASE WHEN p IS NULL THEN 'not-found' ELSE 'found' END AS outcome, 'customer:' || p AS provider, CASE WHEN p IS NOT NULL THEN p <> miss.id END AS inherited,
CASE WHEN p IS NULL THEN open END AS open, CASE WHEN p IS NULL THEN supertypes END AS supertypes FROM miss LEFT JOIN hit ON hit.id = miss.id""", lift=False)
def member_resolution(spark, d):
    held, links = _heritage(spark, d)
    wanted = held.filter("type <> 'field'").select("id", F.lit("Brand#7").alias("member"))
    return K.resolve_members(held, links, wanted)


def _flows(spark, d):
    kinds = (("RENAMED_TO", "PUBLISHES"), ("FLOWS_TO", "READS_FROM"), ("SERIALIZED_AS", "DEPENDS_ON"))
    return reduce(DataFrame.unionByName, [edges_of(spark, d, k).withColumn("type", F.lit(t)) for t, k in kinds])


@query("""+ fl AS (SELECT source_id AS a, target_id AS b, CASE type WHEN 'PUBLISHES' THEN 'RENAMED_TO' WHEN 'READS_FROM' THEN 'FLOWS_TO' ELSE 'SERIALIZED_AS' END AS via FROM edges WHERE type IN ('PUBLISHES', 'READS_FROM', 'DEPENDS_ON')),
ways AS (SELECT 'forward' AS direction, a, b, via FROM fl UNION ALL SELECT 'backward', b, a, via FROM fl),
h AS (SELECT 'part:5' AS start, direction, b AS id, via FROM ways WHERE a = 'part:5' UNION SELECT start, h.direction, b, ways.via FROM h JOIN ways ON ways.a = h.id AND ways.direction = h.direction) SELECT * FROM h""")
def field_flow(spark, d):
    return K.field_flow(_flows(spark, d), nodes(spark, d).filter("id = 'part:5'"))


@query("""+ s AS (SELECT source_id a, target_id b FROM edges UNION SELECT target_id, source_id FROM edges), w AS (SELECT 'part:5' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN s ON a = id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM w WHERE id IN (SELECT id FROM nodes WHERE type = 'third-party-service') GROUP BY id""")
def field_flow_boundaries(spark, d):
    every = nodes(spark, d)
    near = G.distances(edges(spark, d), every.filter("id = 'part:5'"), 2)
    return near.join(every.filter(F.col("type").isin(*K.BOUNDARIES)).select("id"), "id", "left_semi")


def _runtime(spark, d):
    """Orders as configured URLs, customers as resources, nations as processes, regions as handlers; some customers stop short or fan out."""
    c, o, n = (table(spark, d, x) for x in ("customer", "orders", "nation"))
    link = lambda df, type_, a, b: df.select(F.lit(type_).alias("type"), a.alias("source_id"), b.alias("target_id"))
    home = link(c.filter("c_acctbal >= 0"), "RESOLVES_TO", nid("customer", "c_custkey"), nid("nation", "c_nationkey"))
    twice = link(c.filter("c_acctbal >= 0 and c_mktsegment = 'MACHINERY'"), "ROUTES_TO", nid("customer", "c_custkey"), nid("nation", (F.col("c_nationkey") + 1) % 25))
    links = [link(o, "ROUTES_TO", nid("order", "o_orderkey"), nid("customer", "o_custkey")), home, twice, link(n, "RUNS_IN", nid("nation", "n_nationkey"), nid("region", "n_regionkey"))]
    kind = F.split_part("id", F.lit(":"), F.lit(1))
    types = F.create_map(*(F.lit(x) for x in ("order", "service-url", "customer", "cloud-run-service", "nation", "runtime-process", "region", "handler")))
    return nodes(spark, d).select("id", types[kind].alias("type")).filter("type is not null"), reduce(DataFrame.unionByName, links)


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal >= 0 AS has_home, c_mktsegment = 'MACHINERY' AS twice, 'order:' || o_orderkey AS start FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT start, start || '>customer:' || c_custkey || CASE WHEN has_home AND NOT twice THEN '>nation:' || n_nationkey || '>region:' || n_regionkey ELSE '' END AS hops, CASE WHEN has_home AND NOT twice THEN 4 ELSE 2 END::BIGINT AS n_hops,
CASE WHEN NOT has_home THEN 'no-handler' WHEN twice THEN 'fan-out' END AS reason FROM c JOIN nation ON c_nationkey = n_nationkey""", lift=False)
def runtime_paths(spark, d):
    held, links = _runtime(spark, d)
    return K.runtime_paths(held, links, held.filter("type = 'service-url'"))


@query("""WITH w AS (SELECT 'order:' || o_orderkey AS start, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')
SELECT start, 'nation:' || n AS process, CASE n % 4 WHEN 1 THEN 'DB_URL' WHEN 2 THEN 'API_URL' ELSE 'API_URL,DB_URL' END AS missing FROM w WHERE n % 4 > 0""", lift=False)
def config_gaps(spark, d):
    """The processes on the ways of orders' traffic that don't receive what is needed there."""
    held, links = _runtime(spark, d)
    nation = table(spark, d, "nation").select(nid("nation", "n_nationkey").alias("id"), (F.col("n_nationkey") % 4).alias("m"))
    processes = nation.filter("m in (0, 1)").select("id", F.lit("API_URL").alias("name")).unionByName(nation.filter("m in (0, 2)").select("id", F.lit("DB_URL").alias("name")))
    needs = nation.select(F.explode(F.array(F.lit("DB_URL"), F.lit("API_URL"))).alias("name")).distinct()
    _, gaps = P.config_gaps(K.runtime_paths(held, links, held.filter("type = 'service-url'")), held, processes, needs)
    return gaps.select("start", F.col("hop").alias("process"), F.array_join("missing", ",").alias("missing"))


@query("""+ e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM calls JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey AND (c_nationkey * 7 + s_nationkey) % 3 = 0),
w AS (SELECT n_nationkey AS id, 0 AS layer FROM nation UNION SELECT b, layer + 1 FROM w JOIN e ON a = id WHERE layer < 11) SELECT 'nation:' || id AS id, max(layer) AS layer FROM w GROUP BY 1""")
def layer_assignment(spark, d):
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    calls = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    pairs = calls.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey < s_nationkey and (c_nationkey * 7 + s_nationkey) % 3 = 0")
    groups = nodes(spark, d).filter("type = 'package'").select("id")
    return K.layers(groups, pairs.select(nid("nation", "c_nationkey").alias("source"), nid("nation", "s_nationkey").alias("target")))


@query("""WITH g AS (SELECT c_nationkey, count(*) AS size FROM customer GROUP BY 1), r AS (SELECT c_nationkey, row_number() OVER (ORDER BY size DESC, c_nationkey) AS rank FROM g),
m AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS turn FROM customer)
SELECT c_custkey, c_nationkey, turn FROM m JOIN r USING (c_nationkey) ORDER BY turn, rank LIMIT 60""", lift=False)
def round_robin_sample(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return K.round_robin(rows, "c_nationkey", [F.col("c_custkey")], 60).withColumn("turn", F.col("turn").cast("long"))
