"""The lift: relational tables to a typed property graph of nodes and edges.

Nodes are regions, nations, customers, suppliers, parts and orders; edges follow from keys, distinct on their end
points. All of it is declarative, so that a query over one edge type reads the tables and columns of that type only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nid(kind: str, key) -> Column:
    """The id of a node: its kind and key."""
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, type, name, path, provenance) of all nodes; paths nest a nation below its region."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    home = nation.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("home"))

    def made(df, kind, key, category, type_, name, path, provenance="static-analysis"):
        return df.select(nid(kind, key).alias("id"), F.lit(category).alias("category"), F.lit(type_).alias("type"), name.alias("name"), path.alias("path"), F.lit(provenance).alias("provenance"))

    return reduce(DataFrame.unionByName, [
        made(t("region"), "region", "r_regionkey", "repository", "workspace", F.col("r_name"), F.col("r_name"), "configuration"),
        made(nation, "nation", "n_nationkey", "repository", "package", F.col("n_name"), F.concat_ws("/", "r_name", "n_name"), "configuration"),
        made(t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "application", "service", F.col("c_name"), F.concat_ws("/", "home", "c_name")),
        made(t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "integration", "third-party-service", F.col("s_name"), F.concat_ws("/", "home", "s_name")),
        made(t("part"), "part", "p_partkey", "data", "table", F.col("p_name"), F.concat(F.lit("parts/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("#"), F.col("p_partkey"))),
        made(t("orders"), "order", "o_orderkey", "domain", "domain-event", F.col("o_orderkey").cast("string"), F.concat(F.lit("orders/"), F.year("o_orderdate"), F.lit("/"), F.col("o_orderkey")), "git-history"),
    ])


def edges_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(source_id, target_id) of one edge type."""
    t = lambda name: table(spark, sf_dir, name)
    ends = lambda df, a, b: df.select(a.alias("source_id"), b.alias("target_id"))
    if kind == "CONTAINS":
        return (
            ends(t("nation"), nid("region", "n_regionkey"), nid("nation", "n_nationkey"))
            .unionByName(ends(t("customer"), nid("nation", "c_nationkey"), nid("customer", "c_custkey")))
            .unionByName(ends(t("supplier"), nid("nation", "s_nationkey"), nid("supplier", "s_suppkey")))
        )
    if kind == "PUBLISHES":
        return ends(t("orders"), nid("customer", "o_custkey"), nid("order", "o_orderkey"))
    if kind == "READS_FROM":
        return ends(t("lineitem").select("l_orderkey", "l_partkey").distinct(), nid("order", "l_orderkey"), nid("part", "l_partkey"))
    if kind == "DEPENDS_ON":
        return ends(t("lineitem").select("l_partkey", "l_suppkey").distinct(), nid("part", "l_partkey"), nid("supplier", "l_suppkey"))
    if kind == "CALLS":
        pairs = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
        return ends(pairs, nid("customer", "o_custkey"), nid("supplier", "l_suppkey"))
    raise ValueError(kind)


EDGE_TYPES = ("CONTAINS", "PUBLISHES", "READS_FROM", "DEPENDS_ON", "CALLS")


def edges(spark: SparkSession, sf_dir: str, kinds=EDGE_TYPES) -> DataFrame:
    """(id, type, source_id, target_id); the id is type and end points."""
    each = [edges_of(spark, sf_dir, k).withColumn("type", F.lit(k)) for k in kinds]
    return reduce(DataFrame.unionByName, each).select(F.concat("type", F.lit(":"), "source_id", F.lit("->"), "target_id").alias("id"), "type", "source_id", "target_id")


LIFT_SQL = """
home AS (SELECT n_nationkey, r_name || '/' || n_name AS home FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'repository' AS category, 'workspace' AS type, r_name AS name, r_name AS path, 'configuration' AS provenance FROM region
  UNION ALL SELECT 'nation:' || n.n_nationkey, 'repository', 'package', n_name, home, 'configuration' FROM nation n JOIN home h ON n.n_nationkey = h.n_nationkey
  UNION ALL SELECT 'customer:' || c_custkey, 'application', 'service', c_name, home || '/' || c_name, 'static-analysis' FROM customer JOIN home ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'integration', 'third-party-service', s_name, home || '/' || s_name, 'static-analysis' FROM supplier JOIN home ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'data', 'table', p_name, 'parts/' || p_brand || '/' || p_name || '#' || p_partkey, 'static-analysis' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'domain', 'domain-event', o_orderkey::VARCHAR, 'orders/' || year(o_orderdate) || '/' || o_orderkey, 'git-history' FROM orders
),
calls AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (
  SELECT 'CONTAINS' AS type, 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id FROM nation
  UNION ALL SELECT 'CONTAINS', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'CONTAINS', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'PUBLISHES', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'READS_FROM', 'order:' || l_orderkey, 'part:' || l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'DEPENDS_ON', 'part:' || l_partkey, 'supplier:' || l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'CALLS', 'customer:' || o_custkey, 'supplier:' || l_suppkey FROM calls
),
edges AS (SELECT type || ':' || source_id || '->' || target_id AS id, type, source_id, target_id FROM ends)
"""
