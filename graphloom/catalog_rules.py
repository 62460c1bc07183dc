"""Registered impact, rule, overlay, review, text and streaming queries, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import _SNAP, _snapshots, query
from graphloom.operators import rules as R
from graphloom.plans.lift import edges_of, nid, table
from graphloom.streaming.windows import counted_windows

_OWNER = "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey"
FORBIDDEN = [("no-0-to-1", 0, 1), ("no-2-to-0", 2, 0), ("no-4-to-3", 4, 3)]


def _contexts(spark, d, name, kind, key, nation):
    home = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("context"))
    return table(spark, d, name).join(home, F.col(nation) == F.col("n_nationkey")).select(nid(kind, key).alias("id"), "context")


@query(f"SELECT rule, 'customer:' || o_custkey AS source_id, 'supplier:' || l_suppkey AS target_id FROM calls {_OWNER} JOIN (VALUES ('no-0-to-1', 0, 1), ('no-2-to-0', 2, 0), ('no-4-to-3', 4, 3)) r(rule, a, b) ON cn.n_regionkey = a AND sn.n_regionkey = b")
def dependency_rule_violations(spark, d):
    contexts = _contexts(spark, d, "customer", "customer", "c_custkey", "c_nationkey").unionByName(_contexts(spark, d, "supplier", "supplier", "s_suppkey", "s_nationkey"))
    rules = spark.createDataFrame(FORBIDDEN, "rule string, source_context int, target_context int")
    return R.rule_violations(edges_of(spark, d, "CALLS"), contexts, F.broadcast(rules))


@query("SELECT l_orderkey, sum((p_size < 5)::INT)::BIGINT AS triggers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING bool_or(p_size < 5) AND NOT bool_or(p_size > 30)", lift=False)
def accompanying_change(spark, d):
    changes = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return R.missing_companions(changes, "l_orderkey", F.col("p_size") < 5, F.col("p_size") > 30)


@query("SELECT CASE WHEN p_size > 40 THEN p_brand || ' ' || p_type ELSE p_name END AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 AND bool_or(p_size > 40)", lift=False)
def name_merge(spark, d):
    renamed = F.col("p_size") > 40
    return R.shared_names(table(spark, d, "part"), F.when(renamed, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.col("p_name")), renamed)


_FOUND = f"{_SNAP}, f AS (SELECT o_custkey, l_suppkey, CASE WHEN was AND now THEN 'matched' WHEN was THEN 'missing' ELSE 'unexpected' END AS finding FROM s)"


@query(f"{_FOUND} SELECT * FROM f", lift=False)
def review_findings(spark, d):
    return R.compared(_snapshots(spark, d), "was", "now").select("o_custkey", "l_suppkey", "finding")


_COVER = f"{_FOUND}, c AS (SELECT o_custkey, sum((finding <> 'unexpected')::INT)::BIGINT AS predicted, sum((finding = 'matched')::INT)::BIGINT AS matched, sum((finding = 'unexpected')::INT)::BIGINT AS unexpected FROM f GROUP BY 1)"


def _coverage(spark, d):
    count = lambda c: F.count_if(F.expr(c))
    return R.compared(_snapshots(spark, d), "was", "now").groupBy("o_custkey").agg(count("finding <> 'unexpected'").alias("predicted"), count("finding = 'matched'").alias("matched"), count("finding = 'unexpected'").alias("unexpected"))


@query(f"SELECT l_suppkey, count(DISTINCT c_nationkey) AS declarers FROM calls {_OWNER} GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 4 AND 2 * count(DISTINCT c_nationkey) >= (SELECT count(*) FROM nation)")
def dependency_ubiquity(spark, d):
    pairs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    declarers = pairs.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("l_suppkey").agg(F.count_distinct("c_nationkey").alias("declarers"))
    eligible = F.broadcast(table(spark, d, "nation").agg(F.count("*").alias("eligible")))
    return declarers.crossJoin(eligible).filter("declarers >= 4 and 2 * declarers >= eligible").select("l_suppkey", "declarers")


@query("SELECT doc_id, len(regexp_split_to_array(text, '[.!?]+[ \\n]+'))::BIGINT AS sentences FROM documents WHERE text IS NOT NULL", lift=False)
def sentence_split(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.split("text", "[.!?]+[ \\n]+")).cast("long").alias("sentences"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'license', ''))) / 7)::BIGINT AS hits FROM documents WHERE contains(text, 'license')", lift=False)
def literal_search(spark, d):
    hits = (F.length("text") - F.length(F.replace("text", F.lit("license"), F.lit("")))) / 7
    return table(spark, d, "documents").filter(F.contains("text", F.lit("license"))).select("doc_id", hits.cast("long").alias("hits"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", lift=False)
def stream_warning_windows(spark, d):
    return counted_windows(spark, f"{d}/event[s].parquet", "ts", "1 day", "event_type").withColumnRenamed("start", "day")
