"""Registered review, drift, overlay, feasibility, preflight and evaluation queries, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.catalog import _snapshots, query
from graphloom.catalog_text import _statements
from graphloom.functions import scalars as S
from graphloom.operators import graph as G
from graphloom.operators import matching as M
from graphloom.operators import review as R
from graphloom.operators import walks as K
from graphloom.plans.lift import edges, nodes, table

# An approved analysis: every customer is a requirement whose impacts are the suppliers it called before the cut; what it called since has changed.
_PLAN = """WITH e AS (SELECT DISTINCT o_custkey, l_suppkey, o_orderdate < DATE '1998-01-01' AS old FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey AS c, l_suppkey AS s, bool_or(old) AS was, bool_or(NOT old) AS now FROM e GROUP BY ALL),
i AS (SELECT *, CASE WHEN s % 10 = 9 THEN NULL ELSE 'c' || c || '/s' || s END AS path, CASE (c + s) % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'likely' WHEN 2 THEN 'possible' ELSE 'excluded' END AS likelihood,
  CASE (c * 7 + s) % 5 WHEN 0 THEN 'preserve' WHEN 1 THEN 'reuse' WHEN 2 THEN 'verify-only' ELSE 'must-change' END AS expectation, (c + s) % 11 = 0 AS rejected, s % 3 <> 0 AS present FROM s),
p AS (SELECT * FROM i WHERE was AND likelihood IN ('required', 'likely', 'possible') AND NOT rejected),
f AS (SELECT c, s, path, CASE WHEN path IS NULL THEN CASE WHEN likelihood = 'required' THEN 'unverifiable' END WHEN expectation = 'preserve' AND now THEN 'guard-violated' WHEN expectation <> 'must-change' AND now THEN 'divergent'
  WHEN expectation <> 'must-change' THEN 'reuse-confirmed' WHEN now THEN CASE WHEN present THEN 'matched' ELSE 'divergent' END WHEN likelihood = 'required' THEN 'missing' END AS finding FROM p
  UNION ALL SELECT NULL, NULL, path, 'unexpected' FROM i WHERE now AND path IS NOT NULL AND path NOT IN (SELECT path FROM p WHERE path IS NOT NULL))"""


def _findings(spark, d):
    both = _snapshots(spark, d).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"), "was", "now")
    pick = lambda x, *names: F.element_at(F.array(*(F.lit(n) for n in names)), (x + 1).cast("int"))
    path = F.when(F.col("s") % 10 != 9, F.concat(F.lit("c"), "c", F.lit("/s"), "s"))
    impacts = both.select(
        F.col("c").alias("requirement"), F.col("s").alias("id"), path.alias("path"), pick((F.col("c") + F.col("s")) % 4, "required", "likely", "possible", "excluded").alias("likelihood"),
        pick((F.col("c") * 7 + F.col("s")) % 5, "preserve", "reuse", "verify-only", "must-change", "must-change").alias("expectation"), ((F.col("c") + F.col("s")) % 11 == 0).alias("rejected"), (F.col("s") % 3 != 0).alias("present"), "was", "now",
    )
    changes = impacts.filter("now and path is not null").select("path")
    return R.compared(impacts.filter("was"), changes)


@query(_PLAN + " SELECT c AS requirement, s AS id, path, finding FROM f WHERE finding IS NOT NULL", lift=False)
def compare_implementation(spark, d):
    return _findings(spark, d)


@query(_PLAN + """, k AS (SELECT c, count(*) FILTER (finding IN ('matched', 'reuse-confirmed')) AS good, count(*) FILTER (finding IN ('missing', 'divergent', 'guard-violated')) AS bad, count(*) FILTER (finding = 'unverifiable') AS op FROM f WHERE finding IS NOT NULL AND c IS NOT NULL GROUP BY 1)
SELECT c_custkey AS requirement, CASE WHEN good > 0 AND bad = 0 AND op = 0 THEN 'implemented' WHEN good > 0 THEN 'partially-implemented' WHEN bad > 0 THEN 'not-found' ELSE 'unclear' END AS status FROM customer LEFT JOIN k ON c = c_custkey""", lift=False)
def requirement_coverage(spark, d):
    return R.coverage_status(_findings(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("requirement")))


_REVIEWS = _PLAN + ", g AS (SELECT f.*, c % 10 AS review, (c + s) % 13 = 0 AS accepted FROM f WHERE finding IS NOT NULL AND c IS NOT NULL)"


def _reviews(spark, d):
    rows = _findings(spark, d).filter("requirement is not null")
    return rows.select("*", (F.col("requirement") % 10).alias("review"), ((F.col("requirement") + F.col("id")) % 13 == 0).alias("accepted"))


@query(_REVIEWS + """ SELECT review, count(*) FILTER (finding = 'matched') AS matched, count(*) FILTER (finding = 'missing') AS missing, count(*) FILTER (finding = 'unexpected') AS unexpected, count(*) FILTER (finding = 'divergent') AS divergent,
count(*) FILTER (finding = 'guard-violated') AS guard_violated, count(*) FILTER (finding = 'reuse-confirmed') AS reuse_confirmed, count(*) FILTER (finding = 'unverifiable') AS unverifiable, count(*) FILTER (accepted) AS accepted,
count(*) FILTER (NOT accepted AND finding IN ('missing', 'guard-violated', 'divergent', 'unexpected')) AS unanswered, CASE WHEN count(*) FILTER (NOT accepted AND finding IN ('missing', 'guard-violated', 'divergent', 'unexpected')) > 0 THEN 'NEEDS_ATTENTION' ELSE 'PASS' END AS status FROM g GROUP BY 1""", lift=False)
def review_verdict(spark, d):
    return R.verdicts(_reviews(spark, d), "review")


@query(_REVIEWS + " SELECT review, requirement, id, finding FROM (SELECT review, c AS requirement, s AS id, finding, row_number() OVER (PARTITION BY review ORDER BY CASE finding WHEN 'missing' THEN 0 WHEN 'guard-violated' THEN 1 WHEN 'divergent' THEN 2 ELSE 3 END, s, c) AS p FROM g WHERE NOT accepted AND finding IN ('missing', 'guard-violated', 'divergent', 'unexpected')) WHERE p <= 5", lift=False)
def review_deciding(spark, d):
    rows = _reviews(spark, d).withColumn("key", F.struct(F.col("id").alias("s"), F.col("requirement").alias("c")))
    return R.deciding(rows.drop("id").withColumnRenamed("key", "id"), "review").select("review", "requirement", F.col("id.s").alias("id"), "finding")


_DRIFT = """WITH b AS (SELECT DISTINCT o_custkey AS x, l_suppkey AS y, o_orderdate < DATE '1998-01-01' AS old FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey AND (o_custkey + l_suppkey) % 3 = 0),
n AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 7000 THEN n_regionkey END AS ctx, c_nationkey % 2 AS repo, c_custkey % 17 <> 0 AS in_old, c_custkey % 19 <> 0 AS in_new FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT x, y FROM b WHERE old UNION SELECT y, x FROM b WHERE NOT old AND (x * y) % 5 = 0), w AS (SELECT x, y FROM b WHERE NOT old UNION SELECT y, x FROM b WHERE old AND (x * y) % 7 = 0),
a AS (SELECT x, y, 'added' AS direction FROM w EXCEPT SELECT x, y, 'added' FROM o), r AS (SELECT x, y, 'removed' AS direction FROM o EXCEPT SELECT x, y, 'removed' FROM w), ch AS (FROM a UNION ALL FROM r)
SELECT x AS source_id, y AS target_id, direction, CASE WHEN s.ctx <> t.ctx THEN 'cross-context' WHEN s.repo <> t.repo THEN 'cross-repository'
WHEN (direction = 'added' AND EXISTS (FROM r WHERE r.x = ch.y AND r.y = ch.x)) OR (direction = 'removed' AND EXISTS (FROM a WHERE a.x = ch.y AND a.y = ch.x)) THEN 'direction-reversal'
WHEN direction = 'added' AND s.in_old AND t.in_old THEN 'new-dependency' WHEN direction = 'removed' AND s.in_new AND t.in_new THEN 'removed-dependency' ELSE 'other' END AS category
FROM ch JOIN n s ON s.id = x JOIN n t ON t.id = y WHERE CASE direction WHEN 'added' THEN s.in_new AND t.in_new ELSE s.in_old AND t.in_old END"""


@query(_DRIFT, lift=False)
def drift_classification(spark, d):
    """Drift among customers: the supplier's key taken as another customer's, some edges turned around, some nodes in one snapshot only."""
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("o_custkey <> l_suppkey and (o_custkey + l_suppkey) % 3 = 0")
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    rows = both.select(F.col("o_custkey").alias("x"), F.col("l_suppkey").alias("y"), old.alias("old"))
    edge = lambda df, a, b: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit("USES").alias("type"))
    approved = edge(rows.filter("old"), "x", "y").unionByName(edge(rows.filter("not old and (x * y) % 5 = 0"), "y", "x"))
    current = edge(rows.filter("not old"), "x", "y").unionByName(edge(rows.filter("old and (x * y) % 7 = 0"), "y", "x"))
    held = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 7000, F.col("n_regionkey")).alias("context"), (F.col("c_nationkey") % 2).alias("repository"))
    return R.drift(approved, current, held.filter("id % 17 <> 0"), held.filter("id % 19 <> 0")).drop("type")


@query("""WITH t AS (SELECT DISTINCT l_suppkey, c_nationkey % 5 AS context, o_orderdate < DATE '1996-06-01' AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey % 7 = 0)
SELECT l_suppkey, context FROM t WHERE NOT early EXCEPT SELECT l_suppkey, context FROM t WHERE early""", lift=False)
def unmapped_contexts(spark, d):
    """Contexts that changes touched since, but the prediction of the first months did not."""
    both = table(spark, d, "lineitem").filter("l_partkey % 7 = 0").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select("l_suppkey", (F.col("c_nationkey") % 5).alias("context"), (F.col("o_orderdate") < F.lit("1996-06-01").cast("date")).alias("early"))
    return rows.filter("not early").select("l_suppkey", "context").distinct().join(rows.filter("early").select("l_suppkey", "context"), ["l_suppkey", "context"], "left_anti")


@query("""WITH l AS (SELECT *, CASE WHEN event_type = 'purchase' AND value > 99 THEN 1 WHEN event_type = 'signup' AND value > 95 THEN 2 WHEN event_type = 'error' AND value > 90 THEN 3 WHEN event_type = 'click' AND value > 80 THEN 4 WHEN event_type = 'view' AND value > 60 THEN 5 ELSE 6 END AS rank FROM events)
SELECT user_id, event_id AS value, rank, ['human-confirmed', 'agent-approved', 'repo-metadata', 'deterministic-detection', 'ai-inferred', 'defaults'][rank] AS level, CASE rank WHEN 1 THEN 'human-confirmed' WHEN 2 THEN 'llm-inferred' WHEN 5 THEN 'llm-inferred' WHEN 3 THEN 'configuration' ELSE 'framework-convention' END AS provenance
FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, event_id DESC) = 1""", lift=False)
def overlay_effective(spark, d):
    rules = (("purchase", 99), ("signup", 95), ("error", 90), ("click", 80), ("view", 60))
    level = F.lit("defaults")
    for (kind, most), name in reversed(list(zip(rules, R.LEVELS, strict=False))):
        level = F.when((F.col("event_type") == kind) & (F.col("value") > most), name).otherwise(level)
    rows = table(spark, d, "events").select("user_id", "event_id", level.alias("level"))
    return R.effective_level(rows.withColumn("value", F.col("event_id")), "user_id", "level", "event_id", "value")


@query("""+ e AS (SELECT id, source_id, target_id, CASE WHEN right(source_id, 1) = '3' THEN 'confirmed' WHEN right(target_id, 1) = '7' THEN 'rejected' END AS decision FROM edges WHERE type = 'CALLS')
SELECT source_id, count(*) AS total, count(*) FILTER (decision = 'confirmed') AS confirmed, count(*) FILTER (decision IS DISTINCT FROM 'rejected') AS effective FROM e GROUP BY 1""")
def relationship_overlay(spark, d):
    """Edges with people's decisions laid over them; rejected ones don't count."""
    calls = edges(spark, d, ("CALLS",))
    decided = calls.select("id", F.when(F.col("source_id").endswith("3"), "confirmed").when(F.col("target_id").endswith("7"), "rejected").alias("decision")).filter("decision is not null")
    rows = calls.join(decided, "id", "left")
    return rows.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "confirmed").alias("confirmed"), F.count_if(~F.col("decision").eqNullSafe("rejected")).alias("effective"))


@query("+ c AS (SELECT id, CASE WHEN regexp_matches(path, '^parts/Brand#1[^/]*/.*$') THEN 'catalogue' WHEN regexp_matches(path, '^orders/.*$') THEN 'sales' WHEN regexp_matches(path, '^parts/.*$') THEN 'stock' END AS context FROM nodes) SELECT 'BELONGS_TO_CONTEXT:' || id || '->context:' || context AS id, id AS source_id, 'context:' || context AS target_id FROM c WHERE context IS NOT NULL")
def context_graph(spark, d):
    """Membership edges of the configured contexts."""
    rows = M.last_glob(nodes(spark, d), "path", [("parts/**", "stock"), ("orders/**", "sales"), ("parts/Brand#1*/**", "catalogue")], "context").filter("context is not null")
    target = F.concat(F.lit("context:"), "context")
    return rows.select(F.concat(F.lit("BELONGS_TO_CONTEXT:"), "id", F.lit("->"), target).alias("id"), F.col("id").alias("source_id"), target.alias("target_id"))


@query("""WITH c AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 30) AS name FROM supplier), g AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey % 3 = 0)
SELECT name, 'unknown-in-graph' AS finding FROM c WHERE name NOT IN (FROM g) UNION ALL SELECT name, 'not-configured' FROM g WHERE name NOT IN (FROM c)""", lift=False)
def config_drift(spark, d):
    """Names that the configuration has and the graph lacks, and the other way around."""
    told = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), 1 + F.col("s_suppkey") % 30).alias("name")).distinct()
    found = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("name")).distinct()
    gone, new = told.join(found, "name", "left_anti"), found.join(told, "name", "left_anti")
    return gone.select("name", F.lit("unknown-in-graph").alias("finding")).unionByName(new.select("name", F.lit("not-configured").alias("finding")))


@query("""WITH u AS (SELECT user_id, max(event_id) FILTER (event_type = 'click' AND value < 20) AS ix, max(event_id) FILTER (event_type = 'click') AS hd, max(event_id) AS last, arg_max(event_type, event_id) AS kind, count(*) FILTER (event_type = 'signup') AS spec, count(*) FILTER (event_type = 'purchase') AS latest,
  max(ts) FILTER (event_type = 'click' AND value < 20) AS made, (SELECT max(ts) FROM events) AS latest_ts FROM events WHERE user_id % 9 <> 4 OR event_type <> 'click' GROUP BY 1),
r AS (SELECT user_id, CASE WHEN ix IS NULL THEN ['not-indexed'] ELSE list_filter([CASE WHEN hd <> ix THEN 'behind-head' END, CASE WHEN kind = 'error' THEN 'working-tree-modified' END, CASE WHEN latest > spec THEN 'specification-moved' END, CASE WHEN epoch_us(latest_ts) - epoch_us(made) > 86400000000 THEN 'aged' END], lambda x: x IS NOT NULL) END AS reasons FROM u)
SELECT user_id, coalesce(reasons[1], 'current') AS state, array_to_string(reasons, ',') AS reasons FROM r""", lift=False)
def freshness_states(spark, d):
    events = table(spark, d, "events").filter("user_id % 9 <> 4 or event_type <> 'click'")
    when = lambda c, x: F.max(F.when(F.expr(c), F.col(x)))
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    rows = events.groupBy("user_id").agg(
        when("event_type = 'click' and value < 20", "event_id").alias("indexed_sha"), when("event_type = 'click'", "event_id").alias("head_sha"), (F.max_by("event_type", "event_id") == "error").alias("dirty"),
        F.count_if(F.col("event_type") == "signup").alias("spec"), F.count_if(F.col("event_type") == "purchase").alias("latest_spec"), when("event_type = 'click' and value < 20", "ts").alias("at"),
    ).crossJoin(F.broadcast(now))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return R.freshness(rows.withColumn("hours", (micros("now") - micros("at")) / 3_600_000_000)).select("user_id", "state", F.array_join("reasons", ",").alias("reasons"))


_READY = "WITH k AS (SELECT c_custkey, count(o_orderkey) AS requirements, count(*) FILTER (o_orderstatus = 'O') AS unmatched, count(*) FILTER (o_orderpriority = '1-URGENT') AS blocking, count(*) FILTER (o_orderpriority = '2-HIGH') AS important, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS minor FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_custkey % 8 <> 5 GROUP BY 1)"


def _questions(spark, d):
    orders = table(spark, d, "orders").filter("o_custkey % 8 <> 5")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("requirements"), F.count_if(F.col("o_orderstatus") == "O").alias("unmatched"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("blocking"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("important"), F.count_if(F.col("o_orderpriority") == "3-MEDIUM").alias("minor"),
    )
    return table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").fillna(0)


@query(_READY + " SELECT c_custkey, CASE WHEN requirements = 0 THEN 0 ELSE greatest(5, 100 - 25 * blocking - 7 * important - 2 * minor - floor(50.0 * unmatched / requirements + 0.5)) END::BIGINT AS readiness FROM k", lift=False)
def readiness_score(spark, d):
    return R.readiness(_questions(spark, d)).select("c_custkey", "readiness")


@query(_READY + """, r AS (SELECT *, CASE WHEN requirements = 0 THEN 0 ELSE greatest(5, 100 - 25 * blocking - 7 * important - 2 * minor - floor(50.0 * unmatched / requirements + 0.5)) END::BIGINT AS score FROM k),
v AS (SELECT c_custkey, score, CASE WHEN blocking > 3 THEN 'BLOCKED' WHEN 2 * unmatched >= requirements THEN 'INSUFFICIENT_COVERAGE' WHEN minor % 3 > 0 THEN 'NEEDS_VERIFICATION' WHEN important > 1 THEN 'NEEDS_CLARIFICATION' WHEN minor > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS feasibility FROM r)
SELECT c_custkey, feasibility, CASE feasibility WHEN 'INSUFFICIENT_COVERAGE' THEN NULL WHEN 'BLOCKED' THEN least(score, 20) WHEN 'NEEDS_CLARIFICATION' THEN least(score, 60) WHEN 'NEEDS_VERIFICATION' THEN least(score, 70) ELSE score END AS capped_score FROM v""", lift=False)
def plan_feasibility(spark, d):
    rows = R.readiness(_questions(spark, d)).withColumnRenamed("readiness", "score")
    counts = rows.select("c_custkey", "score", F.greatest(F.lit(0), F.col("blocking") - 3).alias("blocking"), (2 * F.col("unmatched") >= F.col("requirements")).alias("insufficient"), (F.col("minor") % 3).alias("unverified"), F.greatest(F.lit(0), F.col("important") - 1).alias("questions"), (F.col("minor") + F.col("minor") % 3).alias("warnings"))
    return R.feasibility(counts).select("c_custkey", "feasibility", "capped_score")


@query("""WITH k AS (SELECT c_nationkey, count(*) AS requirements, count(*) FILTER (c_acctbal < 0) AS unmatched, count(*) FILTER (c_acctbal < -900) AS explained, count(*) FILTER (c_custkey % 2 = 0) AS concepts, count(*) FILTER (c_acctbal < 2000) AS unresolved, count(*) FILTER (c_custkey % 40 = 1) AS missing FROM customer GROUP BY 1)
SELECT c_nationkey, ((2 * (unmatched - least(explained, unmatched)) >= requirements)::INT + (concepts > 0 AND unresolved >= concepts)::INT + (missing > 0 AND unmatched > 0)::INT)::BIGINT AS n_reasons,
CASE WHEN 2 * (unmatched - least(explained, unmatched)) >= requirements OR (concepts > 0 AND unresolved >= concepts) OR (missing > 0 AND unmatched > 0) THEN 'insufficient-coverage' ELSE 'adequate' END AS status FROM k""", lift=False)
def coverage_sufficiency(spark, d):
    n = lambda c: F.count_if(F.expr(c))
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("requirements"), n("c_acctbal < 0").alias("unmatched"), n("c_acctbal < -900").alias("explained"), n("c_custkey % 2 = 0").alias("concepts"), n("c_acctbal < 2000").alias("unresolved"), n("c_custkey % 40 = 1").alias("missing"))
    return R.sufficiency(counts).select("c_nationkey", "n_reasons", "status")


_MESSAGES = {"error": "Parse error in a file", "click": "could not resolve import of it", "view": "skipped: too large", "signup": "no language adapter for it", "purchase": "something else"}


@query("""WITH w AS (SELECT *, CASE event_type WHEN 'error' THEN 'parse-failure' WHEN 'click' THEN 'unresolved-import' WHEN 'view' THEN 'ignored-file' WHEN 'signup' THEN 'no-adapter' ELSE 'other' END AS category FROM events),
p AS (SELECT category, user_id, min(event_id) AS first FROM w GROUP BY ALL), e AS (SELECT category, string_agg(user_id::VARCHAR, ',' ORDER BY first) AS examples FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY first) <= 5) GROUP BY 1)
SELECT category, count(*) AS n, any_value(examples) AS examples, min(event_id) AS first_event, bool_or(user_id % 50 = 7) AS affects FROM w JOIN e USING (category) GROUP BY 1""", lift=False)
def warning_categories(spark, d):
    """Warnings by the first rule that their message fits, with the first five paths of each, and whether they touch what was predicted."""
    text = F.create_map(*(F.lit(x) for kv in _MESSAGES.items() for x in kv))[F.col("event_type")]
    rows = table(spark, d, "events").select("event_id", "user_id", S.first_of(text, R.WARNINGS, "other").alias("category"))
    first = rows.groupBy("category", "user_id").agg(F.min("event_id").alias("first"))
    five = first.withColumn("p", F.row_number().over(W.partitionBy("category").orderBy("first"))).filter("p <= 5").groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "user_id"))), lambda x: x["user_id"].cast("string")), ",").alias("examples"))
    counts = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.bool_or(F.col("user_id") % 50 == 7).alias("affects"))
    return counts.join(five, "category")


@query("""WITH x AS (SELECT source, quality, n_chars >= 400 AS said, row_number() OVER (PARTITION BY source, n_chars >= 400 ORDER BY n_chars DESC, doc_id) AS rank FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) FILTER (said AND quality = 1) AS tp, count(*) FILTER (said AND quality = 0) AS fp, count(*) FILTER (NOT said AND quality = 1) AS fn, floor(100.0 * avg(1.0::DOUBLE / rank) FILTER (said AND quality = 1) + 0.5) / 100 AS mrr FROM x GROUP BY 1""", lift=False)
def mrr(spark, d):
    """Mean reciprocal rank of the right ones among what was said, by source; null if none was found."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("doc_id", "source", "quality", (-F.col("n_chars")).alias("short"), (F.col("n_chars") >= 400).alias("said"))
    ranked = K.numbered_by(rows.filter("said"), "source", ["short", "doc_id"], "rank").groupBy("source").agg(F.avg(F.when(F.col("quality") == 1, 1.0 / F.col("rank"))).alias("m"))
    n = lambda c: F.count_if(F.expr(c))
    counts = rows.groupBy("source").agg(n("said and quality = 1").alias("tp"), n("said and quality = 0").alias("fp"), n("not said and quality = 1").alias("fn"))
    return counts.join(ranked, "source", "left").select("source", "tp", "fp", "fn", (F.floor(F.col("m") * 100 + 0.5) / 100).alias("mrr"))


_OUT = """WITH x AS (SELECT source, lang, quality = 1 AS truth, n_chars >= 400 AS said FROM labels JOIN documents USING (doc_id)),
o AS (SELECT source, lang, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM x GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN floor(100.0 * tp / (tp + fp) + 0.5) / 100 END AS precision, CASE WHEN tp + fn > 0 THEN floor(100.0 * tp / (tp + fn) + 0.5) / 100 END AS recall FROM o)"""


def _outcomes(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").select("source", "lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") >= 400).alias("said"))
    n = lambda c: F.count_if(F.expr(c))
    counts = rows.groupBy("source", "lang").agg(n("truth and said").alias("tp"), n("said and not truth").alias("fp"), n("truth and not said").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.floor(a * 100.0 / b + 0.5) / 100)
    return counts.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


@query(_OUT + " SELECT lang, count(*) AS outcomes, count(precision) AS sample, floor(100 * (sum((precision * 100)::BIGINT)::DOUBLE / 100 / count(precision)) + 0.5) / 100 AS mean_precision, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(precision) >= 10 AND floor(100 * (sum((precision * 100)::BIGINT)::DOUBLE / 100 / count(precision)) + 0.5) / 100 < 0.6 AS trigger FROM r GROUP BY 1", lift=False)
def outcome_aggregate(spark, d):
    mean = F.floor(100 * (F.sum(F.round(F.col("precision") * 100).cast("long")).cast("double") / 100 / F.count("precision")) + 0.5) / 100
    out = _outcomes(spark, d).groupBy("lang").agg(F.count("*").alias("outcomes"), F.count("precision").alias("sample"), mean.alias("mean_precision"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return out.withColumn("trigger", (F.col("sample") >= 10) & (F.col("mean_precision") < 0.6))


@query(_OUT + " SELECT lang, source, fp FROM r WHERE fp > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY fp DESC, source) <= 3", lift=False)
def outcome_top_misses(spark, d):
    return G.top_per(_outcomes(spark, d).filter("fp > 0"), ["lang"], [F.desc("fp"), F.col("source")], 3).select("lang", "source", "fp")


@query("""WITH x AS (SELECT source, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)) SELECT source, count(*) FILTER (n_chars < 400) AS possible,
CASE WHEN count(*) FILTER (n_chars < 400) > 0 THEN floor(100.0 * count(*) FILTER (n_chars < 400 AND quality = 1 AND toxic = 0) / count(*) FILTER (n_chars < 400) + 0.5) / 100 END AS strict,
CASE WHEN count(*) FILTER (n_chars < 400) > 0 THEN floor(100.0 * count(*) FILTER (n_chars < 400 AND quality = 1) / count(*) FILTER (n_chars < 400) + 0.5) / 100 END AS inclusive,
CASE WHEN count(*) FILTER (n_chars < 400) > 0 THEN floor(50.0 * (2 * count(*) FILTER (n_chars < 400 AND quality = 1 AND toxic = 0) + count(*) FILTER (n_chars < 400 AND quality = 1 AND toxic = 1)) / count(*) FILTER (n_chars < 400) + 0.5) / 100 END AS weighted,
count(*) FILTER (n_chars >= 400 AND toxic = 1) AS forbidden_hits FROM x GROUP BY 1""", lift=False)
def sample_evaluation(spark, d):
    """Possible-tier precision by source: allowed, plausible at half weight, unsupported; and hits on what was forbidden."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    n = lambda c: F.count_if(F.expr(c))
    counts = rows.groupBy("source").agg(n("n_chars < 400").alias("possible"), n("n_chars < 400 and quality = 1 and toxic = 0").alias("a"), n("n_chars < 400 and quality = 1").alias("b"), n("n_chars >= 400 and toxic = 1").alias("forbidden_hits"))
    share = lambda x: F.when(F.col("possible") > 0, F.floor(x / F.col("possible") + 0.5) / 100)
    return counts.select("source", "possible", share(F.col("a") * 100.0).alias("strict"), share(F.col("b") * 100.0).alias("inclusive"), share((F.col("a") + F.col("b")) * 50.0).alias("weighted"), "forbidden_hits")


@query("""WITH i AS (SELECT o_custkey AS requirement, l_suppkey AS id, (l_discount * 100)::BIGINT AS confidence, l_orderkey * 100 + l_linenumber AS at, CASE WHEN l_tax > 0.05 THEN 'required' ELSE 'likely' END AS likelihood FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT requirement, id, max(confidence) AS confidence, count(*) AS n FROM i GROUP BY ALL) SELECT * FROM k""", lift=False)
def keep_strongest(spark, d):
    """The strongest impact of each requirement on each node, and how many there were."""
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.col("o_custkey").alias("requirement"), F.col("l_suppkey").alias("id"), F.round(F.col("l_discount") * 100).cast("long").alias("confidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    best = R.keep_strongest(rows, ["requirement", "id"], "confidence", "at").drop("at")
    return best.join(G.count_by(rows, "requirement", "id"), ["requirement", "id"])


@query("""WITH i AS (SELECT DISTINCT o_custkey AS requirement, l_suppkey AS id, 10 + (o_custkey * 31 + l_suppkey * 17) % 80 AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT id, count(*) AS requirements, arg_min(requirement, {'c': -confidence, 'r': requirement}) AS best, max(confidence) AS confidence FROM i GROUP BY 1""", lift=False)
def impacts_by_node(spark, d):
    """Per node the strongest impact and the number of requirements that have it."""
    rows = _snapshots(spark, d).select(F.col("o_custkey").alias("requirement"), F.col("l_suppkey").alias("id"), (10 + (F.col("o_custkey") * 31 + F.col("l_suppkey") * 17) % 80).alias("confidence"))
    return rows.groupBy("id").agg(F.count("*").alias("requirements"), F.min_by("requirement", F.struct(-F.col("confidence"), "requirement")).alias("best"), F.max("confidence").alias("confidence"))


@query(_PLAN + " SELECT c, s, CASE WHEN s % 6 = 1 AND likelihood <> 'required' THEN 'excluded' ELSE likelihood END AS likelihood, CASE WHEN s % 6 = 1 THEN CASE WHEN likelihood = 'required' THEN 'non-goal-contradiction' ELSE 'non-goal-exclusion' END END AS warning FROM i WHERE was", lift=False)
def non_goal_exclusion(spark, d):
    pick = F.element_at(F.array(*(F.lit(n) for n in ("required", "likely", "possible", "excluded"))), ((F.col("o_custkey") + F.col("l_suppkey")) % 4 + 1).cast("int"))
    rows = _snapshots(spark, d).filter("was").select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("id"), pick.alias("likelihood"))
    return R.excluded(rows, table(spark, d, "supplier").filter("s_suppkey % 6 = 1").select(F.col("s_suppkey").alias("id"))).withColumnRenamed("id", "s")


@query("+ a AS (SELECT target_id AS id FROM edges WHERE type = 'CALLS' AND source_id = 'customer:3'), b AS (SELECT target_id AS id FROM edges WHERE type = 'CALLS' AND source_id = 'customer:7'), x AS ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)) SELECT count(*) AS divergent, CASE WHEN count(*) > 0 THEN 'blocking' END AS severity FROM x")
def interpretation_divergence(spark, d):
    """Two readings of a requirement: what only one of their footprints holds."""
    calls, every = edges(spark, d, ("CALLS",)), nodes(spark, d)
    side = lambda anchor: every.join(calls.filter(F.col("source_id") == anchor).select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").select("id", "category")
    return R.divergence(side("customer:3"), side("customer:7"))


@query("SELECT user_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN count(*) ELSE 1 END AS n, min(event_id) AS id FROM events GROUP BY user_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE event_id + 1 END", lift=False)
def caveat_collapse(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("event_type").isin("view", "click").alias("caveat"))
    return R.collapsed(rows, ["user_id", "event_type"])


@query("""WITH h AS (SELECT n_nationkey, r_name || '/' || n_name AS home FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT o_orderkey AS requirement, ['http', 'event', 'import', 'configuration', 'direct-data-access'][1 + o_orderkey % 5] AS mechanism, CASE WHEN o_orderkey % 7 <> 0 THEN home || '/' || c_name END AS source_path, c_name AS source_ref, CASE WHEN o_orderkey % 3 <> 0 THEN home || '/x' END AS target_path, 60 + o_orderkey % 40 AS confidence FROM orders JOIN customer ON o_custkey = c_custkey JOIN h ON c_nationkey = n_nationkey),
c AS (SELECT * FROM (VALUES ('no-peer-http', 'forbidden-runtime-call', (SELECT min(r_name) FROM region) || '/', NULL, true), ('layers', 'boundary-restriction', '', (SELECT max(r_name) FROM region) || '/', false), ('no-import', 'forbidden-dependency', '', NULL, true), ('needs-config', 'required-config', 'customer#00000000', NULL, true)) t(name, kind, scope, allowed, authority)),
m AS (SELECT * FROM (VALUES ('http', 'forbidden-runtime-call'), ('http', 'boundary-restriction'), ('event', 'forbidden-runtime-call'), ('import', 'forbidden-dependency'), ('import', 'boundary-restriction'), ('direct-data-access', 'forbidden-runtime-call'), ('direct-data-access', 'boundary-restriction'), ('configuration', 'required-config')) t(mechanism, kind)),
f AS (SELECT p.*, c.name, c.authority, source_path IS NOT NULL AND starts_with(source_path, scope) AS by_path FROM p JOIN m USING (mechanism) JOIN c USING (kind) WHERE (source_path IS NOT NULL AND starts_with(source_path, scope) OR scope = '' OR (length(scope) > 2 AND contains(lower(source_ref), lower(regexp_replace(scope, '/+$', '')))))
  AND NOT (kind = 'boundary-restriction' AND allowed IS NOT NULL AND (target_path IS NULL OR starts_with(target_path, allowed))) AND NOT (name = 'no-import' AND source_ref = 'Customer#000000003'))
SELECT requirement, name AS "constraint", CASE WHEN authority AND by_path AND confidence >= 80 THEN 'blocking' ELSE 'warning' END AS severity, CASE WHEN authority AND by_path AND confidence >= 80 THEN 90 WHEN by_path THEN 70 ELSE 50 END AS confidence FROM f""", lift=False)
def constraint_check(spark, d):
    """Relationships that orders propose, against four constraints with one exemption."""
    t = lambda n: table(spark, d, n)
    home = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("home"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("http", "event", "import", "configuration", "direct-data-access"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    proposed = rows.select(
        F.col("o_orderkey").alias("requirement"), kind.alias("mechanism"), F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws("/", "home", "c_name")).alias("source_path"), F.col("c_name").alias("source_ref"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat("home", F.lit("/x"))).alias("target_path"), (60 + F.col("o_orderkey") % 40).alias("confidence"),
    )
    ends = t("region").agg(F.concat(F.min("r_name"), F.lit("/")).alias("first"), F.concat(F.max("r_name"), F.lit("/")).alias("last"))
    made = [("no-peer-http", "forbidden-runtime-call", F.col("first"), F.lit(None), True), ("layers", "boundary-restriction", F.lit(""), F.col("last"), False), ("no-import", "forbidden-dependency", F.lit(""), F.lit(None), True), ("needs-config", "required-config", F.lit("customer#00000000"), F.lit(None), True)]
    rules = ends.select(F.explode(F.array(*(F.struct(F.lit(n).alias("constraint"), F.lit(k).alias("kind"), s.alias("scope"), F.when(a.isNotNull(), F.array(a.cast("string"))).alias("allowed"), F.lit(x).alias("authority")) for n, k, s, a, x in made))).alias("r")).select("r.*")
    spared = t("customer").filter("c_custkey = 3").select(F.lit("no-import").alias("constraint"), F.col("c_name").alias("subject"))
    return R.constraint_findings(proposed, rules, spared)


@query("""WITH s AS (SELECT p_brand, CASE p_partkey % 12 WHEN 0 THEN 'must migrate its schema' WHEN 1 THEN 'should log every metric of blueBolt' WHEN 2 THEN 'could expose an API for `order line` events' WHEN 3 THEN 'must pass tests within 200 ms' WHEN 10 THEN 'reads DB_PASSWORD from an environment variable' WHEN 11 THEN 'must not change the payload of OrderLine' ELSE 'x' END AS t FROM part WHERE p_size > 40)
SELECT DISTINCT p_brand, unnest(list_filter([CASE WHEN regexp_matches(t, '(?i)\\b(must|should|shall)\\b') THEN 'new-test' END, CASE WHEN regexp_matches(t, '(?i)\\b(column|table|schema|field)\\b') THEN 'new-migration' END, CASE WHEN regexp_matches(t, '(?i)\\b(api|endpoint|payload|schema)\\b') THEN 'new-contract-definition' END, CASE WHEN regexp_matches(t, '(?i)\\b(environment variable)\\b') THEN 'new-configuration-entry' END], lambda x: x IS NOT NULL)) AS category FROM s""", lift=False)
def predicted_artifacts(spark, d):
    rows = _statements(spark, d).join(table(spark, d, "part").filter("p_size > 40").select("p_partkey", "p_brand"), "p_partkey")
    return R.predicted_artifacts(rows, "p_brand", "s")


@query("""WITH b AS (SELECT l_suppkey, l_partkey, max(l_returnflag) AS sig FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), a AS (SELECT l_suppkey, l_partkey, max(l_returnflag) AS sig FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT l_suppkey, l_partkey, CASE WHEN b.sig IS NULL THEN 'added' WHEN a.sig IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (l_suppkey, l_partkey) WHERE b.sig IS DISTINCT FROM a.sig""", lift=False)
def symbol_diff(spark, d):
    facts = lambda status: table(spark, d, "lineitem").filter(F.col("l_linestatus") == status).groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("signature"))
    return R.symbol_changes(facts("F"), facts("O"), ["l_suppkey", "l_partkey"], "signature")


@query("""WITH s AS (SELECT c_nationkey, bool_or(c_acctbal < -990) AS stale, count(*) FILTER (c_custkey % 60 = 1) AS unindexed, count(*) FILTER (c_acctbal < 0) * 9 > count(*) AS short FROM customer GROUP BY 1)
SELECT c_nationkey, unnest(list_filter([CASE WHEN stale THEN 'refresh-stale-index' END, CASE WHEN unindexed > 0 THEN 'index-registered-repositories' END, CASE WHEN short AND unindexed = 0 THEN 'report-limited-scope' END], lambda x: x IS NOT NULL)) AS action FROM s""", lift=False)
def required_actions(spark, d):
    """What is to be done next, from freshness and coverage."""
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(F.bool_or(F.col("c_acctbal") < -990).alias("stale"), F.count_if(F.col("c_custkey") % 60 == 1).alias("unindexed"), (F.count_if(F.col("c_acctbal") < 0) * 9 > F.count("*")).alias("short"))
    acts = F.array(F.when(F.col("stale"), "refresh-stale-index"), F.when(F.col("unindexed") > 0, "index-registered-repositories"), F.when(F.col("short") & (F.col("unindexed") == 0), "report-limited-scope"))
    return s.select("c_nationkey", F.explode(F.filter(acts, lambda x: x.isNotNull())).alias("action"))


@query("SELECT user_id, count(*) + 1 AS version, max(event_id) AS last_mutation, arg_max(CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'proposed' END, event_id) AS status FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1", lift=False)
def specification_versions(spark, d):
    """The version that each mutation in turn made, and the status of the last."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error", "signup"))
    status = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("proposed")
    return rows.groupBy("user_id").agg((F.count("*") + 1).alias("version"), F.max("event_id").alias("last_mutation"), F.max_by(status, "event_id").alias("status"))


@query(_PLAN + " SELECT c AS requirement, s AS id, finding FROM f WHERE finding IN ('missing', 'divergent', 'guard-violated') AND (c + s) % 13 <> 0", lift=False)
def open_deviations(spark, d):
    """Discrepancies that no accepted deviation (requirement, node) answers."""
    rows = _findings(spark, d).filter(F.col("finding").isin("missing", "divergent", "guard-violated"))
    accepted = _snapshots(spark, d).filter((F.col("o_custkey") + F.col("l_suppkey")) % 13 == 0).select(F.col("o_custkey").alias("requirement"), F.col("l_suppkey").alias("id"))
    return rows.join(accepted, ["requirement", "id"], "left_anti").select("requirement", "id", "finding")


@query(_PLAN + """ SELECT c AS requirement, '{"requirement":' || c || ',"node":' || s || ',"likelihood":"' || likelihood || '"}' AS payload FROM i WHERE was AND likelihood IN ('required', 'likely') AND c % 5 <> 2""", lift=False)
def context_export(spark, d):
    """The impacts of approved analyses as JSON records for an implementer."""
    pick = F.element_at(F.array(*(F.lit(n) for n in ("required", "likely", "possible", "excluded"))), ((F.col("o_custkey") + F.col("l_suppkey")) % 4 + 1).cast("int"))
    rows = _snapshots(spark, d).filter("was and o_custkey % 5 <> 2").select(F.col("o_custkey").alias("requirement"), F.col("l_suppkey").alias("node"), pick.alias("likelihood")).filter(F.col("likelihood").isin("required", "likely"))
    return rows.select("requirement", F.to_json(F.struct("requirement", "node", "likelihood")).alias("payload"))
