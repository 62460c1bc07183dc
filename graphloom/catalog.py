"""All registered queries of the graph engine, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import graph as G
from graphloom.operators.impact import after_cursor
from graphloom.plans.lift import LIFT_SQL, edges, edges_of, nodes, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CUT = "1998-01-01"


def query(sql: str, lift: bool = True):
    """Register the function under its name, with DuckDB SQL; ``lift`` puts the graph's common tables in front."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {LIFT_SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.replace('+', '', 1) if sql.lstrip().startswith('+') else sql}" if lift else sql
        return f

    return add


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_counts_by_type(spark, d):
    return G.count_by(nodes(spark, d), "type")


@query("SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_counts_by_type(spark, d):
    return G.count_by(edges(spark, d), "type")


@query("SELECT id, name, path FROM nodes WHERE category = 'integration' AND contains(lower(name), '1')")
def find_nodes_filter(spark, d):
    return G.find_nodes(nodes(spark, d), category="integration", name_part="1").select("id", "name", "path")


@query("SELECT provenance, category, count(*) AS n FROM (SELECT *, CASE WHEN id LIKE '%7' THEN 'llm-inferred' WHEN id LIKE '%8' THEN 'human-confirmed' ELSE provenance END AS p FROM nodes) WHERE p NOT IN ('llm-inferred') GROUP BY ALL")
def knowledge_category_filter(spark, d):
    """Nodes of deterministic or human knowledge; some are marked as inferred or confirmed."""
    marked = F.when(F.col("id").endswith("7"), "llm-inferred").when(F.col("id").endswith("8"), "human-confirmed").otherwise(F.col("provenance"))
    kept = G.of_knowledge(nodes(spark, d).withColumn("p", marked), "p", ("deterministic", "human-confirmed"))
    return G.count_by(kept, "provenance", "category")


@query("SELECT id, 'source_id' AS missing FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE category <> 'domain') UNION ALL SELECT id, 'target_id' FROM edges WHERE target_id NOT IN (SELECT id FROM nodes WHERE category <> 'domain')")
def referential_check(spark, d):
    return G.dangling(edges(spark, d), nodes(spark, d).filter("category <> 'domain'"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", lift=False)
def duplicate_ids(spark, d):
    return G.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT id, type, source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE category IN ('application', 'integration')) AND target_id IN (SELECT id FROM nodes WHERE category IN ('application', 'integration'))")
def induced_subgraph(spark, d):
    return G.induced(edges(spark, d), nodes(spark, d).filter(F.col("category").isin("application", "integration")))


@query("""SELECT source_id AS id, target_id AS neighbour, 'out' AS dir, type AS edge_type FROM edges WHERE source_id IN ('nation:1', 'customer:7')
UNION ALL SELECT target_id, source_id, 'in', type FROM edges WHERE target_id IN ('nation:1', 'customer:7')""")
def neighbours_both(spark, d):
    return G.neighbours(edges(spark, d), nodes(spark, d).filter(F.col("id").isin("nation:1", "customer:7")))


_WALK = "+ s AS (SELECT source_id a, target_id b FROM edges WHERE type IN ('CONTAINS', 'CALLS') UNION SELECT target_id, source_id FROM edges WHERE type IN ('CONTAINS', 'CALLS')), w AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN s ON a = id WHERE depth < {}) SELECT id, min(depth) AS depth FROM w GROUP BY id"


@query(_WALK.format(3))
def shortest_path_levels(spark, d):
    return G.distances(edges(spark, d, ("CONTAINS", "CALLS")), nodes(spark, d).filter("id = 'region:0'"), 3)


@query(_WALK.format(2))
def subgraph_depth2(spark, d):
    return G.distances(edges(spark, d, ("CONTAINS", "CALLS")), nodes(spark, d).filter("id = 'region:0'"), 2)


@query("+ w AS (SELECT id, 0 AS depth FROM nodes WHERE type = 'workspace' UNION SELECT target_id, depth + 1 FROM w JOIN edges e ON source_id = w.id AND e.type = 'CONTAINS') SELECT id, depth FROM w")
def containment_closure(spark, d):
    return G.distances(edges(spark, d, ("CONTAINS",)), nodes(spark, d).filter("type = 'workspace'"), 8, directed=True)


@query("SELECT n.id, 'nation:' || h.n_nationkey AS owner FROM nodes n LEFT JOIN home h ON n.path = h.home OR starts_with(n.path, h.home || '/')")
def owning_repository(spark, d):
    every = nodes(spark, d)
    return G.longest_prefix(every.select("id", "path"), "path", every.filter("type = 'package'")).select("id", "owner")


@query("""+ o AS (SELECT 'customer:' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier)
SELECT 'nation:' || a.k AS source_owner, 'nation:' || b.k AS target_owner, count(*) AS n FROM edges JOIN o a ON source_id = a.id JOIN o b ON target_id = b.id WHERE type = 'CALLS' AND a.k <> b.k GROUP BY ALL""")
def cross_repository_edges(spark, d):
    held = edges_of(spark, d, "CONTAINS").filter(F.col("source_id").startswith("nation:"))
    side = lambda end, owner: held.select(F.col("target_id").alias(end), F.col("source_id").alias(owner))
    pairs = edges_of(spark, d, "CALLS").join(side("source_id", "source_owner"), "source_id").join(side("target_id", "target_owner"), "target_id")
    return G.count_by(pairs.filter("source_owner <> target_owner"), "source_owner", "target_owner")


@query("SELECT 'nation:' || n_nationkey AS owner, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS services, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS third_parties FROM nation", lift=False)
def repository_breakdown(spark, d):
    held = edges_of(spark, d, "CONTAINS").filter(F.col("source_id").startswith("nation:")).groupBy(F.col("source_id").alias("owner"))
    counts = held.agg(F.count_if(F.col("target_id").startswith("customer:")).alias("services"), F.count_if(F.col("target_id").startswith("supplier:")).alias("third_parties"))
    roster = nodes(spark, d).filter("type = 'package'").select(F.col("id").alias("owner"))
    return roster.join(counts, "owner", "left").fillna(0)


@query("SELECT source_id AS id, target_id AS reference, rank FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS rank FROM edges WHERE type = 'CALLS') WHERE rank <= 5")
def references_callees(spark, d):
    return G.top_per(edges_of(spark, d, "CALLS"), ["source_id"], [F.col("target_id")], 5).select(F.col("source_id").alias("id"), F.col("target_id").alias("reference"), F.col("rank").cast("long").alias("rank"))


@query("SELECT target_id AS id, source_id AS reference, total FROM (SELECT target_id, source_id, count(*) OVER (PARTITION BY target_id) AS total, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS rank FROM edges WHERE type = 'CALLS') WHERE rank <= 5")
def references_callers(spark, d):
    calls = edges_of(spark, d, "CALLS")
    page = G.top_per(calls, ["target_id"], [F.col("source_id")], 5).drop("rank")
    return page.join(calls.groupBy("target_id").agg(F.count("*").alias("total")), "target_id").select(F.col("target_id").alias("id"), F.col("source_id").alias("reference"), "total")


_PAIRS = "WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"


def _cochange(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = G.parts_for(line)
    rows = G.spread(line, parts, "l_orderkey").distinct()
    other = rows.select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = rows.withColumnRenamed("l_partkey", "a").join(other, "l_orderkey").filter("a < b").select("a", "b")
    return G.spread(pairs, parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"{_PAIRS} SELECT a, b, n FROM p WHERE n >= 2", lift=False)
def cochange_pairs(spark, d):
    return _cochange(spark, d).filter("n >= 2")


@query(f"{_PAIRS}, s AS (SELECT l_partkey, count(*) AS commits FROM c GROUP BY 1) SELECT a, b, n, commits, floor(n * 100.0 / commits + 0.5) / 100 AS confidence FROM p JOIN s ON a = l_partkey WHERE n >= 3", lift=False)
def cochange_rule_support(spark, d):
    single = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy(F.col("l_partkey").alias("a")).agg(F.count("*").alias("commits"))
    return _cochange(spark, d).filter("n >= 3").join(single, "a").select("a", "b", "n", "commits", G.two_dp(F.col("n") / F.col("commits")).alias("confidence"))


_SNAP = """WITH e AS (SELECT DISTINCT o_custkey, l_suppkey, o_orderdate < DATE '1998-01-01' AS old FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, l_suppkey, bool_or(old) AS was, bool_or(NOT old) AS now FROM e GROUP BY ALL)"""


def _snapshots(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    old = F.col("o_orderdate") < F.lit(CUT).cast("date")
    return both.groupBy("o_custkey", "l_suppkey").agg(F.bool_or(old).alias("was"), F.bool_or(~old).alias("now"))


@query(f"{_SNAP} SELECT o_custkey, l_suppkey, CASE WHEN NOT was THEN 'new-dependency' ELSE 'removed-dependency' END AS change FROM s WHERE was <> now", lift=False)
def edge_diff(spark, d):
    return _snapshots(spark, d).filter("was <> now").select("o_custkey", "l_suppkey", F.when(~F.col("was"), "new-dependency").otherwise("removed-dependency").alias("change"))


@query("SELECT id, type, path, n FROM (SELECT id, type, path, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM nodes) WHERE n <= 25")
def per_category_topk(spark, d):
    return G.top_per(nodes(spark, d).select("id", "type", "path"), ["type"], [F.col("id")], 25).withColumnRenamed("rank", "n").withColumn("n", F.col("n").cast("long"))


@query("SELECT n_custs AS size, count(*) AS nations FROM (SELECT c_nationkey, count(*) AS n_custs FROM customer GROUP BY 1) GROUP BY 1", lift=False)
def group_sizes(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("nations"))


@query("SELECT sn.n_regionkey AS source_group, tn.n_regionkey AS target_group, count(*) AS n FROM calls JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON c_nationkey = sn.n_nationkey JOIN nation tn ON s_nationkey = tn.n_nationkey GROUP BY ALL")
def group_edges_by_context(spark, d):
    home = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer:"), "c_custkey").alias("source_id"), F.col("n_regionkey").alias("source_group"))
    s = table(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), "s_suppkey").alias("target_id"), F.col("n_regionkey").alias("target_group"))
    return G.count_by(edges_of(spark, d, "CALLS").join(c, "source_id").join(s, "target_id"), "source_group", "target_group")


@query("SELECT CASE WHEN value < 3 THEN '<3s' WHEN value < 30 THEN '3-30s' WHEN value < 120 THEN '30s-2m' ELSE '>2m' END AS bucket, count(*) AS n FROM events GROUP BY 1", lift=False)
def telemetry_buckets(spark, d):
    return G.count_by(table(spark, d, "events").select(S.latency_bucket(F.col("value")).alias("bucket")), "bucket")


_PRED = "WITH p AS (SELECT l.doc_id, quality = 1 AS truth, n_chars >= 400 AS said FROM labels l JOIN documents USING (doc_id))"


@query(f"{_PRED} SELECT floor(sum((truth AND said)::INT) * 100.0 / nullif(sum(said::INT), 0) + 0.5) / 100 AS precision, floor(sum((truth AND said)::INT) * 100.0 / nullif(sum(truth::INT), 0) + 0.5) / 100 AS recall FROM p", lift=False)
def precision_recall(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") >= 400).alias("said"))
    hit, said, truth = F.count_if(F.col("truth") & F.col("said")), F.count_if("said"), F.count_if("truth")
    ratio = lambda a, b: G.two_dp(a / F.nullif(b, F.lit(0)))
    return rows.agg(ratio(hit, said).alias("precision"), ratio(hit, truth).alias("recall"))


@query("WITH r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM labels JOIN documents USING (doc_id)), f AS (SELECT source, min(rank) FILTER (quality = 1) AS first FROM r GROUP BY 1) SELECT source, first AS first_rank, floor(100.0 / first + 0.5) / 100 AS reciprocal FROM f", lift=False)
def reciprocal_rank(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long"))
    first = ranked.groupBy("source").agg(F.min(F.when(F.col("quality") == 1, F.col("rank"))).alias("first_rank"))
    return first.withColumn("reciprocal", G.two_dp(1 / F.col("first_rank")))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1", lift=False)
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", S.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT doc_id, bool_or(h IS NOT NULL) AS reused FROM documents LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0') ON sha256(text) = h WHERE source <> 'src0' GROUP BY doc_id", lift=False)
def content_hash_reuse(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", S.content_hash(F.col("text")).alias("hash"))
    cache = docs.filter("source = 'src0'").select("hash", F.lit(True).alias("hit")).distinct()
    return docs.filter("source <> 'src0'").join(cache, "hash", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("reused"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS n_mail, len(regexp_extract_all(text, '[0-9]{12,}'))::BIGINT AS n_digits FROM documents WHERE text IS NOT NULL", lift=False)
def redact_counts(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("n_mail"), count("[0-9]{12,}").alias("n_digits"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS n_links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))::BIGINT AS n_distinct FROM pages WHERE html IS NOT NULL", lift=False)
def html_references(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").filter("html is not null").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, count(*) AS n FROM l WHERE href NOT IN (SELECT regexp_extract(url, '://[^/]*([^?#]*)', 1) FROM pages) GROUP BY 1", lift=False)
def unresolved_links(spark, d):
    pages = table(spark, d, "pages")
    own = pages.select(F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("href")).distinct()
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return G.count_by(links.join(own, "href", "left_anti"), "href")


@query("SELECT id, type, (SELECT count(*) FROM nodes WHERE category <> 'domain') AS total FROM nodes WHERE category <> 'domain' AND (type > 'service' OR type = 'service' AND id > 'customer:42') ORDER BY type, id LIMIT 20")
def keyset_page(spark, d):
    """Twenty nodes by type and id after the cursor's, with the number of all."""
    rows = nodes(spark, d).filter("category <> 'domain'").select("id", "type")
    page = after_cursor(rows, [("type", True), ("id", True)], rows.filter("id = 'customer:42'"), 20)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", lift=False)
def warning_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
