"""Registered enrichment, assembly and structure queries, and their DuckDB counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.operators import enrich as E
from graphloom.operators import modules as O
from graphloom.operators import preflight as P
from graphloom.operators import surfaces as U
from graphloom.operators.graph import count_by, top_per
from graphloom.operators.matching import match_concepts
from graphloom.plans.lift import edges, edges_of, nid, nodes, table


@query("""+ a AS (SELECT id, type, source_id, target_id, 0 AS rank FROM edges WHERE type = 'DEPENDS_ON' UNION ALL SELECT id, 'USES', source_id, target_id, 1 FROM edges WHERE type IN ('DEPENDS_ON', 'CALLS') UNION ALL SELECT 'bad:' || s_suppkey, 'USES', 'supplier:' || s_suppkey, 'nowhere', 2 FROM supplier)
SELECT id, type, source_id, target_id FROM a WHERE target_id IN (SELECT id FROM nodes) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1""")
def enrichment(spark, d):
    """Edges of three sources: the first source of an id wins, and edges without an end are dropped."""
    first, second = edges(spark, d, ("DEPENDS_ON",)), edges(spark, d, ("DEPENDS_ON", "CALLS")).withColumn("type", F.lit("USES"))
    broken = table(spark, d, "supplier").select(F.concat(F.lit("bad:"), "s_suppkey").alias("id"), F.lit("USES").alias("type"), nid("supplier", "s_suppkey").alias("source_id"), F.lit("nowhere").alias("target_id"))
    return E.enriched([first, second, broken], nodes(spark, d))


@query("""WITH h AS (SELECT p_partkey AS handler, p_brand AS owner, CASE p_partkey % 2 WHEN 0 THEN 'get' ELSE 'post' END AS verb, '/items/' || CASE p_partkey % 3 WHEN 0 THEN ':id' WHEN 1 THEN '{key}' ELSE 'all/' END AS path FROM part),
m AS (SELECT DISTINCT p_brand AS owner, '/api/v' || (p_size % 2) AS prefix FROM part WHERE p_brand LIKE 'Brand#1%')
SELECT handler, upper(verb) AS verb, coalesce(prefix, '') || '/items/' || CASE WHEN handler % 3 = 2 THEN 'all' ELSE '{}' END AS route FROM h LEFT JOIN m USING (owner)""", lift=False)
def mounted_routes(spark, d):
    part = table(spark, d, "part")
    path = F.concat(F.lit("/items/"), F.when(F.col("p_partkey") % 3 == 0, ":id").when(F.col("p_partkey") % 3 == 1, "{key}").otherwise("all/"))
    handlers = part.select(F.col("p_partkey").alias("handler"), F.col("p_brand").alias("owner"), F.when(F.col("p_partkey") % 2 == 0, "get").otherwise("post").alias("verb"), path.alias("path"))
    mounts = part.filter("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("owner"), F.concat(F.lit("/api/v"), F.col("p_size") % 2).alias("prefix")).distinct()
    return E.mounted_routes(handlers, mounts)


@query("""WITH p AS (SELECT p_name || '/' || p_size AS type_name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS provider FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1),
w AS (SELECT DISTINCT l_orderkey AS consumer, p_name || '/' || p_size AS type_name FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT consumer, provider, type_name FROM w JOIN p USING (type_name)""", lift=False)
def bean_injection(spark, d):
    """Types that orders want, from the only part that provides them; types of several providers are left open."""
    name = F.concat_ws("/", "p_name", "p_size").alias("type_name")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("provider"), name)
    wants = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("provider")).select(F.col("l_orderkey").alias("consumer"), "type_name").distinct()
    return E.injections(wants, part)


@query("""WITH s AS (SELECT 'seg' || (c_custkey % 20) AS key, CASE WHEN c_custkey % 20 = 4 THEN '${seg1}' WHEN c_custkey % 20 = 5 THEN 'a b' WHEN c_custkey % 20 < 10 THEN 'v' || (c_custkey % 20) ELSE 'v' || c_custkey END AS value FROM customer WHERE c_custkey % 20 <> 6), a AS (SELECT key, min(value) AS value, count(DISTINCT value) AS n FROM s GROUP BY 1),
r AS (SELECT s_suppkey, s_suppkey % 4 AS m, n, value FROM supplier LEFT JOIN a ON key = 'seg' || (s_suppkey % 20)), x AS (SELECT *, CASE WHEN n = 1 THEN value WHEN n IS NULL AND m = 2 THEN 'none' END AS found FROM r),
y AS (SELECT *, CASE WHEN m IN (0, 3) THEN 'not-a-placeholder' WHEN n > 1 THEN 'conflict' WHEN n = 1 AND contains(value, '${') THEN 'nested' WHEN found IS NULL THEN 'unknown-key' WHEN contains(found, ' ') THEN 'not-a-bare-name' END AS refusal FROM x)
SELECT s_suppkey, CASE WHEN refusal IS NULL THEN found END AS resolved, refusal FROM y""", lift=False)
def placeholder_values(spark, d):
    """What placeholders of suppliers stand for, by the settings of customers; why others are refused."""
    k = F.col("c_custkey") % 20
    value = F.when(k == 4, "${seg1}").when(k == 5, "a b").otherwise(F.concat(F.lit("v"), F.when(k < 10, k).otherwise(F.col("c_custkey"))))
    settings = table(spark, d, "customer").filter(k != 6).select(F.concat(F.lit("seg"), k).alias("key"), value.alias("value"))
    key, m = F.concat(F.lit("${seg"), F.col("s_suppkey") % 20), F.col("s_suppkey") % 4
    raw = F.when(m == 0, "plain").when(m == 1, F.concat(key, F.lit("}"))).when(m == 2, F.concat(key, F.lit(":none}"))).otherwise(F.concat(F.lit("x-"), key, F.lit("}")))
    return E.placeholders(table(spark, d, "supplier").select("s_suppkey", raw.alias("raw")), "raw", settings).select("s_suppkey", "resolved", "refusal")


@query(r"""WITH e AS (SELECT DISTINCT 'page' || page_id AS endpoint, 'GET' AS verb, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS route FROM pages WHERE page_id % 3 = 0),
c AS (SELECT page_id AS caller, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS route FROM pages)
SELECT caller, endpoint, c.verb FROM (SELECT caller, verb, regexp_replace(route, '/[0-9]+$', '/{}') AS route FROM c) c LEFT JOIN (SELECT endpoint, verb, regexp_replace(route, '/[0-9]+$', '/{}') AS route FROM e) e ON c.verb = e.verb AND c.route = e.route""", lift=False)
def template_calls(spark, d):
    """Calls of all pages to the endpoints that a third of them expose, by verb and route."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    endpoints = pages.filter("page_id % 3 = 0").select(F.concat(F.lit("page"), "page_id").alias("endpoint"), F.lit("get").alias("verb"), "path")
    return E.linked_calls(pages.select(F.col("page_id").alias("caller"), F.when(F.col("page_id") % 2 == 0, "get").otherwise("post").alias("verb"), "path"), endpoints)


@query("WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1))) AS key FROM pages), b AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+')) AS key FROM documents) SELECT page_id, l.key FROM l WHERE lower(l.key) IN (SELECT key FROM b)", lift=False)
def locale_links(spark, d):
    """Keys that pages use and a bundle (the first words of documents) defines."""
    used = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))).alias("key"))
    bundle = table(spark, d, "documents").select(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("k")).distinct()
    return used.join(bundle, F.lower("key") == F.col("k"), "left_semi")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS producer, o_orderkey AS outbox FROM orders), b AS (SELECT DISTINCT l_orderkey AS outbox, l_partkey AS topic FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT l_partkey AS topic, l_suppkey AS push FROM lineitem WHERE l_linenumber = 2), e AS (SELECT s_suppkey AS push, s_nationkey AS projection FROM supplier)
SELECT producer, outbox, topic, push, projection FROM a JOIN b USING (outbox) JOIN c USING (topic) JOIN e USING (push)""", lift=False)
def delivery_chains(spark, d):
    """Producer, outbox, topic, push end point and projection, over four kinds of edges."""
    line = table(spark, d, "lineitem")
    hop = lambda df, a, b, x, y: (df.select(F.col(a).alias(x), F.col(b).alias(y)), x, y)
    a, b = hop(table(spark, d, "orders"), "o_custkey", "o_orderkey", "producer", "outbox"), hop(line.filter("l_linenumber = 1"), "l_orderkey", "l_partkey", "outbox", "topic")
    c, e = hop(line.filter("l_linenumber = 2"), "l_partkey", "l_suppkey", "topic", "push"), hop(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "push", "projection")
    return E.delivery_chains(a, b, c, e).select("producer", "outbox", "topic", "push", "projection")


def _paths(spark, d):
    p = F.col("doc_id")
    path = F.when(p % 6 == 0, F.concat(F.lit("db/migrations/"), p.cast("string"), F.lit(".sql"))).when(p % 6 == 1, F.concat_ws("/", F.col("source"), F.lit("Dockerfile"))).when(p % 6 == 2, F.concat(F.lit(".github/workflows/"), p.cast("string"), F.lit(".yml")))
    return table(spark, d, "documents").select("doc_id", path.when(p % 6 == 3, F.concat(p.cast("string"), F.lit(".toml"))).otherwise(F.concat_ws("/", "source", F.concat(p.cast("string"), F.lit(".ts")))).alias("path"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'migration' WHEN 1 THEN 'docker-image' WHEN 2 THEN 'ci-check' ELSE 'configuration-file' END AS kind FROM documents WHERE doc_id % 6 < 4", lift=False)
def generic_detectors(spark, d):
    return E.detected(_paths(spark, d), "path").select("doc_id", "kind")


@query("SELECT p_partkey AS id, CASE p_brand WHEN 'Brand#3' THEN 'third' WHEN 'Brand#5' THEN 'fifth' END AS rule, CASE p_brand WHEN 'Brand#3' THEN 'job' WHEN 'Brand#5' THEN 'queue' END AS produces FROM part WHERE p_brand IN ('Brand#3', 'Brand#5') AND p_type IN ('ECONOMY', 'SMALL') AND CASE p_brand WHEN 'Brand#3' THEN p_type = 'ECONOMY' ELSE p_type = 'SMALL' END", lift=False)
def custom_detections(spark, d):
    rules = spark.createDataFrame([("third", "ECONOMY", "Brand#3", "job"), ("fifth", "SMALL", "Brand#5", "queue")], "rule string, kind string, name string, produces string")
    return E.custom_detections(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("name")), rules)


@query("""WITH RECURSIVE x AS (SELECT c_custkey AS f, CASE WHEN c_custkey % 5 = 0 THEN 'sym' || c_custkey END AS s FROM customer), l AS (SELECT c_custkey AS f, c_custkey // 3 AS g, 1 AS p FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 3 UNION ALL SELECT c_custkey, (c_custkey * 2) % (SELECT count(*) FROM customer), 2 FROM customer WHERE c_custkey % 5 <> 0),
w AS (SELECT c_custkey AS file, c_custkey AS f0, []::INT[] AS ord, [c_custkey] AS seen FROM customer UNION ALL SELECT file, g, list_append(ord, p), list_append(seen, g) FROM w JOIN l ON f = f0 WHERE NOT list_contains(seen, g) AND len(ord) < 4),
m AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY file, f0 ORDER BY len(ord), ord) = 1)
SELECT file, s AS target FROM (SELECT c_custkey AS file FROM customer) LEFT JOIN (SELECT file, s FROM m JOIN x ON f = f0 WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord) = 1) USING (file)""", lift=False)
def export_names(spark, d):
    """Names of files that are re-exported from others, up to four files on."""
    c = table(spark, d, "customer").select("c_custkey")
    n = c.agg(F.count("*").alias("n"))
    row = lambda df, symbol, to, place: df.select(F.col("c_custkey").alias("file"), F.lit("x").alias("name"), symbol.cast("string").alias("symbol"), to.cast("long").alias("from_file"), F.lit("x").alias("from_name"), F.lit(place).alias("position"))
    none = F.lit(None)
    exports = [row(c.filter("c_custkey % 5 = 0"), F.concat(F.lit("sym"), "c_custkey"), none, 0), row(c.filter("c_custkey % 5 <> 0 and c_custkey % 7 <> 3"), none, F.floor(F.col("c_custkey") / 3), 1), row(c.filter("c_custkey % 5 <> 0").crossJoin(F.broadcast(n)), none, (F.col("c_custkey") * 2) % F.col("n"), 2)]
    return E.exported_names(reduce(DataFrame.unionByName, exports), c.select(F.col("c_custkey").alias("file"), F.lit("x").alias("name")), 4).drop("name")


@query("""WITH k AS (SELECT DISTINCT p_brand AS b, p_size AS n, p_partkey % 5 AS m FROM part), f AS (SELECT DISTINCT CASE m WHEN 0 THEN 'src/' || b || '/m' || n || '.ts' WHEN 1 THEN 'src/' || b || '/m' || n || '/index.ts' WHEN 2 THEN 'py/' || b || '/m' || n || '.py' WHEN 3 THEN 'java/' || b || '/com/x/M' || n || '.java' ELSE 'packages/' || b || '/m' || n || '.tsx' END AS path FROM k),
bs AS (SELECT DISTINCT p_brand AS b FROM part), ns AS (SELECT DISTINCT p_size AS n FROM part),
i AS (SELECT 'src/' || b || '/main.ts' AS importer, './x/../m' || n || '.js' AS specifier, ['src/' || b || '/m' || n || '.ts'] AS tries FROM bs, ns UNION ALL SELECT 'src/' || b || '/sub/main.ts', '../m' || n, ['src/' || b || '/m' || n || '.ts', 'src/' || b || '/m' || n || '/index.ts'] FROM bs, ns
UNION ALL SELECT 'py/' || b || '/main.py', '.m' || n, ['py/' || b || '/m' || n || '.py'] FROM bs, ns UNION ALL SELECT 'top.ts', '@w/' || b || '/m' || n, ['packages/' || b || '/m' || n || '.tsx'] FROM bs, ns
UNION ALL SELECT 'top.ts', '~/' || b || '/m' || n, ['src/' || b || '/m' || n || '.ts', 'src/' || b || '/m' || n || '/index.ts'] FROM bs, ns UNION ALL SELECT 'A.java', 'com.x.M' || n, CASE WHEN (SELECT count(*) FROM f WHERE path LIKE '%/com/x/M' || n || '.java') = 1 THEN (SELECT list(path) FROM f WHERE path LIKE '%/com/x/M' || n || '.java') ELSE [] END FROM ns)
SELECT importer, specifier, list_filter(tries, lambda t: t IN (FROM f))[1] AS target FROM i""".replace("list_filter(tries, lambda t: t IN (FROM f))[1]", "(SELECT u.t FROM (SELECT unnest(tries) AS t, unnest(range(len(tries))) AS r) u JOIN f ON f.path = u.t ORDER BY u.r LIMIT 1)"), lift=False)
def module_resolution(spark, d):
    """Imports of every pair of a brand and a size, in three languages, by relative paths, an alias and packages."""
    part = table(spark, d, "part")
    text = lambda *x: F.concat(*(F.lit(c) if not c.startswith("p_") else F.col(c).cast("string") for c in x))
    kinds = (text("src/", "p_brand", "/m", "p_size", ".ts"), text("src/", "p_brand", "/m", "p_size", "/index.ts"), text("py/", "p_brand", "/m", "p_size", ".py"), text("java/", "p_brand", "/com/x/M", "p_size", ".java"), text("packages/", "p_brand", "/m", "p_size", ".tsx"))
    files = part.select(F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int")).alias("path"))
    brands = part.select("p_brand").distinct()
    every = brands.crossJoin(F.broadcast(part.select("p_size").distinct()))  # sizes are fifty
    asked = (
        (text("src/", "p_brand", "/main.ts"), text("./x/../m", "p_size", ".js")), (text("src/", "p_brand", "/sub/main.ts"), text("../m", "p_size")), (text("py/", "p_brand", "/main.py"), text(".m", "p_size")),
        (F.lit("top.ts"), text("@w/", "p_brand", "/m", "p_size")), (F.lit("top.ts"), text("~/", "p_brand", "/m", "p_size")), (F.lit("A.java"), text("com.x.M", "p_size")),
    )
    imports = every.select(F.explode(F.array(*(F.struct(a.alias("importer"), b.alias("specifier")) for a, b in asked))).alias("i")).select("i.*")
    none = F.lit(None).cast("string")
    packages = brands.select(text("@w/", "p_brand").alias("name"), text("packages/", "p_brand", "/").alias("directory"), none.alias("main"), none.alias("module"))
    aliases = brands.limit(1).select(F.lit("~/*").alias("pattern"), F.array(F.lit("gone/*"), F.lit("src/*")).alias("targets"))
    return O.resolved(imports, files, packages, aliases)


@query("SELECT event_id AS line, user_id AS file, 'svc' || (user_id % 5) || '.' || event_type AS callee FROM events WHERE event_type IN ('purchase', 'signup')", lift=False)
def call_sites(spark, d):
    facts = table(spark, d, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("file"), F.concat(F.lit("svc"), F.col("user_id") % 5, F.lit("."), "event_type").alias("callee"))
    symbols = table(spark, d, "events").filter("event_type in ('purchase', 'signup')").select(F.col("event_type").alias("name"))
    return E.call_sites(facts, symbols).select("line", "file", "callee")


@query("""+ r AS (SELECT 'callers' AS kind, target_id AS id, source_id AS other FROM edges WHERE type = 'CALLS' UNION ALL SELECT 'callees', source_id, target_id FROM edges WHERE type = 'CALLS' UNION ALL SELECT 'readers', target_id, source_id FROM edges WHERE type = 'READS_FROM' UNION ALL SELECT 'publishers', target_id, source_id FROM edges WHERE type = 'PUBLISHES' UNION ALL SELECT 'owners', target_id, source_id FROM edges WHERE type = 'CONTAINS')
SELECT kind, count(*) AS n, count(DISTINCT r.id) AS ids, min(n.name) AS first_name FROM r JOIN nodes n ON n.id = other GROUP BY 1""")
def reference_kinds(spark, d):
    """Five kinds of references between nodes: how many, of how many nodes, and the first name."""
    kinds = {"callers": ("CALLS", "target"), "callees": ("CALLS", "source"), "readers": ("READS_FROM", "target"), "publishers": ("PUBLISHES", "target"), "owners": ("CONTAINS", "target")}
    return E.references(edges(spark, d), nodes(spark, d), kinds).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("name").alias("first_name"))


@query("SELECT source_id, count(*) AS files, min(name) AS first_name, max(name) AS last_name FROM edges JOIN nodes n ON n.id = target_id WHERE edges.type = 'CONTAINS' AND n.category <> 'repository' GROUP BY 1")
def package_file_counts(spark, d):
    held = edges_of(spark, d, "CONTAINS").join(nodes(spark, d).filter("category <> 'repository'").select(F.col("id").alias("target_id"), "name"), "target_id")
    return held.groupBy("source_id").agg(F.count("*").alias("files"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("+ k AS (SELECT type, source_id, count(*) AS n FROM edges WHERE type IN ('PUBLISHES', 'CALLS', 'DEPENDS_ON') GROUP BY type, source_id) SELECT type, source_id, n FROM k QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, source_id) <= 25")
def integration_blocks(spark, d):
    """The twenty-five largest sources of each kind of integration."""
    counts = count_by(edges(spark, d, ("PUBLISHES", "CALLS", "DEPENDS_ON")), "type", "source_id")
    return top_per(counts, ["type"], [F.desc("n"), F.col("source_id")], 25).drop("rank")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand, p_retailprice FROM part), s AS (SELECT * FROM r ORDER BY p_retailprice DESC, id LIMIT 100) SELECT p_brand, count(*) AS hidden FROM r WHERE id NOT IN (SELECT id FROM s) GROUP BY 1""", lift=False)
def disclosure_budget(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_retailprice")
    return E.disclosed(rows, "p_brand", [F.desc("p_retailprice"), F.col("id")], 100)[1]


@query("""WITH k AS (SELECT p_partkey AS requirement, p_partkey % 5 AS m, p_name AS n, p_brand AS b, p_partkey AS k FROM part)
SELECT requirement, mechanism, n AS source_ref, 'apps/' || k || '/x' AS source_path, b AS target_ref, CASE WHEN m <> 1 THEN 'libs/' || b END AS target_path, CASE m WHEN 1 THEN 60 ELSE 85 END AS confidence
FROM k, (VALUES (0, 'http'), (1, 'event'), (1, 'import'), (2, 'import'), (3, 'http')) t(w, mechanism) WHERE m = w""", lift=False)
def proposed_edges(spark, d):
    """What requirement texts propose: mechanisms by their wording, the ends by where the text puts them."""
    k = F.col("p_partkey") % 5
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))
    texts = ("The {n} calls the billing api of {b}.", "The {n} publishes to {b} and depends on it.", "In {n} it imports {b}.", "From {b} the {n} takes rows over HTTP.", "The {n} and {b} are blue.")
    said = F.element_at(F.array(*(fill(t) for t in texts)), (k + 1).cast("int"))
    part = table(spark, d, "part")
    name = F.struct(F.col("p_name").alias("ref"), F.lit("x").alias("id"), F.concat(F.lit("apps/"), "p_partkey", F.lit("/x")).alias("path"))
    brand = F.struct(F.col("p_brand").alias("ref"), F.when(k != 1, "y").alias("id"), F.when(k != 1, F.concat(F.lit("libs/"), "p_brand")).alias("path"))
    concepts = part.select(F.col("p_partkey").alias("requirement"), F.posexplode(F.array(brand, name)).alias("place", "c")).select("requirement", "place", "c.*")
    return P.proposed_edges(part.select(F.col("p_partkey").alias("requirement"), said.alias("statement")), concepts)


#: Statements of suppliers, by their key; {0} is what each names.
_NAMING = ("Add the route {0} here", "It reads {0}", "Call {0} of the external service", "Rename {0} in the schema", "Use the topic {0}")
_NAMES = ("'/api/r' || k % 7", "'src/f' || k % 5 || '.ts'", "'Thing' || k % 3", "'word'", "'NoSuch_' || k % 4")
_UNKNOWN = f"""s AS (SELECT s_suppkey AS k FROM supplier), u AS (SELECT k, {"CASE (k // 5) % 5 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_NAMES)) + " END"} AS concept, k % 5 AS said FROM s)"""


def _unknown(spark, d):
    """(requirement, statement, concept) of suppliers."""
    k = F.col("s_suppkey")
    named = (F.concat(F.lit("/api/r"), k % 7), F.concat(F.lit("src/f"), k % 5, F.lit(".ts")), F.concat(F.lit("Thing"), k % 3), F.lit("word"), F.concat(F.lit("NoSuch_"), k % 4))
    concept = F.element_at(F.array(*(n.cast("string") for n in named)), (F.floor(k / 5) % 5 + 1).cast("int"))
    said = F.element_at(F.array(*(F.lit(t) for t in _NAMING)), (k % 5 + 1).cast("int"))
    rows = table(spark, d, "supplier").select(k.cast("string").alias("requirement"), said.alias("said"), concept.alias("concept"))
    return rows.select("requirement", F.replace("said", F.lit("{0}"), F.col("concept")).alias("statement"), "concept")


@query(f"""WITH {_UNKNOWN}, g AS (SELECT concept, bool_or(said = 0) AS creates, bool_or(said = 2) AS outside, bool_or(said = 4) AS sibling, array_to_string(list_sort(list(k::VARCHAR)), ',') AS requirements FROM u GROUP BY 1),
c AS (SELECT *, CASE WHEN concept LIKE '/%' THEN 'route' WHEN contains(concept, '/') THEN 'path' WHEN concept = 'word' THEN 'term' ELSE 'identifier' END AS shape, CASE WHEN concept LIKE 'Thing%' THEN concept || 'A,' || concept || 'B' ELSE '' END AS nearest FROM g),
r AS (SELECT *, list_filter([CASE WHEN outside THEN 'external-dependency' END, CASE WHEN shape <> 'term' AND (creates OR sibling) THEN 'new-surface' END, CASE WHEN nearest <> '' THEN 'terminology-mismatch' END], lambda x: x IS NOT NULL) AS readings FROM c)
SELECT concept, shape, coalesce(readings[1], 'insufficient-evidence') AS kind, array_to_string(CASE WHEN len(readings) = 0 THEN ['new-surface', 'external-dependency', 'coverage-gap', 'terminology-mismatch'] ELSE readings[2:] END, ',') AS others, requirements, nearest,
CASE coalesce(readings[1], '') WHEN 'external-dependency' THEN 70 WHEN 'new-surface' THEN 70 WHEN 'terminology-mismatch' THEN 60 ELSE 30 END AS confidence FROM r""", lift=False)
def unresolved_surfaces(spark, d):
    """What the absence of the concepts of suppliers' requirements may mean."""
    rows = _unknown(spark, d)
    near = rows.filter("concept like 'Thing%'").select("concept", F.explode(F.array(F.concat("concept", F.lit("A")), F.concat("concept", F.lit("B")))).alias("name"))
    out = U.unresolved_surfaces(rows.select("requirement", "statement"), rows.select("requirement", "concept"), near, nodes(spark, d))
    return out.select("concept", "shape", "kind", *(F.array_join(c, ",").alias(c) for c in ("others", "requirements", "nearest")), "confidence")


@query("SELECT o_orderkey, o_orderpriority, total FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER () AS total, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F') WHERE p > 40 AND p <= 60", lift=False)
def review_page(spark, d):
    """Twenty findings of one category from the forty-first on, with the number of all."""
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return rows.orderBy("o_orderpriority", "o_orderkey").limit(60).offset(40).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS plan, l_partkey AS duty FROM lineitem WHERE l_linenumber <= 3), c AS (SELECT DISTINCT l_orderkey AS plan, l_partkey AS duty FROM lineitem WHERE l_linestatus = 'F')
SELECT coalesce(p.plan, c.plan) AS plan, count(*) FILTER (p.plan IS NOT NULL AND c.plan IS NOT NULL) AS kept, count(*) FILTER (c.plan IS NULL) AS broken, count(*) FILTER (p.plan IS NULL) AS extra FROM p FULL JOIN c ON p.plan = c.plan AND p.duty = c.duty GROUP BY 1""", lift=False)
def plan_contract(spark, d):
    """Duties of each approved plan against what was done."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("duty"), "l_linenumber", "l_linestatus")
    due = line.filter("l_linenumber <= 3").select("plan", "duty").distinct().withColumn("due", F.lit(True))
    done = line.filter("l_linestatus = 'F'").select("plan", "duty").distinct().withColumn("done", F.lit(True))
    both = due.join(done, ["plan", "duty"], "full_outer")
    n = lambda c: F.count_if(F.expr(c))
    return both.groupBy("plan").agg(n("due and done").alias("kept"), n("done is null").alias("broken"), n("due is null").alias("extra"))


@query("WITH i AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT s, CASE WHEN bool_or(c % 50 = 3) THEN 'USER_SUPPLIED' ELSE 'GRAPH_DERIVED' END AS provenance, count(*) FILTER (c % 50 = 3) AS named, count(*) AS n FROM i GROUP BY 1", lift=False)
def evidence_provenance(spark, d):
    """Whether a node's impacts rest on what the user named or on what was discovered."""
    pairs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()
    named = F.count_if(F.col("c") % 50 == 3)
    return pairs.groupBy("s").agg(F.when(named > 0, "USER_SUPPLIED").otherwise("GRAPH_DERIVED").alias("provenance"), named.alias("named"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT k::VARCHAR AS requirement, CASE k % 4 WHEN 0 THEN 'NoSuch' || k WHEN 1 THEN 'no-such-thing' WHEN 2 THEN (SELECT min(n_name) FROM nation) ELSE 'Twins' END AS concept FROM s)
SELECT requirement, unnest(CASE WHEN concept = 'Twins' THEN ['ambiguous-concept'] ELSE ['unknown-concept', 'unresolved-concept'] END) AS code, concept FROM c WHERE concept LIKE 'NoSuch%' OR concept = 'Twins'""", lift=False)
def match_warnings(spark, d):
    """Warnings of what suppliers' requirements name: nothing, a phrase, a nation, and one of many services of one name."""
    k = F.col("s_suppkey")
    first = table(spark, d, "nation").agg(F.min("n_name").alias("n_name"))
    concept = F.when(k % 4 == 0, F.concat(F.lit("NoSuch"), k)).when(k % 4 == 1, "no-such-thing").when(k % 4 == 2, F.col("n_name")).otherwise("Twins")
    asked = table(spark, d, "supplier").crossJoin(F.broadcast(first)).select(k.cast("string").alias("requirement"), concept.alias("concept"))
    twins = table(spark, d, "nation").select(F.concat(F.lit("twin:"), "n_nationkey").alias("id"), F.lit("application").alias("category"), F.lit("service").alias("type"), F.lit("Twins").alias("name"), F.concat(F.col("n_nationkey").cast("string"), F.lit("/twins")).alias("path"), F.lit("static-analysis").alias("provenance"))
    none = first.select(F.col("n_name").alias("concept"), F.col("n_name").alias("alias")).limit(0)
    return U.match_warnings(asked, match_concepts(asked, nodes(spark, d).unionByName(twins), none))
