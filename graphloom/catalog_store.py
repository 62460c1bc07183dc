"""Registered store, scan and history queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.functions import scalars as S
from graphloom.operators import graph as G
from graphloom.operators import ignore as N
from graphloom.operators import store as T
from graphloom.operators.graph import scratch
from graphloom.plans.lift import edges, nodes, table

_PATH = "source || '/' || lang || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.test.md' WHEN 1 THEN '.md' WHEN 2 THEN '.lock' ELSE '.txt' END"


def _files(spark, d):
    """Documents as files: a path by source and language, a length, a hash."""
    ending = F.when(F.col("doc_id") % 5 == 0, ".test.md").when(F.col("doc_id") % 5 == 1, ".md").when(F.col("doc_id") % 5 == 2, ".lock").otherwise(".txt")
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), ending)
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "source", "lang", path.alias("path"), F.octet_length("text").cast("long").alias("length"), S.content_hash(F.col("text")).alias("hash"))


@query(f"""SELECT coalesce(skip, 'kept') AS skip, count(*) AS n, sum(length)::BIGINT AS bytes FROM (SELECT strlen(text) AS length, CASE WHEN CASE WHEN regexp_matches(p, '^src1/fr/') THEN false WHEN regexp_matches(p, '\\.lock$') THEN true WHEN regexp_matches(p, '^src1/') THEN true ELSE false END THEN 'ignored' WHEN strlen(text) > 1000000 THEN 'too-large' END AS skip
FROM (SELECT text, {_PATH} AS p FROM documents WHERE text IS NOT NULL)) GROUP BY 1""", lift=False)
def file_scan(spark, d):
    """What a scan keeps and what it leaves out, by ordered ignore rules (the last that fits decides) and size."""
    rules = [("^src1/", False), (r"\.lock$", False), ("^src1/fr/", True)]
    rows = T.scanned(_files(spark, d), T.last_rule(F.col("path"), rules))
    return rows.groupBy(F.coalesce("skip", F.lit("kept")).alias("skip")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


#: Ignore files by folder: of the root, and one below it.
IGNORES = {"": "# build output\n\n*.lock\nsrc1/\n!src1/fr/\n/src2/de/*.md   \nes/\n!**/es/7?.md\nsrc4/??/*", "src3": "*.txt\n!keep.txt\n/en/*5.txt\n!1*.txt\nfr", "src4": "!en/"}


@query(f"""WITH f AS (SELECT DISTINCT {_PATH} AS path FROM documents WHERE text IS NOT NULL), r(base, place, rx, negated, folders) AS (VALUES
  ('', 2, '^(?:[^/]+/)*[^/]*\\.lock$', false, false), ('', 3, '^(?:[^/]+/)*src1$', false, true), ('', 4, '^src1/fr$', true, true), ('', 5, '^src2/de/[^/]*\\.md$', false, false), ('', 6, '^(?:[^/]+/)*es$', false, true),
  ('', 7, '^(?:[^/]+/)*es/7[^/]\\.md$', true, false), ('', 8, '^src4/[^/][^/]/[^/]*$', false, false), ('src3', 0, '^src3/(?:[^/]+/)*[^/]*\\.txt$', false, false), ('src3', 1, '^src3/(?:[^/]+/)*keep\\.txt$', true, false),
  ('src3', 2, '^src3/en/[^/]*5\\.txt$', false, false), ('src3', 3, '^src3/(?:[^/]+/)*1[^/]*\\.txt$', true, false), ('src3', 4, '^src3/(?:[^/]+/)*fr$', false, false), ('src4', 0, '^src4/(?:[^/]+/)*en$', true, true)),
e AS (SELECT path, path AS entry, false AS dir, 9 AS depth FROM f UNION ALL SELECT path, split_part(path, '/', 1), true, 1 FROM f UNION ALL SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), true, 2 FROM f),
d AS (SELECT path, entry, depth, arg_max(negated, length(base) * 100 + place) AS back FROM e JOIN r ON (base = '' OR starts_with(entry, base || '/')) AND (dir OR NOT folders) AND regexp_matches(entry, rx) GROUP BY ALL),
b AS (SELECT path, arg_min(entry, depth) AS "by" FROM d WHERE NOT back GROUP BY path)
SELECT path, "by" IS NOT NULL AS ignored, "by" FROM f LEFT JOIN b USING (path)""", lift=False)
def ignored_paths(spark, d):
    """Files that ignore files leave out, and the folder or file that decides."""
    rules = N.ignore_rules(spark.createDataFrame(list(IGNORES.items()), "base string, contents string"))
    return N.ignored_files(_files(spark, d).select("path").distinct(), rules)


@query("SELECT root, count(*) AS n, min(path) AS first FROM (SELECT 'parts' AS root, 'parts/' || p_brand || '/' || p_partkey AS path FROM part UNION ALL SELECT 'orders', 'orders/' || o_orderkey FROM orders) GROUP BY 1", lift=False)
def multi_root_scan(spark, d):
    roots = {"parts": table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_partkey").alias("path")), "orders": table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"))}
    return T.rooted(roots, "path").groupBy("root").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query(f"SELECT {_PATH} AS path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL", lift=False)
def file_hash_map(spark, d):
    return _files(spark, d).select("path", "hash")


@query(f"""WITH f AS (SELECT {_PATH} AS path, sha256(text) AS hash, doc_id FROM documents WHERE text IS NOT NULL)
SELECT path, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS reused FROM f""", lift=False)
def incremental_plan(spark, d):
    """Files whose path and hash are cached are reused; two thirds were cached, and every seventh has changed since."""
    files = _files(spark, d)
    cache = files.filter("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.sha2("path", 256)).otherwise(F.col("hash")))
    return T.reuse_plan(files.select("path", "hash"), cache).select("path", "reused")


@query("""WITH p AS (SELECT user_id, event_type, event_id, value FROM events) SELECT user_id, event_type, event_id, value FROM p QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""", lift=False)
def fragment_cache(spark, d):
    """The last write of each key."""
    return T.last_write(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "value").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' END AS event_type FROM events WHERE event_type <> 'error' GROUP BY 1", lift=False)
def artifact_status(spark, d):
    """The furthest status of each artifact; a log never goes back."""
    return T.forward_only(table(spark, d, "events"), "user_id", "event_id", "event_type", ("view", "click", "signup", "purchase"))


@query("SELECT id, category, type, name, path, provenance FROM nodes")
def graph_load(spark, d):
    """Nodes of the current snapshot, written under a pointer and read back by it."""
    root = scratch(spark, "store")
    held, _ = T.snapshot_round_trip(nodes(spark, d), edges(spark, d, ("CONTAINS",)), root)
    return held.select("id", "category", "type", "name", "path", "provenance")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_custkey % 4 = 0 AS fresh FROM customer UNION ALL SELECT c_custkey + 100000000, 'new', true FROM customer WHERE c_custkey % 100 = 0", lift=False)
def atomic_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(False).alias("fresh"))
    changed = old.filter("c_custkey % 4 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(True).alias("fresh"))
    added = old.filter("c_custkey % 100 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(True).alias("fresh"))
    return T.upserted(old, changed.unionByName(added), "c_custkey")


@query("SELECT (props::JSON->>'k')::BIGINT AS k, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1", lift=False)
def json_line_log(spark, d):
    """A log of JSON lines, every eleventh of them cut short."""
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("line"))
    return T.json_lines(lines, "line", "k long", ("k",)).groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE l_linestatus WHEN 'O' THEN 'M' ELSE CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'A' ELSE 'D' END END AS s FROM lineitem)
SELECT l_orderkey, s AS status, 'p' || l_partkey AS path, CASE WHEN s = 'R' THEN 's' || l_suppkey END AS old_path, count(*) AS n FROM l GROUP BY ALL""", lift=False)
def diff_parse(spark, d):
    """The name-status text of each commit, cut back into its entries."""
    s = F.when(F.col("l_linestatus") == "O", "M").when(F.col("l_returnflag") == "R", "R100").when(F.col("l_returnflag") == "A", "A").otherwise("D")
    nul = F.lit("\x00")
    old = F.when(s == "R100", F.concat(F.lit("s"), "l_suppkey", nul)).otherwise("")
    line = table(spark, d, "lineitem")
    text = G.spread(line.select("l_orderkey", F.concat(s, nul, old, F.lit("p"), "l_partkey", nul).alias("e")), G.parts_for(line), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list("e"), "").alias("text"))
    return T.name_status(text, "l_orderkey", "text").groupBy("l_orderkey", "status", "path", "old_path").agg(F.count("*").alias("n"))


@query("SELECT id || '|' || type || '|' || category || '|' || name || '|' || provenance AS line FROM nodes")
def golden_lines(spark, d):
    return T.golden(nodes(spark, d), "id", "type", "category", "name", "provenance")


@query("SELECT id, type, source_id, target_id FROM edges WHERE type = 'CONTAINS'")
def graph_json(spark, d):
    """Edges as JSON records with a version, and read back."""
    records = T.graph_json(nodes(spark, d), edges(spark, d, ("CONTAINS",)))
    return T.read_graph_json(records, "edge", "id string, type string, source_id string, target_id string")


@query("SELECT 'region-' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN '2024-09-09' ELSE '2024-01-0' || (r_regionkey + 1) END AS created_at, count(*) AS nodes, r_regionkey = 1 AS last FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY ALL", lift=False)
def snapshot_list(spark, d):
    """Snapshots of the nations of three regions in one store; that of the second region is put again at the end."""
    root, nation = scratch(spark, "store"), table(spark, d, "nation")
    put = lambda k, at: T.put_snapshot({"nodes": nation.filter(F.col("n_regionkey") == k)}, f"region-{k}", at, root)
    for k in range(3):
        put(k, f"2024-01-0{k + 1}")
    put(1, "2024-09-09")
    last, out = T.current_snapshot(spark, root), None
    for row in T.snapshots(spark, root).collect():
        one = T.of_snapshot(spark, root, "nodes", row["id"]).agg(F.count("*").alias("nodes")).select(F.lit(row["id"]).alias("id"), F.lit(row["created_at"]).alias("created_at"), "nodes", F.lit(row["id"] == last).alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH e AS (SELECT event_id, user_id, event_type, (props::JSON->>'k')::BIGINT AS line FROM events) SELECT event_id, event_type, line FROM e WHERE event_type IN ('click', 'view') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)", lift=False)
def evidence_lookup(spark, d):
    """Evidence of the asked ids that has a range."""
    events = table(spark, d, "events")
    asked = events.filter("event_type = 'purchase' and value > 90").select("user_id").distinct()
    return events.filter(F.col("event_type").isin("click", "view")).join(asked, "user_id", "left_semi").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("line"))


@query("""WITH m AS (SELECT o_orderkey, l_partkey, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT CASE place WHEN 0 THEN 'dependencies' WHEN 1 THEN 'devDependencies' ELSE 'peerDependencies' END AS block, count(*) AS n, count(DISTINCT l_partkey) AS names FROM m GROUP BY 1 UNION ALL SELECT 'entry', count(DISTINCT l_orderkey), 1 FROM lineitem""", lift=False)
def manifest_scan(spark, d):
    """A manifest of every order: blocks of dependencies, of which the first that has a name counts, and an entry point."""
    blocks = (("A", "dependencies"), ("N", "devDependencies"), ("R", "peerDependencies"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey").cast("string"))).alias(b) for f, b in blocks))
    as_map = lambda b: F.map_from_arrays(b, F.transform(b, lambda _: F.lit("^1.0.0"))).alias(b)
    manifests = rows.select("l_orderkey", F.to_json(F.struct(*(as_map(b) for _, b in blocks), F.lit("main.js").alias("main"))).alias("text"))
    return T.manifest_facts(manifests, "l_orderkey", "text").groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS commits, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS total FROM lineitem GROUP BY 1", lift=False)
def cochange_path_counts(spark, d):
    """Commits of every path, and of all."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    total = rows.select("l_orderkey").distinct().agg(F.count("*").alias("total"))
    return G.count_by(rows, "l_partkey").withColumnRenamed("n", "commits").crossJoin(F.broadcast(total))
