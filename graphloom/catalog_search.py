"""Registered matching and search queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.operators import matching as M
from graphloom.plans import vocabulary as V
from graphloom.plans.lift import edges, nodes, table

_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '\.[A-Za-z0-9]{{1,5}}$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
_RAW = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_STEMS = "list_distinct(list_filter(list_transform({}, lambda t: regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(ings|ing)$', ''), '(ers|er)$', ''), '(ions|ion)$', ''), '(es|s)$', '')), lambda t: length(t) >= 3))"


def _search_sql(text: str, tokens: list[str]) -> str:
    stems = _STEMS.format("[" + ", ".join(f"'{t}'" for t in tokens) + "]")
    hits = lambda c: f"len(list_intersect(q_stems, {_STEMS.format(_RAW.format(c))}))"
    return f"""+ q AS (SELECT {_NORM.format(f"'{text}'")} AS q, {stems} AS q_stems),
both_ways AS (SELECT source_id AS id, '0' || id AS hop, target_id AS other FROM edges UNION ALL SELECT target_id, '1' || id, source_id FROM edges),
few AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop) <= {M.MOST_NEIGHBOURS}),
near AS (SELECT few.id, list_distinct(flatten(list({_STEMS.format(_RAW.format("n.name"))}))) AS near FROM few JOIN nodes n ON n.id = other GROUP BY few.id),
h AS (SELECT n.*, q.*, {hits("name")} AS h_name, {hits("path")} AS h_path, {hits("type")} AS h_kind, coalesce(len(list_intersect(q_stems, near)), 0) AS h_near FROM nodes n LEFT JOIN near USING (id), q WHERE type IN ({V.listed(M.SEARCHABLE)})),
hits AS (SELECT id, name, category, type, path, CASE WHEN {_NORM.format("name")} = q THEN 'exact' WHEN h_name > 0 THEN 'conceptual' WHEN h_near > 0 THEN 'related' WHEN h_path + h_kind > 0 THEN 'lexical' END AS match_kind,
  CASE WHEN {_NORM.format("name")} = q THEN 1.0 ELSE floor(least({M.MOST_SCORE}::DOUBLE, h_name * ({M.NAME}::DOUBLE * 3) / len(q_stems) + h_path * ({M.PATH}::DOUBLE * 3) / len(q_stems) + h_kind * ({M.KIND}::DOUBLE * 3) / len(q_stems) + h_near * ({M.NEAR}::DOUBLE * 3) / len(q_stems)) * 100 + 0.5) / 100 END::DOUBLE AS score FROM h)
"""


_QUERY, _WORDS = "blue bolts", ["blue", "bolts"]
_HITS = _search_sql(_QUERY, _WORDS)


@query(_HITS + "SELECT id, match_kind, score FROM hits WHERE match_kind IS NOT NULL")
def component_search(spark, d):
    return M.search(nodes(spark, d), edges(spark, d), _QUERY, _WORDS).select("id", "match_kind", "score")


@query(_HITS + "SELECT id, 'source' AS role, floor(least(1.0::DOUBLE, score * 0.7::DOUBLE) * 100 + 0.5) / 100 AS score, false AS overflow FROM hits WHERE match_kind IS NOT NULL ORDER BY score DESC, id LIMIT 50")
def intent_rerank(spark, d):
    """The fifty best hits for a question about tests."""
    hits = M.search(nodes(spark, d), edges(spark, d), _QUERY, _WORDS)
    return M.reranked(hits, "tests").orderBy("overflow", F.desc("score"), "id").limit(50).select("id", "role", "score", "overflow")


@query("SELECT event_id % 97 AS k, CASE WHEN event_type = 'error' THEN 'validation' WHEN event_type = 'click' THEN 'tests' WHEN event_type = 'view' THEN 'runtime' WHEN event_type = 'signup' THEN 'planning' ELSE 'implementation' END AS intent, count(*) AS n FROM events GROUP BY ALL", lift=False)
def query_intents(spark, d):
    """Intents of questions whose wording follows the type of an event."""
    words = F.create_map(*(F.lit(x) for x in ("error", "Which CI check guards it?", "click", "test coverage", "view", "How do we deploy it?", "signup", "impact of this", "purchase", "where is it written")))
    return table(spark, d, "events").select((F.col("event_id") % 97).alias("k"), M.intent_of(words[F.col("event_type")]).alias("intent")).groupBy("k", "intent").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT 'parts/' || p_brand || '/' || p_name || '/' || p_size AS path FROM part), r AS (SELECT DISTINCT './' || upper(p_name) || '/' || p_size AS reference FROM part UNION SELECT path FROM f WHERE path LIKE '%/1_' UNION SELECT 'nowhere/' || p_brand FROM part),
t AS (SELECT reference, lower(regexp_replace(reference, '^(\\./)+', '')) AS target FROM r), m AS (SELECT reference, path, lower(path) = target AS whole FROM t JOIN f ON lower(path) = target OR ends_with(lower(path), '/' || target)),
g AS (SELECT reference, count(*) FILTER (whole) AS whole, count(*) AS n, min(path) FILTER (whole) AS wp, min(path) AS p FROM m GROUP BY 1), c AS (SELECT *, CASE WHEN whole > 0 THEN whole ELSE n END AS places FROM g)
SELECT reference, CASE WHEN places IS NULL THEN 'unresolved' WHEN places = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN places = 1 THEN CASE WHEN whole > 0 THEN 'verbatim' ELSE 'suffix' END END AS via, CASE WHEN places = 1 THEN coalesce(wp, p) END AS path, coalesce(places, 0) AS places FROM r LEFT JOIN c USING (reference)""", lift=False)
def path_reference_resolution(spark, d):
    part = table(spark, d, "part")
    files = part.select(F.concat_ws("/", F.lit("parts"), "p_brand", "p_name", "p_size").alias("path")).distinct()
    asked = part.select(F.concat(F.lit("./"), F.upper("p_name"), F.lit("/"), "p_size").alias("reference")).unionByName(files.filter("path like '%/1_'").withColumnRenamed("path", "reference")).unionByName(part.select(F.concat(F.lit("nowhere/"), "p_brand").alias("reference")))
    return M.resolve_paths(asked, files)


_NAMES = "WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_name || 'Service' FROM part), c AS (SELECT DISTINCT 'big ' || p_name AS concept FROM part UNION SELECT 'industrial ' || p_name FROM part UNION SELECT replace(p_name, ' ', '') FROM part)"


@query(f"""{_NAMES}, s AS (SELECT concept, name, {_TOKENS.format("concept")} AS ct, {_TOKENS.format("name")} AS nt, {_NORM.format("concept")} AS cn, {_NORM.format("name")} AS nn FROM c, n),
f AS (SELECT *, CASE WHEN nt[-1] IN ({V.listed(M.ARCHITECTURAL)}) THEN nt[:-2] ELSE nt END AS st FROM s WHERE cn <> nn)
SELECT DISTINCT concept, name FROM f WHERE (contains(' ' || array_to_string(CASE WHEN len(ct) <= len(nt) THEN nt ELSE ct END, ' ') || ' ', ' ' || array_to_string(CASE WHEN len(ct) <= len(nt) THEN ct ELSE nt END, ' ') || ' ')
AND least(length(cn), length(nn))::DOUBLE / greatest(length(cn), length(nn)) >= 0.6) OR (len(st) > 0 AND len(st) < len(nt) AND array_to_string(ct, '') = array_to_string(st, ''))""", lift=False)
def fuzzy_name_match(spark, d):
    name = table(spark, d, "part").select("p_name").distinct()
    concepts = name.select(F.explode(F.array(F.concat(F.lit("big "), "p_name"), F.concat(F.lit("industrial "), "p_name"), F.replace("p_name", F.lit(" "), F.lit("")))).alias("concept"))
    return M.similar_names(concepts, name.select(F.explode(F.array(F.col("p_name"), F.concat("p_name", F.lit("Service")))).alias("name")))


@query(f"""+ c AS (SELECT n_name AS concept FROM nation UNION SELECT replace(lower(s_name), '#', ' ') FROM supplier UNION SELECT 'big_' || replace(p_name, ' ', '_') FROM part UNION SELECT 'big ' || p_name FROM part UNION SELECT 'no ' || n_name FROM nation UNION SELECT p_name FROM part UNION SELECT s_name || ' alpha' FROM supplier WHERE s_suppkey < 7),
n AS (SELECT *, {_NORM.format("name")} AS t FROM nodes), e AS (SELECT concept, n.id, n.category, n.path FROM c JOIN n ON {_NORM.format("concept")} = t),
clash AS (SELECT DISTINCT concept FROM (SELECT concept, category, count(*) AS k, count(DISTINCT split_part(path, '/', 1)) AS p FROM e GROUP BY ALL) WHERE k > 3 AND p > 1),
rest AS (SELECT concept FROM c WHERE concept NOT IN (SELECT concept FROM e)), al AS (SELECT concept, n.id FROM rest JOIN n ON concept LIKE '% alpha' AND {_NORM.format("replace(concept, ' alpha', '')")} = t),
names AS (SELECT DISTINCT name FROM n), p AS (SELECT concept, name, {_TOKENS.format("concept")} AS ct, {_TOKENS.format("name")} AS nt, {_NORM.format("concept")} AS cn, {_NORM.format("name")} AS nn FROM rest, names),
alike AS (SELECT DISTINCT concept, n.id FROM p JOIN n USING (name) WHERE NOT contains(concept, ' ') AND NOT regexp_matches(concept, '^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$') AND list_has_any(ct, nt) AND contains(' ' || array_to_string(CASE WHEN len(ct) <= len(nt) THEN nt ELSE ct END, ' ') || ' ', ' ' || array_to_string(CASE WHEN len(ct) <= len(nt) THEN ct ELSE nt END, ' ') || ' ') AND least(length(cn), length(nn))::DOUBLE / greatest(length(cn), length(nn)) >= 0.6),
few AS (SELECT concept, count(*) AS k FROM alike GROUP BY 1),
a AS (SELECT concept, 'exact' AS outcome, id, 0 AS tier FROM e UNION ALL SELECT concept, 'alias', id, 1 FROM al UNION ALL SELECT concept, 'name-similarity', id, 2 FROM alike JOIN few USING (concept) WHERE k <= 3),
b AS (SELECT * FROM a WHERE concept NOT IN (FROM clash) QUALIFY tier = min(tier) OVER (PARTITION BY concept)), k AS (SELECT concept, outcome, id FROM b QUALIFY row_number() OVER (PARTITION BY concept ORDER BY id) <= 5)
SELECT * FROM k UNION ALL SELECT concept, CASE WHEN concept IN (FROM clash) OR concept IN (SELECT concept FROM few) THEN 'ambiguous' ELSE 'unknown' END, NULL FROM c WHERE concept NOT IN (SELECT concept FROM k)""")
def concept_matching(spark, d):
    t = lambda n: table(spark, d, n)
    alpha = t("supplier").filter("s_suppkey < 7").select(F.concat("s_name", F.lit(" alpha")).alias("concept"), F.col("s_name").alias("alias"))
    asked = t("nation").select(F.explode(F.array(F.col("n_name"), F.concat(F.lit("no "), "n_name"))).alias("concept")).unionByName(t("supplier").select(F.replace(F.lower("s_name"), F.lit("#"), F.lit(" ")).alias("concept")))
    asked = asked.unionByName(t("part").select(F.explode(F.array(F.concat(F.lit("big_"), F.replace("p_name", F.lit(" "), F.lit("_"))), F.concat(F.lit("big "), "p_name"), F.col("p_name"))).alias("concept"))).unionByName(alpha.select("concept"))
    return M.match_concepts(asked, nodes(spark, d), alpha)


@query(f"""+ q AS (SELECT DISTINCT id AS query FROM nodes WHERE type = 'package' UNION SELECT DISTINCT lower(s_name) FROM supplier UNION SELECT p_name FROM part UNION SELECT 'none at all'), k AS (SELECT id, 0 AS grade, id AS key FROM nodes UNION ALL SELECT id, 1, name FROM nodes UNION ALL SELECT id, 2, {_NORM.format("name")} FROM nodes UNION ALL SELECT id, 3, name FROM nodes),
g AS (SELECT query, grade, count(*) AS n, min(id) AS id FROM q JOIN k ON key = CASE WHEN grade = 2 THEN {_NORM.format("query")} ELSE query END GROUP BY query, grade), m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY grade) = 1)
SELECT query, grade, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN id END AS id FROM q LEFT JOIN m USING (query)""")
def symbol_resolution(spark, d):
    t = lambda n: table(spark, d, n)
    asked = nodes(spark, d).filter("type = 'package'").select(F.col("id").alias("query")).unionByName(t("supplier").select(F.lower("s_name").alias("query"))).unionByName(t("part").select(F.col("p_name").alias("query"))).unionByName(t("region").limit(1).select(F.lit("none at all").alias("query")))
    return M.resolve_symbols(asked, nodes(spark, d))


_GLOBS = [("parts/**", "parts"), ("parts/Brand#1*/**", "first brands"), ("**/red *", "red"), ("orders/199?/*", "orders of the nineties"), ("orders/1996/*", None)]


@query("""SELECT coalesce(label, 'none') AS label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(path, '^orders/1996/[^/]*$') THEN NULL WHEN regexp_matches(path, '^orders/199[^/]/[^/]*$') THEN 'orders of the nineties' WHEN regexp_matches(path, '^(.*/)?red [^/]*$') THEN 'red'
WHEN regexp_matches(path, '^parts/Brand#1[^/]*/.*$') THEN 'first brands' WHEN regexp_matches(path, '^parts/.*$') THEN 'parts' END AS label FROM nodes) GROUP BY 1""")
def glob_assignments(spark, d):
    return M.last_glob(nodes(spark, d), "path", _GLOBS, "label").groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT unnest(['^parts/Brand#1[^/]*/.*$', '^orders/1990/[^/]*$', '^(.*/)?green [^/]*$']) AS p, unnest(['parts/Brand#1*/**', 'orders/1990/*', '**/green *']) AS g), pt AS (SELECT 'parts/' || p_brand || '/' || p_name AS path FROM part UNION ALL SELECT 'orders/' || year(o_orderdate) || '/' || o_orderkey FROM orders) SELECT g AS \"glob\" FROM g WHERE NOT EXISTS (SELECT 1 FROM pt WHERE regexp_matches(path, p))", lift=False)
def stale_assignments(spark, d):
    """Globs that no path fits."""
    globs = ("parts/Brand#1*/**", "orders/1990/*", "**/green *")
    paths = table(spark, d, "part").select(F.concat_ws("/", F.lit("parts"), "p_brand", "p_name").alias("path")).unionByName(table(spark, d, "orders").select(F.concat_ws("/", F.lit("orders"), F.year("o_orderdate"), "o_orderkey").alias("path")))
    met = paths.agg(*(F.bool_or(F.col("path").rlike(M.glob_pattern(g))).alias(f"g{i}") for i, g in enumerate(globs)))
    return met.select(F.explode(F.array(*(F.struct(F.lit(g).alias("glob"), F.coalesce(f"g{i}", F.lit(False)).alias("met")) for i, g in enumerate(globs)))).alias("x")).filter("not x.met").select("x.glob")
