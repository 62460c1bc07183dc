"""Registered preflight and constraint queries, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.catalog_walks import _runtime
from graphloom.operators import constraints as N
from graphloom.operators import preflight as P
from graphloom.operators.graph import staged
from graphloom.plans.lift import nid, table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "NOWHERE", "HOUSEHOLD")
NEEDED = ("API_URL", "DB_URL")
DEFAULTS = ('"{}"', "None", "8080", None, "''", "false")


def _homes(spark, d):
    t = lambda n: table(spark, d, n)
    home = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("home"))
    return t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"))


def _inputs(spark, d):
    """Requirements of suppliers that propose calls, take members for granted, or add one; and what there is to hold them against."""
    t = lambda n: table(spark, d, n)
    rows, k = _homes(spark, d), F.col("s_suppkey")
    segment = F.element_at(F.array(*(F.lit(x) for x in SEGMENTS)), (k % 6 + 1).cast("int"))
    said = F.when(k % 3 == 0, F.concat(F.lit("The `"), "s_name", F.lit("` fetches from the `"), "n_name", F.lit("` service and emits events.")))
    said = said.when(k % 3 == 1, F.concat(F.lit("Runs on node.js. It uses "), "n_name", F.lit("."), segment, F.lit(" here."))).otherwise(F.concat(F.lit("Must add "), "n_name", F.lit(".NOWHERE to `"), "s_name", F.lit("`, not uses it.")))
    requirements = rows.select(k.cast("string").alias("requirement"), said.alias("statement"))
    one = F.struct(F.col("s_name").alias("ref"), nid("supplier", "s_suppkey").alias("id"), F.concat_ws("/", "home", "s_name").alias("path"))
    two = F.struct(F.col("n_name").alias("ref"), nid("nation", "n_nationkey").alias("id"), F.col("home").alias("path"))
    named = F.when(k % 3 == 0, F.array(one, two)).when(k % 3 == 2, F.array(one))
    concepts = rows.select(k.cast("string").alias("requirement"), F.posexplode(named).alias("place", "c")).select("requirement", "place", "c.*")
    scope, region = F.array(F.concat("r_name", F.lit("/**"))), t("region")
    spared = F.array(F.lit("Supplier#000000003"))
    calls = region.filter("r_regionkey % 2 = 0").select(*N.rule(F.lit("ci/scripts/check-calls.py"), "guard-script", F.concat(F.lit("no calls in "), "r_name"), "forbidden-runtime-call", "blocking", "recognized", "FORBIDS", scope, exempt=spared))
    advice = region.filter("r_regionkey = 1").select(*N.rule(F.lit("docs/adr/1.md"), "adr-guidance", F.concat(F.lit("Accepted decision: "), "r_name"), "architecture-guidance", "advisory", "recognized", "GOVERNS", scope))
    nation, customer = t("nation"), t("customer")
    field = F.concat(nid("nation", "c_nationkey"), F.lit("."), "c_mktsegment")
    fields = customer.select(field.alias("id"), F.lit("field").alias("type"), F.col("c_mktsegment").alias("name"), nid("nation", "c_nationkey").alias("source_id")).distinct()
    open_ = F.when(F.col("r_regionkey") == 2, P.K.OPEN).otherwise("class")
    held = nation.select(nid("nation", "n_nationkey").alias("id"), F.lit("class").alias("type"), F.col("n_name").alias("name")).unionByName(region.select(nid("region", "r_regionkey").alias("id"), open_.alias("type"), F.col("r_name").alias("name"))).unionByName(fields.drop("source_id"))
    ends = fields.select(F.lit("DECLARES_MEMBER").alias("type"), "source_id", F.col("id").alias("target_id")).unionByName(nation.select(F.lit("EXTENDS").alias("type"), nid("nation", "n_nationkey").alias("source_id"), nid("region", "n_regionkey").alias("target_id")))
    links = ends.select(F.concat_ws(":", "type", "source_id", "target_id").alias("id"), "type", "source_id", "target_id")
    topology, ways = map(staged, _runtime(spark, d))
    names = F.explode(F.when(F.col("n_nationkey") % 3 == 0, F.array(*(F.lit(n) for n in NEEDED))).otherwise(F.array(F.lit(NEEDED[0]))))
    default = F.element_at(F.array(*(F.lit(x) for x in DEFAULTS)), (F.col("p_partkey") % len(DEFAULTS) + 1).cast("int"))
    return {
        "requirements": requirements, "concepts": concepts, "constraints": staged(N.merged_constraints(calls.unionByName(advice))), "nodes": staged(held), "edges": staged(links), "topology": topology, "links": ways,
        "starts": topology.filter("type = 'service-url'").select("id"), "processes": nation.select(nid("nation", "n_nationkey").alias("id"), names.alias("name")), "needs": region.select(F.explode(F.array(*(F.lit(n) for n in NEEDED))).alias("name")).distinct(),
        "plan": nation.filter("n_nationkey < 3").select(nid("nation", "n_nationkey").alias("id")),
        "declarations": t("part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.concat(F.lit("conf/"), "p_brand").alias("path"), default.alias("default"), (F.col("p_partkey") % 4 == 1).alias("tolerant")),
    }


_FOUND = f"""h AS (SELECT s_suppkey AS k, s_name, n_nationkey, n_name, r_name, r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
seg AS (SELECT *, [{", ".join(repr(s) for s in SEGMENTS)}][1 + k % 6] AS segment FROM h), has AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer),
ways AS (SELECT 'order:' || o_orderkey AS start, c_nationkey, c_acctbal >= 0 AS on_, c_mktsegment = 'MACHINERY' AS twice FROM orders JOIN customer ON o_custkey = c_custkey),
parts AS (SELECT p_partkey, p_brand, ['"{{}}"', 'None', '8080', NULL, '''''', 'false'][1 + p_partkey % 6] AS v, p_partkey % 4 = 1 AS tolerant FROM part),
found AS (
  SELECT 'check-constraints' AS analyzer, k::VARCHAR AS requirement, 'constraint-violation' AS kind, 'blocking' AS severity, 90 AS confidence, 'no calls in ' || r_name AS subject, NULL AS detail FROM h WHERE k % 3 = 0 AND r_regionkey % 2 = 0 AND s_name <> 'Supplier#000000003'
  UNION ALL SELECT 'check-guidance', k::VARCHAR, 'constraint-warning', 'informational', 60, 'Accepted decision: ' || r_name, 'docs/adr/1.md' FROM h WHERE k % 3 <> 1 AND r_regionkey = 1
  UNION ALL SELECT 'check-assumptions', k::VARCHAR, 'invalid-assumption', CASE WHEN r_regionkey = 2 THEN 'warning' ELSE 'blocking' END, CASE WHEN r_regionkey = 2 THEN 60 ELSE 90 END, n_name || '.' || segment, CASE WHEN r_regionkey = 2 THEN 'unverified-assumption' ELSE 'verified-contradiction' END
    FROM seg WHERE k % 3 = 1 AND NOT contains(n_name, ' ') AND n_nationkey IN (SELECT c_nationkey FROM has) AND (n_nationkey, segment) NOT IN (FROM has)
  UNION ALL SELECT 'check-runtime', NULL, 'runtime-topology-gap', 'blocking', 85, start || ' at nation:' || c_nationkey, 'DB_URL' FROM ways WHERE on_ AND NOT twice AND c_nationkey % 3 <> 0
  UNION ALL SELECT 'check-runtime', NULL, 'analysis-caveat', 'warning', 50, start, CASE WHEN on_ THEN 'fan-out' ELSE 'no-handler' END FROM ways WHERE NOT on_ OR twice
  UNION ALL SELECT 'check-runtime', NULL, 'runtime-topology-gap', 'warning', 65, start || ' at nation:' || c_nationkey, 'not in the plan' FROM ways WHERE on_ AND NOT twice AND c_nationkey % 3 = 0 AND c_nationkey >= 3
  UNION ALL SELECT 'check-config-semantics', NULL, 'config-semantics-risk', 'warning', CASE WHEN v IN ('"{{}}"', '''''') THEN 80 ELSE 60 END, 'conf/' || p_brand || ':P' || p_partkey, CASE WHEN v IN ('"{{}}"', '''''') THEN 'empty-but-truthy-default' ELSE 'fail-open-default' END
    FROM parts WHERE v IN ('"{{}}"', '''''') OR tolerant AND (v IS NULL OR v IN ('None', 'false')))"""


@query(f"WITH {_FOUND} SELECT * FROM found", lift=False)
def run_preflight(spark, d):
    """All findings of all analyzers on the requirements of suppliers."""
    return P.preflight(_inputs(spark, d), spark)


@query(f"""WITH {_FOUND} SELECT k::VARCHAR AS requirement, CASE WHEN bool_or(f.severity = 'blocking') OR (SELECT count(*) FROM found WHERE requirement IS NULL AND severity = 'blocking') > 0 THEN 'BLOCKED'
WHEN bool_or(f.severity = 'warning') OR (SELECT count(*) FROM found WHERE requirement IS NULL AND severity = 'warning' AND kind <> 'analysis-caveat') > 0 THEN 'NEEDS_VERIFICATION' ELSE 'READY' END AS verdict, count(f.requirement) AS findings
FROM h LEFT JOIN (SELECT * FROM found WHERE requirement IS NOT NULL AND analyzer IN ('check-constraints', 'check-guidance', 'check-assumptions')) f ON f.requirement = k::VARCHAR GROUP BY k""".replace("FROM found WHERE requirement IS NULL", "FROM found WHERE false AND requirement IS NULL"), lift=False)
def preflight_verdicts(spark, d):
    """What the checks of the design say of each requirement; there is no deployment to check."""
    given = _inputs(spark, d)
    told = {n: given[n] for n in ("requirements", "concepts", "constraints", "nodes", "edges")}
    return P.verdicts(given["requirements"], P.preflight(told, spark))


@query(f"WITH {_FOUND} SELECT requirement, severity, confidence, subject, detail FROM found WHERE analyzer = 'check-assumptions'", lift=False)
def assumption_check(spark, d):
    """Members that requirements of suppliers take for granted, and that no class of the hierarchy declares."""
    given = _inputs(spark, d)
    return P.check_assumptions(given["requirements"], given["nodes"], given["edges"]).select("requirement", "severity", "confidence", "subject", "detail")


@query("""WITH c AS (SELECT source, unnest(['services/' || source, 'services/' || lang]) AS home, count(*) AS n FROM documents GROUP BY source, lang), f AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL)
SELECT 'forbidden-runtime-call' AS kind, 'https?://' || source AS subject, 'services/' || lang || '/**' AS scope, 'blocking' AS severity, 'recognized' AS extraction, 'billing,' || lang AS exempt, 1::BIGINT AS sources FROM f
UNION ALL SELECT 'must-pass-check', 'python ci/scripts/check-' || source || '-' || lang || '.py', '**', 'blocking', 'recognized', '', 1 FROM f
UNION ALL SELECT 'architecture-guidance', NULL, 'apps/' || lang || '/**,packages/' || source || '/**', 'advisory', 'recognized', '', 1 FROM f""", lift=False)
def extracted_constraints(spark, d):
    """Constraints out of guard scripts, a workflow and decisions, of each source and language."""
    made = table(spark, d, "documents").filter("source is not null").select("source", "lang").distinct()
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{s}"), F.col("source")), F.lit("{l}"), F.col("lang"))
    guard = made.select(fill("ci/scripts/check-{s}-{l}.py").alias("path"), fill('ALLOWED = ["billing", "{l}"]\nROOT = Path("services/{l}")\nP = re.compile(r"https?://{s}")\nsys.exit(1)\n').alias("content"))
    flow = made.select(fill(".github/workflows/{s}-{l}.yml").alias("path"), fill("on: push\n  - run: python ci/scripts/check-{s}-{l}.py\n  - run: make\n").alias("content"))
    decision = made.select(fill("docs/adr/{s}-{l}.md").alias("path"), fill("# ADR-1: On {s}\n\n- Status: Draft\n\nStatus: Accepted\n\nAll of packages/{s} and apps/{l}.").alias("content"))
    rows = N.merged_constraints(N.extracted_constraints(guard.unionByName(flow).unionByName(decision)))
    return rows.select("kind", "subject", F.array_join("scope", ",").alias("scope"), "severity", "extraction", F.array_join("exempt", ",").alias("exempt"), "sources")
