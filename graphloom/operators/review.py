"""Review of plan against change, drift, overlays, freshness, feasibility, and the measures of past outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import small

# Fixed values, in their order.
NOISE_PREFIXES = (".git/", "node_modules/", "vendor/")
PREDICTIVE = ("required", "likely", "possible")
DISCREPANCIES = ("missing", "guard-violated", "divergent", "unexpected")
LEVELS = ("human-confirmed", "agent-approved", "repo-metadata", "deterministic-detection", "ai-inferred", "defaults")
WARNINGS = (
    ("no-adapter", r"(?i)no language adapter"), ("parse-failure", r"(?i)\b(parse|syntax) (error|failure|failed)|failed to parse|unparse"),
    ("unresolved-import", r"(?i)could not resolve (the )?import|unresolved import|module not found|cannot find module"),
    ("unresolved-symbol", r"(?i)unresolved symbol|unknown symbol|could not resolve (the )?(symbol|reference)"), ("missing-generated-file", r"(?i)generated|codegen|not generated yet|run .*generate"),
    ("external-dependency", r"(?i)node_modules|third[- ]party|outside the workspace|external package"), ("ignored-file", r"(?i)ignored|skipped|excluded|too large|binary"),
    ("unsupported-syntax", r"(?i)unsupported|not modelled|not modeled|not supported|cannot represent"), ("stale-index", r"(?i)stale|out of date"),
)
PENALTY = {"blocking": 25, "important": 7, "minor": 2}
UNMATCHED, FLOOR = 50, 5
CEILING = {"READY": 100, "READY_WITH_WARNINGS": 100, "NEEDS_VERIFICATION": 70, "NEEDS_CLARIFICATION": 60, "INSUFFICIENT_COVERAGE": 40, "BLOCKED": 20}
AGE_LIMIT_HOURS = 24
ARTIFACTS = (
    ("new-locale-entry", r"(?i)\b(locale|translation|i18n|message text|copy|subject line|wording|language)\b"), ("new-test", r"(?i)\b(must|should|shall)\b"),
    ("new-event-handler", r"(?i)\b(event|topic|subscription|publish|subscribe|consume|outbox|queue|push route)\b"),
    ("new-migration", r"(?i)\b(column|table|schema|field|persist|store|database|nullable|index)\b"),
    ("new-contract-definition", r"(?i)\b(contract|api|endpoint|payload|schema|openapi|event definition|dto)\b"),
    ("new-configuration-entry", r"(?i)\b(config|configuration|environment variable|feature flag|terraform|deploy)\b"),
)
# What a proposed relationship may break, by its mechanism.
APPLIES = {
    "http": ("forbidden-runtime-call", "boundary-restriction"), "event": ("forbidden-runtime-call",), "import": ("forbidden-dependency", "boundary-restriction"),
    "direct-data-access": ("forbidden-runtime-call", "boundary-restriction"), "configuration": ("required-config",),
}


def noise(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) for p in NOISE_PREFIXES])


def compared(impacts: DataFrame, changes: DataFrame) -> DataFrame:
    """(requirement, id, path, finding): predicted impacts against changed paths.

    ``impacts`` has requirement, id, path, likelihood, expectation (must-change, preserve, reuse or verify-only), rejected and
    present (whether the node is still there); ``changes`` has path. Unchanged likely and possible impacts are no findings;
    changed paths that no impact covers are unexpected, with neither requirement nor id.
    """
    held = impacts.filter(F.col("likelihood").isin(*PREDICTIVE) & ~F.col("rejected"))
    moved = changes.filter(~noise(F.col("path"))).select("path").distinct()
    rows = held.join(moved.withColumn("changed", F.lit(True)), "path", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    required = F.col("likelihood") == "required"
    finding = (
        F.when(F.col("path").isNull(), F.when(required, "unverifiable")).when((F.col("expectation") == "preserve") & F.col("changed"), "guard-violated")
        .when((F.col("expectation") != "must-change") & F.col("changed"), "divergent").when(F.col("expectation") != "must-change", "reuse-confirmed")
        .when(F.col("changed"), F.when(F.col("present"), "matched").otherwise("divergent")).when(required, "missing")
    )
    found = rows.select("requirement", "id", "path", finding.alias("finding")).filter("finding is not null")
    other = moved.join(held.select("path"), "path", "left_anti")
    nothing = lambda c: F.lit(None).cast(impacts.schema[c].dataType).alias(c)
    return found.unionByName(other.select(nothing("requirement"), nothing("id"), "path", F.lit("unexpected").alias("finding")))


def coverage_status(findings: DataFrame, requirements: DataFrame) -> DataFrame:
    """(requirement, status): implemented, partially-implemented, not-found or unclear, for every requirement."""
    n = lambda *kinds: F.count_if(F.col("finding").isin(*kinds))
    counts = findings.groupBy("requirement").agg(n("matched", "reuse-confirmed").alias("good"), n("missing", "divergent", "guard-violated").alias("bad"), n("unverifiable").alias("open"))
    status = F.when(F.expr("good > 0 and bad = 0 and open = 0"), "implemented").when(F.col("good") > 0, "partially-implemented").when(F.col("bad") > 0, "not-found").otherwise("unclear")
    return requirements.select("requirement").distinct().join(counts, "requirement", "left").select("requirement", status.alias("status"))


def verdicts(findings: DataFrame, by: str) -> DataFrame:
    """(by, counts, status): a review passes if no discrepancy is left that nobody accepted. ``findings`` has finding and accepted."""
    n = lambda kind: F.count_if(F.col("finding") == kind).alias(kind.replace("-", "_"))
    open_ = F.count_if(F.col("finding").isin(*DISCREPANCIES) & ~F.col("accepted"))
    counts = findings.groupBy(by).agg(*(n(k) for k in ("matched", "missing", "unexpected", "divergent", "guard-violated", "reuse-confirmed", "unverifiable")), F.count_if("accepted").alias("accepted"), open_.alias("unanswered"))
    return counts.withColumn("status", F.when(F.col("unanswered") > 0, "NEEDS_ATTENTION").otherwise("PASS"))


def deciding(findings: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The first ``k`` unanswered discrepancies of each review, gravest kind first, then by id."""
    rank = reduce(lambda out, kv: F.when(F.col("finding") == kv[1], kv[0]).otherwise(out), enumerate(DISCREPANCIES), F.lit(9))
    rows = findings.filter(F.col("finding").isin(*DISCREPANCIES) & ~F.col("accepted"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(rank, "id"))).filter(F.col("place") <= k)


def drift(approved: DataFrame, current: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, type, direction, category) of the edges only one of two graphs has.

    Nodes have id, context and repository (null if unknown). A change between two contexts or repositories is called so; else one whose
    opposite went the other way is a reversal; else it is a dependency made or lost if the other graph has both its nodes.
    """
    key = ["source_id", "target_id", "type"]
    added = current.select(key).distinct().join(approved.select(key), key, "left_anti").withColumn("direction", F.lit("added"))
    removed = approved.select(key).distinct().join(current.select(key), key, "left_anti").withColumn("direction", F.lit("removed"))

    def placed(edges: DataFrame, own: DataFrame, other: DataFrame, opposite: DataFrame) -> DataFrame:
        for end in ("source", "target"):
            edges = edges.join(own.select(F.col("id").alias(f"{end}_id"), F.col("context").alias(f"{end}_context"), F.col("repository").alias(f"{end}_repository")), f"{end}_id")
            edges = edges.join(other.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_there")), f"{end}_id", "left")
        back = opposite.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type", F.lit(True).alias("back"))
        return edges.join(back, key, "left")

    both = placed(added, new_nodes, old_nodes, removed).unionByName(placed(removed, old_nodes, new_nodes, added))
    category = (
        F.when(F.col("source_context") != F.col("target_context"), "cross-context").when(~F.col("source_repository").eqNullSafe(F.col("target_repository")), "cross-repository")
        .when(F.col("back"), "direction-reversal").when(F.col("source_there") & F.col("target_there"), F.when(F.col("direction") == "added", "new-dependency").otherwise("removed-dependency")).otherwise("other")
    )
    return both.select(*key, "direction", category.alias("category"))


def effective_level(candidates: DataFrame, key: str, level: str, position: str, value: str) -> DataFrame:
    """(key, value, level, rank, provenance): the candidate of the strongest level; of equal ones the latest."""
    rank = reduce(lambda out, kv: F.when(F.col(level) == kv[1], kv[0]).otherwise(out), enumerate(LEVELS, 1), F.lit(len(LEVELS) + 1))
    best = candidates.groupBy(key).agg(F.min_by(F.struct(value, level, rank.alias("rank")), F.struct(rank, -F.col(position))).alias("b")).select(key, "b.*")
    told = F.when(F.col(level) == "human-confirmed", "human-confirmed").when(F.col(level).isin("agent-approved", "ai-inferred"), "llm-inferred").when(F.col(level) == "repo-metadata", "configuration").otherwise("framework-convention")
    return best.withColumn("provenance", told)


def freshness(states: DataFrame) -> DataFrame:
    """``states`` with state (the first reason that applies, else current) and reasons (all of them, in order), from indexed_sha, head_sha, dirty, spec, latest_spec and hours."""
    checks = (("behind-head", F.col("head_sha") != F.col("indexed_sha")), ("working-tree-modified", F.col("dirty")), ("specification-moved", F.col("latest_spec") > F.col("spec")), ("aged", F.col("hours") > AGE_LIMIT_HOURS))
    reasons = F.filter(F.array(*(F.when(c, name) for name, c in checks)), lambda x: x.isNotNull())
    absent = F.col("indexed_sha").isNull()
    rows = states.withColumn("reasons", F.when(absent, F.array(F.lit("not-indexed"))).otherwise(reasons))
    return rows.withColumn("state", F.when(F.size("reasons") > 0, F.element_at("reasons", 1)).otherwise("current"))


def readiness(counts: DataFrame) -> DataFrame:
    """``counts`` (requirements, unmatched, blocking, important, minor) with readiness, 0 to 100: 0 without requirements, 5 at least otherwise."""
    lost = sum(F.col(k) * v for k, v in PENALTY.items()) + F.floor(F.col("unmatched") * UNMATCHED / F.col("requirements") + 0.5)
    return counts.withColumn("readiness", F.when(F.col("requirements") == 0, 0).otherwise(F.greatest(F.lit(FLOOR), 100 - lost)).cast("long"))


def feasibility(counts: DataFrame) -> DataFrame:
    """``counts`` with feasibility and score (null where coverage is insufficient; at most what the feasibility allows)."""
    verdict = (
        F.when(F.col("blocking") > 0, "BLOCKED").when(F.col("insufficient"), "INSUFFICIENT_COVERAGE").when(F.col("unverified") > 0, "NEEDS_VERIFICATION")
        .when(F.col("questions") > 0, "NEEDS_CLARIFICATION").when(F.col("warnings") - F.col("unverified") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    )
    rows = counts.withColumn("feasibility", verdict)
    ceiling = reduce(lambda out, kv: F.when(F.col("feasibility") == kv[0], kv[1]).otherwise(out), CEILING.items(), F.lit(0))
    return rows.withColumn("capped_score", F.when(F.col("feasibility") != "INSUFFICIENT_COVERAGE", F.least(F.col("score"), ceiling)).cast("long"))


def sufficiency(counts: DataFrame) -> DataFrame:
    """``counts`` (requirements, unmatched, explained, concepts, unresolved, missing) with status and n_reasons."""
    unexplained = F.col("unmatched") - F.least("explained", "unmatched")
    reasons = (2 * unexplained >= F.col("requirements"), (F.col("concepts") > 0) & (F.col("unresolved") >= F.col("concepts")), (F.col("missing") > 0) & (F.col("unmatched") > 0))
    n = sum(F.when(r, 1).otherwise(0) for r in reasons)
    rows = counts.withColumn("n_reasons", F.when(F.col("requirements") == 0, 0).otherwise(n).cast("long"))
    return rows.withColumn("status", F.when(F.col("n_reasons") == 0, "adequate").otherwise("insufficient-coverage"))


def excluded(impacts: DataFrame, non_goals: DataFrame) -> DataFrame:
    """``impacts`` with the likelihood excluded where a non-goal (id) names the node, unless it is required; warning tells which was which."""
    named = impacts.join(non_goals.select("id", F.lit(True).alias("_named")).distinct(), "id", "left")
    warning = F.when(F.col("_named") & (F.col("likelihood") == "required"), "non-goal-contradiction").when(F.col("_named"), "non-goal-exclusion")
    rows = named.withColumn("warning", warning)
    return rows.withColumn("likelihood", F.when(F.col("warning") == "non-goal-exclusion", "excluded").otherwise(F.col("likelihood"))).drop("_named")


def keep_strongest(impacts: DataFrame, keys: list[str], strength: str, position: str) -> DataFrame:
    """One row for each key: of the highest strength, the first of equal ones."""
    rest = [c for c in impacts.columns if c not in keys]
    return impacts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(strength), position)).alias("b")).select(*keys, "b.*")


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many ids only one of two footprints (id, category) has, and how grave that is."""
    both = a.join(b.select("id"), "id", "left_anti").unionByName(b.join(a.select("id"), "id", "left_anti"))
    severity = F.when(F.count("*") == 0, F.lit(None).cast("string")).when(F.bool_or(F.col("category").isin("data", "integration")), "blocking").when(F.bool_or(F.col("category") == "infrastructure") | (F.count("*") >= 2), "important").otherwise("minor")
    return both.agg(F.count("*").alias("divergent"), severity.alias("severity"))


def collapsed(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Caveats of the same keys as one row with their number and first id; other findings as they are."""
    merged = findings.filter("caveat").groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return merged.unionByName(findings.filter("not caveat").select(*keys, F.lit(1).cast("long").alias("n"), "id"))


def constraint_findings(proposed: DataFrame, constraints: DataFrame, exemptions: DataFrame) -> DataFrame:
    """(requirement, constraint, severity, confidence): proposed relationships that a constraint forbids and no exemption allows.

    ``proposed`` has requirement, mechanism, source_path, source_ref, target_path and confidence (percent); ``constraints`` has
    constraint, kind, scope (a path prefix, empty for all), allowed (target prefixes, or null) and authority (may it block);
    ``exemptions`` has constraint and subject (a source reference). A blocking finding needs an authority, a source that its path puts in scope and a confidence of 80.
    """
    pairs = [(m, k) for m, kinds in APPLIES.items() for k in kinds]
    kind = F.array(*(F.struct(F.lit(m).alias("mechanism"), F.lit(k).alias("kind")) for m, k in pairs))
    ruled = constraints.withColumn("p", F.explode(F.filter(kind, lambda p: p["kind"] == F.col("kind")))).withColumn("mechanism", F.col("p.mechanism")).drop("p")
    rows = proposed.join(small(ruled), "mechanism")
    by_path = F.col("source_path").isNotNull() & F.startswith("source_path", F.col("scope"))
    by_name = (F.length("scope") > 2) & F.contains(F.lower("source_ref"), F.lower(F.regexp_replace("scope", "/+$", "")))
    rows = rows.withColumn("by_path", by_path).filter(F.col("by_path") | (F.col("scope") == "") | by_name)
    allowed = (F.col("kind") == "boundary-restriction") & F.col("allowed").isNotNull() & (F.col("target_path").isNull() | F.exists("allowed", lambda a: F.startswith("target_path", a)))
    rows = rows.filter(~allowed).join(exemptions.select("constraint", F.col("subject").alias("source_ref")), ["constraint", "source_ref"], "left_anti")
    blocking = F.col("authority") & F.col("by_path") & (F.col("confidence") >= 80)
    return rows.select("requirement", "constraint", F.when(blocking, "blocking").otherwise("warning").alias("severity"), F.when(blocking, 90).when(F.col("by_path"), 70).otherwise(50).alias("confidence"))


def predicted_artifacts(statements: DataFrame, by: str, column: str) -> DataFrame:
    """(by, category) of the artifacts that the wording of all statements of a group calls for."""
    flags = statements.groupBy(by).agg(*(F.bool_or(F.col(column).rlike(p)).alias(f"c{i}") for i, (_, p) in enumerate(ARTIFACTS)))
    names = F.filter(F.array(*(F.when(F.col(f"c{i}"), name) for i, (name, _) in enumerate(ARTIFACTS))), lambda x: x.isNotNull())
    return flags.select(by, F.explode(names).alias("category"))


def symbol_changes(before: DataFrame, after: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """(keys, change): symbols added, removed or of another signature between two sets of facts."""
    old, new = before.select(*keys, F.col(signature).alias("_old"), F.lit(True).alias("_was")), after.select(*keys, F.col(signature).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return old.join(new, keys, "full_outer").select(*keys, change.alias("change")).filter("change is not null")
