"""Checks of a plan's requirements before anything is built: every analyzer always runs, and says so where it could not.

An analyzer is a function of named inputs, which are DataFrames; ``ANALYZERS`` lists them with what each reads. Inputs are shared
and lazy: one that no analyzer of a run reads is never computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import walks as K
from graphloom.operators.constraints import checkable
from graphloom.operators.graph import small, staged
from graphloom.operators.review import constraint_findings

# How wording proposes a relationship, by mechanism.
MECHANISMS = (
    ("http", r"(?i)\b(https?\b|rest\b|http call|api call|calls? the [\w-]*\s*(?:service|api)|fetch(?:es|ed)? from|requests? (?:from|to) the|service[- ]to[- ]service|peer[- ]service)\b"),
    ("event", r"(?i)\b(publish(?:es|ed)?|emit(?:s|ted)?|enqueue(?:s|d)?|pub/?sub|topic|message queue)\b"),
    ("direct-data-access", r"(?i)\b(quer(?:y|ies|ying)|read(?:s)? (?:from )?the [\w-]* (?:table|collection|database)|writes? directly to|direct(?:ly)? (?:access(?:es)?|read|write)s?)\b"),
    ("import", r"(?i)\b(import(?:s|ing|ed)?|depends? on|uses the [\w-]+ (?:package|module|library)|requires? the)\b"),
    ("configuration", r"(?i)\b(configure[sd]?|sets? the environment|environment variables?|env var)\b"),
)
SURE = {2: 85, 1: 60, 0: 40}
# Members that a text mentions, which types have members, and how sentences speak of them.
MEMBER = r"\b([A-Za-z][A-Za-z0-9_]+)\.([A-Za-z][A-Za-z0-9_]+)\b"
CONTAINERS = ("enum", "class", "interface", "symbol", "schema", "locale-bundle", "configuration-file")
MEMBERS = ("enum-member", "union-literal", "field", "column", "translation-key", "config-key", "feature-flag", "method")
NO_MEMBERS = ("js", "ts", "tsx", "jsx", "py", "md", "go", "rs", "sh", "css", "yml", "yaml", "json", "toml", "txt", "html", "sql", "xml", "csv", "env", "lock")
ASSERTS = r"(?i)\b(uses?|using|references?|reads?|checks?|matches?|equals?|is set to|returns?|when|if|existing|already)\b"
CREATES = r"(?i)\b(add|adds|adding|new|create|creates|creating|introduce|introduces|extend|extends)\b"
CLOSED_TYPES = ("enum", "locale-bundle", "configuration-file")
CLOSED_KINDS = ("enum-member", "union-literal", "translation-key", "config-key", "feature-flag")
# Defaults that are there and say nothing.
HOLLOW = ("{}", "[]", '""', "''", '" "', "{ }", "[ ]")
ABSENT = r"(?i)^(none|null|nil|undefined|false|0)$"

SCHEMA = ("analyzer", "requirement", "kind", "severity", "confidence", "subject", "detail")


def finding(df: DataFrame, analyzer: str, requirement, kind, severity, confidence, subject, detail=None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str | int) or x is None else x
    values = (lit(analyzer), lit(requirement).cast("string"), lit(kind), lit(severity), lit(confidence).cast("int"), lit(subject).cast("string"), lit(detail).cast("string"))
    return df.select(*(v.alias(c) for v, c in zip(values, SCHEMA, strict=True)))


def container_of(path: Column) -> Column:
    """The top-level container of a path: its first two folders."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, parts[0]).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))


def proposed_edges(requirements: DataFrame, concepts: DataFrame) -> DataFrame:
    """(requirement, mechanism, source_ref, source_path, target_ref, target_path, confidence): what statements propose.

    ``requirements`` has (requirement, statement), ``concepts`` (requirement, ref, id, path), id and path null where a term named
    nothing; in the order of ``place``. Of the terms that aren't parts of longer ones (all, if fewer than two are left) the first
    two in the text that lie in different containers are the ends, else the first two; the earlier is the source, but for a
    "from" right before it. Each mechanism that the wording fits is proposed.
    """
    ref, low = F.lower("ref"), lambda x: F.lower(x["ref"])
    held = concepts.join(requirements, "requirement").withColumn("at", F.expr("locate(lower(ref), lower(statement))")).withColumn("at", F.when(F.col("at") > 0, F.col("at")))
    term = F.struct(F.coalesce("at", F.lit(2**31 - 1)).alias("order"), "place", "ref", "id", "path", "at")
    lists = held.groupBy("requirement").agg(F.any_value("statement").alias("statement"), F.array_sort(F.collect_list(term)).alias("all")).filter(F.size("all") >= 2)
    whole = F.filter("all", lambda a: ~F.exists("all", lambda b: (F.length(b["ref"]) > F.length(a["ref"])) & F.contains(low(b), low(a))))
    lists = lists.withColumn("whole", whole).withColumn("pool", F.when(F.size("whole") >= 2, F.col("whole")).otherwise(F.col("all")))
    apart = lambda a, b: F.coalesce(container_of(a["path"]) != container_of(b["path"]), F.lit(False))
    later = lambda i: F.expr("size(pool)") - i - 1
    pairs = F.flatten(F.transform("pool", lambda a, i: F.transform(F.filter(F.slice("pool", i + 2, F.greatest(later(i), F.lit(0))), lambda b: apart(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    first = F.coalesce(F.get(pairs, 0), F.struct(F.col("pool")[0].alias("a"), F.col("pool")[1].alias("b")))
    ends = lists.select("requirement", "statement", first.alias("e")).select("requirement", "statement", "e.a", "e.b")
    both = F.col("a.at").isNotNull() & F.col("b.at").isNotNull()
    swap = both & (F.col("b.at") < F.col("a.at"))
    earliest = F.least("a.at", "b.at")
    before = F.expr("substring(statement, greatest(1, least(a.at, b.at) - 12), least(a.at, b.at) - greatest(1, least(a.at, b.at) - 12))")
    fronted = both & earliest.isNotNull() & before.rlike(r"(?i)\bfrom\s+(?:the\s+)?$")
    turned = swap != fronted
    ends = ends.select("requirement", "statement", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("t"))
    known = F.col("s.id").isNotNull().cast("int") + F.col("t.id").isNotNull().cast("int")
    sure = reduce(lambda out, kv: F.when(known == kv[0], kv[1]).otherwise(out), SURE.items(), F.lit(None).cast("int"))
    names = F.filter(F.array(*(F.when(F.col("statement").rlike(p), n) for n, p in MECHANISMS)), lambda x: x.isNotNull())
    return ends.select("requirement", F.explode(names).alias("mechanism"), F.col("s.ref").alias("source_ref"), F.col("s.path").alias("source_path"), F.col("t.ref").alias("target_ref"), F.col("t.path").alias("target_path"), sure.alias("confidence"))


def check_constraints(requirements: DataFrame, concepts: DataFrame, constraints: DataFrame) -> DataFrame:
    rules, spared = checkable(constraints)
    found = constraint_findings(proposed_edges(requirements, concepts), rules, spared)
    best = found.groupBy("requirement", "constraint").agg(F.min_by(F.struct("severity", "confidence"), F.struct("severity", -F.col("confidence"))).alias("b"))
    kind = F.when(F.col("b.severity") == "blocking", "constraint-violation").otherwise("constraint-warning")
    return finding(best, "check-constraints", F.col("requirement"), kind, F.col("b.severity"), F.col("b.confidence"), F.col("constraint"))


def check_guidance(concepts: DataFrame, constraints: DataFrame) -> DataFrame:
    """Decisions that govern a place which a requirement names."""
    advice = constraints.filter("kind = 'architecture-guidance'").select(F.col("name").alias("decision"), F.col("path").alias("file"), F.explode("scope").alias("glob"))
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("glob", r"([.+^${}()|\[\]\\?])", r"\\$1"), F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("$"))
    advice = advice.withColumn("regex", F.replace(regex, F.lit("\u0001"), F.lit(".*")))
    named = concepts.filter("path is not null").select("requirement", "path").distinct()
    met = named.join(small(advice), F.regexp_like("path", F.col("regex"))).select("requirement", "decision", "file").distinct()
    return finding(met, "check-guidance", F.col("requirement"), "constraint-warning", "informational", 60, F.col("decision"), F.col("file"))


def check_assumptions(requirements: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members that statements take for granted and that their containers, with all they inherit from, do not declare.

    What a sentence says before a member decides: one that only creates assumes nothing. A container whose hierarchy declares no member at all says nothing.
    Where the hierarchy leaves what is indexed (and the members aren't a closed list), the member could not be verified.
    """
    of = lambda g: F.regexp_extract_all("statement", F.lit(MEMBER), F.lit(g))
    texts = requirements.select("requirement", of(0).alias("whole"), of(1).alias("q"), of(2).alias("m"), F.split("statement", MEMBER, -1).alias("between")).filter(F.size("whole") > 0)
    ahead = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(""), lambda out, k: F.concat(out, F.get("between", k), F.when(k < i, F.get("whole", k)).otherwise("")))
    each = F.transform("whole", lambda _, i: F.struct(F.get("q", i).alias("qualifier"), F.get("m", i).alias("member"), F.regexp_extract(F.concat(ahead(i), F.get("q", i)), r"[^.]*$", 0).alias("sentence")))
    said = texts.select("requirement", F.posexplode(each).alias("nth", "x")).select("requirement", "nth", "x.*").filter(~F.col("member").isin(*NO_MEMBERS))
    said = said.groupBy("requirement", "qualifier", "member").agg(F.min_by("sentence", "nth").alias("sentence"))
    said = staged(said.filter(~F.col("sentence").rlike(CREATES) | F.col("sentence").rlike(ASSERTS)))
    held = nodes.filter(F.col("type").isin(*CONTAINERS)).select("id", "type", "name")
    exact = said.join(held.withColumnRenamed("name", "qualifier"), "qualifier").select("requirement", "qualifier", "member", "id", "type")
    loose = said.filter(F.col("qualifier").rlike("^[a-z]")).join(exact.select("requirement", "qualifier", "member").distinct(), ["requirement", "qualifier", "member"], "left_anti")
    loose = loose.join(held.withColumn("low", F.lower("name")).drop("name"), F.lower("qualifier") == F.col("low")).select("requirement", "qualifier", "member", "id", "type")
    asked = staged(exact.unionByName(loose))
    known = nodes.filter(F.col("type").isin(*MEMBERS, *CONTAINERS, K.OPEN))
    got = staged(K.resolve_members(known, edges, asked.select("id", "member").distinct()))
    # what a hierarchy declares: the kinds of members of the container and of all its supertypes
    up = edges.filter(F.col("type").isin(*K.HERITAGE)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    reach = staged(asked.select("id").distinct().withColumn("at", F.col("id")))
    every = reach
    for _ in range(16):
        reach = staged(reach.join(up, F.col("at") == F.col("a")).select("id", F.col("b").alias("at")).distinct().join(every, ["id", "at"], "left_anti"))
        if reach.isEmpty():
            break
        every = every.unionByName(reach)
    own = edges.filter(F.col("type").isin(*K.MEMBERSHIP)).join(nodes.filter(F.col("type").isin(*MEMBERS)).select(F.col("id").alias("target_id"), F.col("type").alias("kind")), "target_id").select(F.col("source_id").alias("at"), "kind").distinct()
    declared = every.join(own, "at").groupBy("id").agg(F.bool_or(F.col("kind").isin(*CLOSED_KINDS)).alias("listed"))
    rows = asked.join(got.select("id", "member", "outcome", "open"), ["id", "member"]).join(declared, "id", "left")
    open_ = F.coalesce("open", F.lit(False)) & ~F.col("type").isin(*CLOSED_TYPES) & ~F.coalesce("listed", F.lit(False))
    rows = rows.withColumn("absent", (F.col("outcome") == "not-found") & F.col("listed").isNotNull()).withColumn("unsure", F.col("absent") & open_)
    judged = rows.groupBy("requirement", "qualifier", "member").agg(F.bool_or(F.col("outcome") == "found").alias("found"), F.bool_or("absent").alias("absent"), F.bool_or("unsure").alias("unsure"))
    judged = judged.filter("absent and not found")
    return finding(judged, "check-assumptions", F.col("requirement"), "invalid-assumption", F.when(F.col("unsure"), "warning").otherwise("blocking"), F.when(F.col("unsure"), 60).otherwise(90), F.concat_ws(".", "qualifier", "member"), F.when(F.col("unsure"), "unverified-assumption").otherwise("verified-contradiction"))


def config_gaps(paths: DataFrame, topology: DataFrame, processes: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The processes on each path, (start, reason, at, hop), and of those the ones that lack what is needed, with missing (sorted names).

    ``paths`` are as ``walks.runtime_paths`` gives them, ``processes`` (id, name) what each process receives, ``needs`` (name).
    """
    serving = topology.filter(F.col("type").isin(*(t for t, kind in K.HOP_KINDS.items() if kind == "process"))).select(F.col("id").alias("hop"))
    hops = paths.select("start", "reason", F.posexplode(F.split("hops", ">")).alias("at", "hop")).join(small(serving), "hop")
    wanted = needs.agg(F.array_sort(F.collect_set("name")).alias("wanted"))  # what a plan needs: a short list
    given = processes.groupBy(F.col("id").alias("hop")).agg(F.collect_set("name").alias("given"))
    missing = F.array_except("wanted", F.coalesce("given", F.array().cast("array<string>")))
    return hops, hops.join(small(given), "hop", "left").crossJoin(F.broadcast(wanted)).select("start", "reason", "at", "hop", missing.alias("missing")).filter(F.size("missing") > 0)


def check_runtime(topology: DataFrame, links: DataFrame, starts: DataFrame, processes: DataFrame, needs: DataFrame, plan: DataFrame) -> DataFrame:
    """What traffic meets on its way and the plan misses: processes without needed configuration; else a way that could not be read
    to its end, and a serving process that the plan does not touch.

    ``topology`` (id, type) and ``links`` make the paths from ``starts`` (id); ``processes`` has (id, name) of the configuration that
    a process receives, ``needs`` (name), ``plan`` (id) what the plan configures.
    """
    paths = staged(K.runtime_paths(topology, links, starts))
    hops, gaps = config_gaps(paths, topology, processes, needs)
    gaps = staged(gaps)
    sure = F.col("reason").isNull()
    out = finding(gaps, "check-runtime", None, "runtime-topology-gap", F.when(sure, "blocking").otherwise("warning"), F.when(sure, 85).otherwise(55), F.concat("start", F.lit(" at "), "hop"), F.array_join("missing", ", "))
    clear = paths.join(gaps.select("start").distinct(), "start", "left_anti")
    lost = finding(clear.filter("reason is not null"), "check-runtime", None, "analysis-caveat", "warning", 50, F.col("start"), F.col("reason"))
    last = hops.join(gaps.select("start").distinct(), "start", "left_anti").groupBy("start").agg(F.max_by("hop", "at").alias("id"))
    touched = plan.select("id").distinct()
    unplanned = last.join(touched, "id", "left_anti").join(small(touched.limit(1).select(F.lit(1).alias("any"))), F.lit(True), "left_semi")
    return out.unionByName(lost).unionByName(finding(unplanned, "check-runtime", None, "runtime-topology-gap", "warning", 65, F.concat("start", F.lit(" at "), "id"), "not in the plan"))


def config_semantic(default: Column, tolerant: Column) -> Column:
    """What a declared default means where a value was never set."""
    bare = F.trim(default)
    inner = F.trim(F.regexp_replace(bare, r"(?s)^[\"'](.*)[\"']$", "$1"))
    hollow = bare.isin(*HOLLOW) | inner.isin(*HOLLOW) | (inner == "")
    return F.when(default.isNull(), F.when(tolerant, "fail-open-default").otherwise("required")).when(hollow, "empty-but-truthy-default").when(inner.rlike(ABSENT) & tolerant, "fail-open-default").otherwise("defaulted")


def check_config_semantics(declarations: DataFrame) -> DataFrame:
    """``declarations`` has (name, path, default, tolerant): defaults that hide that nothing was set."""
    rows = declarations.withColumn("meaning", config_semantic(F.col("default"), F.coalesce("tolerant", F.lit(False)))).filter(F.col("meaning").isin("empty-but-truthy-default", "fail-open-default"))
    return finding(rows, "check-config-semantics", None, "config-semantics-risk", "warning", F.when(F.col("meaning") == "fail-open-default", 60).otherwise(80), F.concat_ws(":", "path", "name"), F.col("meaning"))


ANALYZERS = {
    "check-constraints": (check_constraints, ("requirements", "concepts", "constraints")),
    "check-guidance": (check_guidance, ("concepts", "constraints")),
    "check-assumptions": (check_assumptions, ("requirements", "nodes", "edges")),
    "check-runtime": (check_runtime, ("topology", "links", "starts", "processes", "needs", "plan")),
    "check-config-semantics": (check_config_semantics, ("declarations",)),
}


def preflight(inputs: dict[str, DataFrame | None], spark, analyzers=None) -> DataFrame:
    """The findings of all analyzers (``SCHEMA``). One that lacks an input gives one informational row that names what it lacks, so
    that no findings always means that something looked."""
    every = []
    for name, (run, needs) in (analyzers or ANALYZERS).items():
        absent = [n for n in needs if inputs.get(n) is None]
        if absent:
            every.append(finding(spark.range(1), name, None, "not-run", "informational", 0, ", ".join(absent)))
        else:
            every.append(run(*(inputs[n] for n in needs)))
    return reduce(DataFrame.unionByName, every)


def by_importance(findings: DataFrame) -> list[Column]:
    """The order of findings: the strongest first."""
    rank = F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return [rank, F.desc("confidence"), F.col("analyzer"), F.col("requirement"), F.col("subject")]


def verdicts(requirements: DataFrame, findings: DataFrame) -> DataFrame:
    """(requirement, verdict, findings): BLOCKED where a finding blocks, NEEDS_VERIFICATION where one warns, else READY. Findings
    of no requirement hold for all."""
    worst = F.when(F.bool_or(F.col("severity") == "blocking"), "BLOCKED").when(F.bool_or(F.col("severity") == "warning"), "NEEDS_VERIFICATION").otherwise("READY")
    own = findings.filter("requirement is not null and kind <> 'not-run'").select("requirement", "severity")
    shared = findings.filter("requirement is null and kind not in ('not-run', 'analysis-caveat')").agg(F.count_if(F.col("severity") == "blocking").alias("b"), F.count_if(F.col("severity") == "warning").alias("w"))
    told = own.groupBy("requirement").agg(worst.alias("own"), F.count("*").alias("findings"))
    rows = requirements.select(F.col("requirement").cast("string")).join(told, "requirement", "left").crossJoin(F.broadcast(shared))
    verdict = F.when((F.col("own") == "BLOCKED") | (F.col("b") > 0), "BLOCKED").when((F.col("own") == "NEEDS_VERIFICATION") | (F.col("w") > 0), "NEEDS_VERIFICATION").otherwise("READY")
    return rows.select("requirement", verdict.alias("verdict"), F.coalesce("findings", F.lit(0)).alias("findings"))


def first_findings(findings: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest findings of each analyzer."""
    place = F.row_number().over(W.partitionBy("analyzer").orderBy(*by_importance(findings)))
    return findings.withColumn("place", place).filter(F.col("place") <= k).drop("place")
