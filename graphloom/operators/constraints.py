"""Constraints that a repository states about itself, out of lint settings, guard scripts, workflows, decisions and declarations.

Each recognizer reads the files of one shape and gives rows of one schema, so that another shape is another function in
``RECOGNIZERS``. Files are read as text only; nothing in them is run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which files have which shape, and the patterns that their rules are read by.
LINT_FILES = r"(^|/)(eslint\.config\.(m?js|cjs|ts)|\.eslintrc(\.\w+)?)$"
WORKFLOWS = r"(^|/)\.(github/workflows|gitlab-ci|circleci)/?[^/]*\.(ya?ml)$|\.gitlab-ci\.yml$"
DECISIONS = r"(?i)(^|/)(adrs?|decisions)/[^/]+\.(md|markdown)$"
GUARD_FOLDERS = (r"(^|/)(ci)/(scripts|checks)/", r"(^|/)scripts/(quality|ci|checks|lint)/", r"(^|/)tools/(ci|checks)/")
GUARD_NAMES = r"(^|/)(check|verify|validate|enforce|assert)[-_][\w-]+\.(py|sh|ts|js|mjs)$"
GUARD_ENDINGS = r"\.(py|sh|ts|js|mjs)$"
TESTS = r"(^|/)(test|tests|__tests__|fixtures)/|\.(test|spec)\.\w+$"
SOURCES = r"(^|/)src/"
ELEMENT = r"\{\s*type:\s*['\"]([\w-]+)['\"]\s*,\s*pattern:\s*['\"]([^'\"]+)['\"]"
LAYER = r"\{\s*from:\s*['\"]([\w-]+)['\"]\s*,\s*allow:\s*\[([^\]]*)\]\s*\}"
NO_DEFAULT = r"['\"]?default['\"]?\s*:\s*['\"]disallow['\"]"
RESTRICTED = r"files:\s*\[([^\]]*)\][\s\S]{0,600}?'no-restricted-imports':\s*\[[^\]]*?(paths|patterns):\s*([\s\S]{0,400}?)\}\s*\]"
COMMAND = r"^\s*(?:-\s*)?(?:run:\s*)?(?:.*?\s)?((?:python3?|node|bash|sh|npx|pnpm|npm run|yarn)\s+[^\n|&;]*(?:ci/scripts/|scripts/quality/|check[-_][\w-]+|verify[-_][\w-]+|validate[-_][\w-]+|quality:\w+|lint)[^\n|&;]*)"
SCRIPT = r"(\S*(?:ci/scripts|scripts/quality)/\S+)"
ACCEPTED = r"(?i)(^|\n)\s*(?:\*{0,2}status\*{0,2}\s*[:*]?\s*|## status\s*\n+\s*)accepted\b"
MENTION = r"\b((?:packages|apps|services|libs|src|scripts|infra|ci)/[A-Za-z0-9_-]+)"
MOST_MENTIONS, HEAD = 8, 4096
GUARD_PATTERNS = (r"re\.compile\(\s*r?[\"']([^\"'\n]{3,200})[\"']", r"new RegExp\(\s*[\"']([^\"'\n]{3,200})[\"']", r"/((?:[^/\\\n]|\\.){4,200})/[gimsuy]*\.test\(")
COLLECTION = r"(?:const|let|var|readonly)?\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=\s*(?:new\s+Set\s*\(\s*)?[\[{(]([\s\S]{0,2000}?)[\]})]"
ALLOWING = r"(?i)^(allow|allowed|allowlist|whitelist|exempt|exemptions|permitted|exceptions)"
COMPUTED = r"[A-Za-z_][A-Za-z0-9_]*\s*(?:\(|\.)"
FOLDERS = (r"Path\(\s*[\"']([^\"'\n]+)[\"']\s*\)", r"(?:rglob|glob|walk|iterdir)\(\s*[\"']?([^\"'\n)]*)[\"']?\s*\)", r"(?:SERVICE_DIRS?|SOURCE_DIRS?|ROOTS?|SCAN_DIRS?)\s*=\s*[\"']([^\"'\n]+)[\"']")
FAILING = r"sys\.exit\(\s*[1-9]|process\.exit\(\s*[1-9]|exit\s+[1-9]|raise\s+SystemExit|assert\s|throw new Error"
CALLS = r"(?i)http|requests\.|httpx|fetch\(|axios|urlopen|HttpClient|grpc"
IMPORTS = r"(?i)import|\bfrom\b|require|#include"
# How far a rule may be trusted, most first; what is only seen can't block.
AUTHORITY = ("declared", "recognized", "opaque")

COLUMNS = ("path", "recognizer", "name", "kind", "severity", "extraction", "relation", "scope", "targets", "subject", "exempt", "line")


def breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def occurrences(text: Column, pattern: str, groups: int = 1) -> Column:
    """All matches of a pattern in order: an array of (line, g1, g2, ...), lines from 1."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
    total = lambda a: F.aggregate(F.transform(a, breaks), F.lit(0), lambda s, n: s + n)
    line = lambda i: (1 + total(F.slice(between, 1, i + 1)) + total(F.slice(whole, 1, i))).alias("line")
    return F.transform(whole, lambda _, i: F.struct(line(i), *(F.get(p, i).alias(f"g{g + 1}") for g, p in enumerate(parts))))


def quoted(text: Column, pattern: str = r"['\"]([^'\"\n]+)['\"]") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def rule(path, recognizer: str, name, kind, severity, extraction, relation, scope, targets=None, subject=None, exempt=None, line=None) -> list[Column]:
    """The columns of a constraint; what is given as text is a literal."""
    lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    none = F.array().cast("array<string>")
    lists = lambda x: none if x is None else x
    values = (path, lit(recognizer), lit(name), lit(kind), lit(severity), lit(extraction), lit(relation), scope, lists(targets), lit(subject).cast("string"), lists(exempt), lit(line).cast("int"))
    return [v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]


def lint_rules(files: DataFrame) -> DataFrame:
    """Layers that may only depend on the listed ones (a layer without a rule on nothing, where that is the default), and imports that are forbidden to some files."""
    read = files.filter(F.col("path").rlike(LINT_FILES)).select("path", "content", occurrences(F.col("content"), ELEMENT, 2).alias("elements"), occurrences(F.col("content"), LAYER, 2).alias("layers"))
    glob = lambda p: F.when(F.contains(p, F.lit("*")), p).otherwise(F.concat(p, F.lit("/**")))
    globs_of = lambda role: F.slice(F.filter("elements", lambda e: e["g1"] == role), 1, 1)
    given = read.select("path", "elements", F.explode("layers").alias("l")).select("path", "elements", F.col("l.g1").alias("layer"), quoted(F.col("l.g2"), r"['\"]([\w-]+)['\"]").alias("allowed"), F.col("l.line").alias("line"))
    bare = read.filter((F.size("layers") > 0) & F.col("content").rlike(NO_DEFAULT)).select("path", "elements", "layers", F.explode(F.array_distinct(F.transform("elements", lambda e: e["g1"]))).alias("layer"))
    bare = bare.filter(~F.exists("layers", lambda x: x["g1"] == F.col("layer"))).select("path", "elements", "layer", F.array().cast("array<string>").alias("allowed"), F.lit(1).alias("line"))
    told = given.unionByName(bare)
    home = F.transform(globs_of(F.col("layer")), lambda e: glob(e["g2"]))
    targets = F.flatten(F.transform("allowed", lambda a: F.transform(globs_of(a), lambda e: glob(e["g2"]))))
    name = F.concat("layer", F.lit(" may only depend on "), F.when(F.size("allowed") == 0, "nothing").otherwise(F.array_join("allowed", ", ")))
    layers = told.select(*rule(F.col("path"), "lint-boundaries", name, "boundary-restriction", "blocking", "recognized", "ONLY_ALLOWED_TO", F.when(F.size(home) > 0, home).otherwise(F.array(F.lit("**"))), targets, line=F.col("line")))
    blocks = files.filter(F.col("path").rlike(LINT_FILES)).select("path", F.explode(occurrences(F.col("content"), RESTRICTED, 3)).alias("b"))
    blocks = blocks.select("path", quoted(F.col("b.g1"), r"['\"]([^'\"]+)['\"]").alias("globs"), quoted(F.col("b.g3"), r"name:\s*['\"]([^'\"]+)['\"]").alias("names"), F.col("b.line").alias("line")).filter((F.size("globs") > 0) & (F.size("names") > 0))
    name = F.concat(F.col("globs")[0], F.lit(" must not import "), F.array_join("names", ", "))
    return layers.unionByName(blocks.select(*rule(F.col("path"), "lint-boundaries", name, "forbidden-dependency", "blocking", "recognized", "FORBIDS", F.col("globs"), subject=F.array_join("names", "|"), line=F.col("line"))))


def is_guard(path: Column) -> Column:
    folder = reduce(lambda a, b: a | b, [path.rlike(p) for p in GUARD_FOLDERS])
    return ~path.rlike(TESTS) & (folder | ~path.rlike(SOURCES) & path.rlike(GUARD_NAMES)) & path.rlike(GUARD_ENDINGS)


def guard_rules(files: DataFrame) -> DataFrame:
    """Scripts that forbid a pattern, with the names that they excuse; one that isn't understood is there as opaque."""
    text = F.col("content")
    read = files.filter(is_guard(F.col("path"))).select("path", "content", F.flatten(F.array(*(occurrences(text, p) for p in GUARD_PATTERNS))).alias("patterns"), occurrences(text, COLLECTION, 2).alias("lists"))
    plain = lambda c: ~F.regexp_replace(c["g2"], r"[\"'][^\"'\n]*[\"']", "").rlike(COMPUTED)
    excused = F.flatten(F.transform(F.filter("lists", lambda c: c["g1"].rlike(ALLOWING) & plain(c)), lambda c: quoted(c["g2"])))
    folders = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FOLDERS)))
    folders = F.filter(F.transform(folders, lambda f: F.trim(f)), lambda f: (f != "") & ~F.startswith(f, F.lit("*")) & ~F.contains(f, F.lit("..")))
    folders = F.array_sort(F.array_distinct(F.transform(folders, lambda f: F.regexp_replace(f, "/$", ""))))
    scope = F.when(F.size(folders) == 0, F.array(F.lit("**"))).otherwise(F.transform(folders, lambda f: F.concat(f, F.lit("/**"))))
    read = read.select("path", scope.alias("scope"), excused.alias("exempt"), F.when(text.rlike(FAILING), "blocking").otherwise("warning").alias("severity"), F.filter("patterns", lambda p: p["g1"].rlike(CALLS) | p["g1"].rlike(IMPORTS)).alias("known"))
    base = F.element_at(F.split("path", "/"), -1)
    each = read.select("path", "scope", "exempt", "severity", F.explode("known").alias("p")).withColumn("call", F.col("p.g1").rlike(CALLS))
    kind = F.when(F.col("call"), "forbidden-runtime-call").otherwise("forbidden-dependency")
    known = each.select(*rule(F.col("path"), "guard-script", F.concat(base, F.lit(": "), kind), kind, F.col("severity"), "recognized", F.when(F.col("call"), "FORBIDS").otherwise("RESTRICTS_DEPENDENCY"), F.col("scope"), subject=F.col("p.g1"), exempt=F.col("exempt"), line=F.col("p.line")))
    opaque = read.filter(F.size("known") == 0).select(*rule(F.col("path"), "guard-script", base, "opaque-check", "warning", "opaque", "MUST_PASS", F.col("scope")))
    return known.unionByName(opaque)


def workflow_rules(files: DataFrame) -> DataFrame:
    """Guards that a workflow runs and that so must pass, the first command of each script."""
    lines = files.filter(F.col("path").rlike(WORKFLOWS)).select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    runs = lines.select("path", "at", F.trim(F.regexp_extract("text", COMMAND, 1)).alias("command")).filter("command <> ''")
    script = F.regexp_extract("command", SCRIPT, 1)
    runs = runs.withColumn("key", F.when(script != "", script).otherwise(F.col("command"))).groupBy("path", "key").agg(F.min("at").alias("at"), F.min_by("command", "at").alias("command"))
    return runs.select(*rule(F.col("path"), "ci-workflow", F.concat(F.lit("CI requires: "), "key"), "must-pass-check", "blocking", "recognized", "MUST_PASS", F.array(F.lit("**")), subject=F.col("command"), line=F.col("at") + 1))


def decision_rules(files: DataFrame) -> DataFrame:
    """Accepted decisions as advice on the paths that their texts name."""
    read = files.filter(F.col("path").rlike(DECISIONS) & F.substring("content", 1, HEAD).rlike(ACCEPTED))
    heading = F.trim(F.regexp_extract(F.substring("content", 1, HEAD), r"(?m)^#\s+(.+)$", 1))
    bare = F.trim(F.regexp_replace(heading, r"(?i)^adr[-\s]?\d+\s*[:—-]\s*", ""))
    title = F.when(heading == "", F.col("path")).when(bare == "", heading).otherwise(bare)
    named = F.slice(F.array_distinct(F.regexp_extract_all("content", F.lit(MENTION), F.lit(1))), 1, MOST_MENTIONS)
    read = read.select("path", title.alias("title"), F.array_sort(F.transform(named, lambda m: F.concat(m, F.lit("/**")))).alias("scope")).filter(F.size("scope") > 0)
    return read.select(*rule(F.col("path"), "adr-guidance", F.concat(F.lit("Accepted decision: "), "title"), "architecture-guidance", "advisory", "recognized", "GOVERNS", F.col("scope"), line=F.lit(1)))


RECOGNIZERS = (lint_rules, guard_rules, workflow_rules, decision_rules)


def extracted_constraints(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Constraints (``COLUMNS``) of ``files`` (path, content), and those of ``declared``, which has the same columns.

    What is opaque never blocks. Files of no known shape, and null contents, give nothing.
    """
    every = reduce(DataFrame.unionByName, [read(files.select("path", "content").filter("content is not null")) for read in RECOGNIZERS])
    if declared is not None:
        every = every.unionByName(declared.select(*COLUMNS))
    return every.withColumn("severity", F.when((F.col("severity") == "blocking") & (F.col("extraction") == "opaque"), "warning").otherwise(F.col("severity")))


def merged_constraints(constraints: DataFrame) -> DataFrame:
    """One row for each rule (kind, relation, subject, scope and targets, whatever their order), of the source of most authority,
    with how many sources state it and all that any of them excuses."""
    rank = reduce(lambda out, kv: F.when(F.col("extraction") == kv[1], kv[0]).otherwise(out), enumerate(AUTHORITY), F.lit(len(AUTHORITY)))
    keyed = constraints.withColumn("in", F.array_sort("scope")).withColumn("to", F.array_sort("targets"))
    best = F.min_by(F.struct("path", "recognizer", "name", "severity", "extraction", "scope", "targets", "line"), F.struct(rank, "path", "line", "name"))
    made = keyed.groupBy("kind", "relation", "subject", "in", "to").agg(best.alias("b"), F.count("*").alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("exempt")))).alias("exempt"))
    return made.select("kind", "relation", "subject", "b.*", "sources", "exempt")


def checkable(constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``constraints`` as the rules, one for each scope, and exemptions that ``review.constraint_findings`` takes."""
    prefixes = lambda globs: F.transform(globs, lambda g: F.regexp_replace(g, r"\*.*$", ""))
    rows = constraints.select(F.col("name").alias("constraint"), "kind", F.explode(prefixes("scope")).alias("scope"), prefixes("targets").alias("allowed"), (F.col("severity") == "blocking").alias("authority"))
    return rows, constraints.select(F.col("name").alias("constraint"), F.explode("exempt").alias("subject")).distinct()
