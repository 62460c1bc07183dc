"""Matching of concepts, paths and search terms against nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.graph import small, staged

# Fixed values of the search: channels with their weights, and the types that are searched.
NAME, PATH, KIND, NEAR = 0.34, 0.12, 0.06, 0.10
MOST_NEIGHBOURS, MOST_SCORE = 24, 0.85
#: Up to so many nodes (an id and a few flags each) are broadcast.
MOST_MET = 2_000_000
SEARCHABLE = (
    "service", "module", "package", "class", "interface", "function", "method", "api-endpoint", "controller", "handler", "job", "cli-command", "ui-component", "page", "form", "test", "file", "symbol",
    "domain-event", "topic", "queue", "subscription", "publisher", "consumer", "webhook", "external-api", "third-party-service", "outbox-record", "push-endpoint", "projection",
    "unresolved-external-boundary", "migration", "table", "column", "field", "schema", "configuration-file", "locale-bundle", "translation-key", "json-schema", "openapi-document",
    "openapi-operation", "template", "event-definition", "generated-contract", "pubsub-topic", "pubsub-subscription", "cloud-run-service", "cloud-run-job", "terraform-resource",
    "terraform-module", "environment-variable", "bounded-context", "aggregate", "entity", "value-object", "command", "query",
)
# Intent of a query by the first pattern that fits, else implementation.
INTENTS = (
    ("validation", r"(?i)\b(guard|invariant|constraint|rule|enforce|ci check|lint|policy|allowlist|forbidden)\b"),
    ("tests", r"(?i)\b(test|spec|fixture|golden|assertion|coverage)\b"),
    ("runtime", r"(?i)\b(deploy|terraform|cloud run|container|environment variable|env var|gateway|aggregator|topology|infra)\b"),
    ("architecture", r"(?i)\b(architecture|boundary|layer|module structure|bounded context|dependency direction)\b"),
    ("ownership", r"(?i)\b(owner|owns|team|responsible|maintainer)\b"),
    ("planning", r"(?i)\b(plan|impact|affected|change surface|requirement)\b"),
)
# Weight of a hit by intent and role, the roles in this order.
ROLES = ("fixture", "test", "guard", "runtime", "source")
INTENT_WEIGHTS = {
    "implementation": (0.4, 0.5, 0.8, 1.0, 1.0), "planning": (0.4, 0.5, 0.8, 1.0, 1.0), "validation": (0.4, 1.3, 1.6, 1.0, 1.0), "tests": (0.4, 1.6, 0.7, 0.7, 0.7),
    "runtime": (0.4, 0.5, 1.0, 1.6, 1.0), "architecture": (0.4, 0.6, 1.3, 1.0, 1.0), "ownership": (0.4, 1.0, 1.0, 1.0, 1.0),
}
MEMBERS = ("field", "column", "enum-member", "union-literal", "translation-key", "config-key", "method")
HITS_PER_FILE = 2
# Suffixes of names that say what a thing is in the architecture, not what it is about.
ARCHITECTURAL = ("controller", "service", "repository", "module", "handler", "adapter", "provider", "store", "factory", "gateway", "client", "dto", "config")
MOST_SIMILAR, MOST_MATCHES, LEAST_COVERAGE, LEAST_SEGMENT = 3, 5, 0.6, 6


def may_meet(text: Column) -> Column:
    """Whether a text can have a stem of ``q_stems``: it has its letters, as a stem is a part of the text but for case."""
    return F.exists("q_stems", lambda q: F.contains(F.lower(text), q))


def near_stems(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(id, h_near): how many of the (up to ``most``) stems ``q_stems`` of ``wanted``, one row, the names of the first neighbours of a node have.

    Neighbours with a stem are few: all others are only counted. Where a node has more neighbours than are looked at, a stem counts
    if fewer than so many of them come before the first that has it, which is a count again, so that no neighbours are ranked.
    """
    named = nodes.crossJoin(F.broadcast(wanted)).filter(may_meet(F.col("name"))).select(F.col("id").alias("other"), "q_stems", F.array_intersect("q_stems", S.stems(S.name_tokens(F.col("name")))).alias("s")).filter(F.size("s") > 0)
    flags = F.transform("q_stems", lambda q: F.array_contains("s", q))
    met = small(staged(named.groupBy("other", "q_stems").agg(F.flatten(F.collect_set("s")).alias("s")).select("other", flags.alias("flags"))), MOST_MET)
    ends = staged(edges.select("id", "source_id", "target_id"))
    way = lambda sign, a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.concat(F.lit(sign), "id").alias("hop"))
    both = ends.select(F.explode(F.array(way("0", "source_id", "target_id"), way("1", "target_id", "source_id"))).alias("w")).select("w.*")
    has = [F.coalesce(F.get("flags", i), F.lit(False)) for i in range(most)]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    counts = both.join(met, "other", "left").groupBy("id").agg(F.count("*").alias("n"), *(F.count_if(h).alias(f"k{i}") for i, h in enumerate(has)))
    counts = staged(counts.filter(total([F.col(f"k{i}") > 0 for i in range(most)]) > 0))
    few = counts.filter(F.col("n") <= MOST_NEIGHBOURS).select("id", total([F.col(f"k{i}") > 0 for i in range(most)]).alias("h_near"))
    many = staged(counts.filter(F.col("n") > MOST_NEIGHBOURS).select("id"))
    if many.isEmpty():
        return few
    firsts = small(staged(both.join(met, "other").join(small(many, MOST_MET), "id", "left_semi").groupBy("id").agg(*(F.min(F.when(h, F.col("hop"))).alias(f"m{i}") for i, h in enumerate(has)))), MOST_MET)
    ahead = both.join(firsts, "id").groupBy("id").agg(*(F.count_if(F.col("hop") <= F.col(f"m{i}")).alias(f"c{i}") for i in range(most)))
    return few.unionByName(ahead.select("id", total([F.col(f"c{i}").between(1, MOST_NEIGHBOURS) for i in range(most)]).alias("h_near")))


def search(nodes: DataFrame, edges: DataFrame, text: str, tokens: list[str]) -> DataFrame:
    """(id, match_kind, score) of the searchable nodes that a query meets: by name (exact, or but for case and punctuation),
    else by the share of its stems in name, path, type and the names of up to 24 neighbours (outgoing edges first, by id).

    ``tokens`` are those of the query text, whose stems of three letters or more count.
    """
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(text, tokens)], "text string, tokens array<string>").select(
        S.normalized(F.col("text")).alias("q"), S.normalized(S.without_extension(F.col("text"))).alias("q_bare"), F.array_distinct(F.filter(F.transform("tokens", S.stem), lambda t: F.length(t) >= 3)).alias("q_stems"))
    held = nodes.filter(F.col("type").isin(*SEARCHABLE))
    rows = held.join(near_stems(nodes, edges, wanted, len(tokens)), "id", "left").crossJoin(F.broadcast(wanted))
    hits = lambda text: F.when(may_meet(text), F.size(F.array_intersect("q_stems", S.stems(S.name_tokens(text))))).otherwise(0)
    rows = rows.select("*", hits(F.col("name")).alias("h_name"), hits(F.coalesce("path", F.lit(""))).alias("h_path"), hits(F.col("type")).alias("h_kind")).fillna(0, ["h_near"])
    n = F.size("q_stems")
    total = F.col("h_name") * (NAME * 3) / n + F.col("h_path") * (PATH * 3) / n + F.col("h_kind") * (KIND * 3) / n + F.col("h_near") * (NEAR * 3) / n
    same, bare = S.normalized(F.col("name")) == F.col("q"), S.normalized(S.without_extension(F.col("name"))) == F.col("q_bare")
    kind = F.when(same, "exact").when(bare, "normalized-name").when(F.col("h_name") > 0, "conceptual").when(F.col("h_near") > 0, "related").when(F.col("h_path") + F.col("h_kind") > 0, "lexical")
    score = F.when(same, 1.0).when(bare, 0.9).otherwise(F.floor(F.least(F.lit(MOST_SCORE), total) * 100 + 0.5) / 100)
    return rows.select("id", "name", "category", "type", "path", kind.alias("match_kind"), score.alias("score")).filter("match_kind is not null")


def intent_of(text: Column) -> Column:
    out = F.lit("implementation")
    for name, pattern in reversed(INTENTS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def hit_role() -> Column:
    """What a hit is, by its path, type and category."""
    path = F.coalesce("path", F.lit(""))
    test = (F.col("type") == "test") | path.rlike(r"(^|/)(tests?|__tests__|spec)/") | path.rlike(r"\.(test|spec)\.[a-z]+$")
    guard = path.rlike(r"(^|/)(ci|scripts)/") | (F.col("category") == "governance") | path.rlike(r"eslint|\.github/workflows")
    runtime = (F.col("category") == "infrastructure") | path.rlike(r"\.tf$|(^|/)(infra|terraform|deploy)/")
    return F.when(path.rlike(r"(^|/)fixtures?/"), "fixture").when(test, "test").when(guard, "guard").when(runtime, "runtime").otherwise("source")


def reranked(hits: DataFrame, intent: str) -> DataFrame:
    """``hits`` with role, their score by the intent's weight (1 at most), and overflow: members past the second of a file,
    which go after all others. Order by overflow, score (descending) and id."""
    weight = F.lit(1.0)
    for role, w in zip(ROLES, INTENT_WEIGHTS[intent], strict=True):
        weight = F.when(F.col("role") == role, w).otherwise(weight)
    rows = hits.withColumn("role", hit_role())
    rows = rows.withColumn("score", F.floor(F.least(F.lit(1.0), F.col("score") * weight) * 100 + 0.5) / 100)
    counted = ~F.col("match_kind").isin("exact", "normalized-name") & F.col("type").isin(*MEMBERS)
    place = F.row_number().over(W.partitionBy(F.coalesce("path", "id")).orderBy(F.desc("score"), "id"))
    members = rows.filter(counted).withColumn("overflow", place > HITS_PER_FILE)
    return members.unionByName(rows.filter(~counted).withColumn("overflow", F.lit(False)))


def speculative(concept: str) -> Column:
    """Whether a concept was mined from prose, not written as an identifier: such a one resolves strongly or not at all."""
    return F.contains(concept, F.lit(" ")) | F.col(concept).rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$")


def resolve_paths(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference, outcome, via, path, places) for each distinct reference: the one path (whatever its case) that it is, else that ends
    with it at a segment's start; several are ambiguous. Null paths are none. Suffixes are exploded and hash-joined."""
    asked = references.select("reference").distinct().withColumn("target", F.lower(F.regexp_replace(F.trim("reference"), r"^(?:\./)+", "")))
    paths = nodes.filter("path is not null").select("path", F.lower("path").alias("folded"))
    parts = F.split("folded", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    places = paths.groupBy("folded").agg(F.min("path").alias("path")).withColumn("target", F.explode(F.array_distinct(suffixes)))
    found = asked.filter("target <> ''").join(places, "target").withColumn("via", F.when(F.col("target") == F.col("folded"), "verbatim").otherwise("suffix"))
    verbatim = F.count_if(F.col("via") == "verbatim")
    told = found.groupBy("reference").agg(verbatim.alias("whole"), F.count("*").alias("n"), F.min_by("path", F.struct(F.col("via") != "verbatim", "path")).alias("path"))
    n = F.when(F.col("whole") > 0, F.col("whole")).otherwise(F.col("n"))
    told = told.select("reference", n.alias("places"), F.when(F.col("whole") > 0, "verbatim").otherwise("suffix").alias("via"), "path")
    one = F.col("places") == 1
    rows = asked.select("reference").join(told, "reference", "left")
    return rows.select("reference", F.when(F.col("places").isNull(), "unresolved").when(one, "resolved").otherwise("ambiguous").alias("outcome"), F.when(one, F.col("via")).alias("via"), F.when(one, F.col("path")).alias("path"), F.coalesce("places", F.lit(0)).alias("places"))


def aligned(a: Column, b: Column) -> Column:
    """Whether the shorter of two token lists stands as a run in the longer."""
    run = lambda long, short: F.exists(F.sequence(F.lit(1), F.greatest(F.size(long) - F.size(short) + 1, F.lit(1))), lambda i: F.slice(long, i, F.size(short)) == short)
    return (F.size(a) > 0) & (F.size(b) > 0) & F.when(F.size(a) <= F.size(b), run(b, a)).otherwise(run(a, b))


def coverage(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


def stem_of(tokens: Column) -> Column:
    """Name tokens without the architectural ones at the end."""
    keep = F.aggregate(F.reverse(tokens), F.struct(F.lit(True).alias("tail"), F.array().cast("array<string>").alias("kept")), lambda s, t: F.struct((s["tail"] & t.isin(*ARCHITECTURAL)).alias("tail"), F.when(s["tail"] & t.isin(*ARCHITECTURAL), s["kept"]).otherwise(F.concat(F.array(t), s["kept"])).alias("kept")))
    return keep["kept"]


def similar_names(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(concept, name): names that a concept resembles: one's tokens are a run in the other's and the shorter has at least 0.6 of the
    longer's letters, or the concept is the name but for its architectural suffixes. Equal ones are none. Pairs come from a shared token
    or from the letters of the stem, never from all names with all.
    """
    side = lambda df, c: df.select(c).distinct().withColumn("t", S.name_tokens(S.without_extension(F.col(c)))).withColumn("n", S.normalized(S.without_extension(F.col(c)))).filter("n <> ''")
    left, right = side(concepts, "concept"), side(names, "name")
    one = left.select("concept", F.col("t").alias("ct"), F.col("n").alias("cn"), F.explode(F.array_distinct("t")).alias("token"))
    other = right.select("name", F.col("t").alias("nt"), F.col("n").alias("nn"), F.explode(F.array_distinct("t")).alias("token"))
    whole = right.withColumn("st", F.array_join(stem_of(F.col("t")), "")).select("name", F.col("t").alias("nt"), F.col("n").alias("nn"), F.col("st").alias("token"))
    glued = left.select("concept", F.col("t").alias("ct"), F.col("n").alias("cn"), F.array_join("t", "").alias("token")).join(whole, "token")
    pairs = one.join(other, "token").unionByName(glued).filter("cn <> nn").drop("token")
    alike = aligned(F.col("ct"), F.col("nt")) & (coverage(F.col("cn"), F.col("nn")) >= LEAST_COVERAGE)
    stem = stem_of(F.col("nt"))
    covers = (F.size(stem) > 0) & (F.size(stem) < F.size("nt")) & (F.array_join("ct", "") == F.array_join(stem, ""))
    return pairs.filter(alike | covers).select("concept", "name").distinct()


def match_concepts(concepts: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(concept, outcome, id): up to five nodes for each concept, or one row without a node where it is ambiguous or unknown.

    In turn: nodes of that name (but for case and punctuation) or path, those of its alias, one to three similar names (of a concept
    that isn't speculative), then
    packages and workspaces that lie right below a directory of that name, then files. Nodes of tests count only if there are no others.
    An exact name of more than three nodes of one category in several top-level directories is ambiguous.
    """
    asked = staged(concepts.select("concept").distinct().withColumn("target", S.normalized(F.col("concept"))))
    test = (F.col("type") == "test") | F.coalesce(F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z0-9]+$"), F.lit(False))
    held = staged(nodes.select("id", "category", "type", "name", "path", S.normalized(F.col("name")).alias("target"), test.alias("is_test")))
    part_of = F.col("type").isin(*MEMBERS)  # a phrase never names a member
    named = asked.filter("target <> ''").join(held.select("id", "target", part_of.alias("member")), "target").filter(~(speculative("concept") & F.col("member"))).select("concept", "id")
    pathed = asked.join(held.select("id", F.col("path").alias("concept")), "concept").select("concept", "id")
    exact = staged(named.unionByName(pathed).distinct().withColumn("tier", F.lit(0)).withColumn("mechanism", F.lit("exact")))
    other = aliases.select("concept", S.normalized(F.col("alias")).alias("target")).join(asked.select("concept"), "concept", "left_semi")
    by_alias = other.join(held.select("id", "target"), "target").select("concept", "id", F.lit(1).alias("tier"), F.lit("alias").alias("mechanism"))
    rest = staged(asked.join(exact.select("concept"), "concept", "left_anti"))
    alike = staged(similar_names(rest.filter(~speculative("concept")), held).join(held.select("name", "id"), "name").select("concept", "id").distinct())
    few = alike.groupBy("concept").agg(F.count("*").alias("n"))
    similar = alike.join(few.filter(F.col("n") <= MOST_SIMILAR), "concept").select("concept", "id", F.lit(2).alias("tier"), F.lit("name-similarity").alias("mechanism"))
    parts = F.split("path", "/")
    folders = held.filter("path is not null").select("id", "type", F.size(parts).alias("depth"), F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at", "folder")).withColumn("target", S.normalized(F.col("folder")))
    below = rest.filter(F.length("target") >= LEAST_SEGMENT).join(folders, "target").withColumn("gap", F.col("depth") - F.col("at"))
    box = F.col("type").isin("package", "workspace") & (F.col("gap") == 2)
    segment = below.filter(box | (F.col("type") == "file")).select("concept", "id", F.when(box, 3).otherwise(4).alias("tier"), F.lit("path-segment").alias("mechanism")).distinct()
    every = exact.unionByName(by_alias).unionByName(similar).unionByName(segment).join(held.select("id", "category", "path", "is_test"), "id")
    best = every.groupBy("concept").agg(F.min("tier").alias("tier"))
    chosen = every.join(best, ["concept", "tier"])
    live = chosen.groupBy("concept").agg(F.bool_and("is_test").alias("only_tests"))
    chosen = staged(chosen.join(live, "concept").filter("only_tests or not is_test"))
    spread = chosen.filter(F.col("tier") == 0).groupBy("concept", "category").agg(F.count("*").alias("n"), F.count_distinct(F.split_part("path", F.lit("/"), F.lit(1))).alias("places"))
    clash = spread.filter((F.col("n") > MOST_SIMILAR) & (F.col("places") > 1)).select("concept").distinct()
    place = F.row_number().over(W.partitionBy("concept").orderBy("id"))
    kept = chosen.join(clash, "concept", "left_anti").withColumn("place", place).filter(F.col("place") <= MOST_MATCHES).select("concept", F.col("mechanism").alias("outcome"), "id")
    unclear = few.select("concept").unionByName(clash).distinct().join(kept.select("concept"), "concept", "left_anti").select("concept", F.lit("ambiguous").alias("outcome"))
    missing = asked.select("concept").join(kept.select("concept"), "concept", "left_anti").join(unclear.select("concept"), "concept", "left_anti").select("concept", F.lit("unknown").alias("outcome"))
    return kept.unionByName(unclear.unionByName(missing).withColumn("id", F.lit(None).cast("string")))


def resolve_symbols(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, grade, n, id): nodes by id, else by name, else by normalised name, else by the last part of a dotted name; several are ambiguous (no id)."""
    asked = queries.select("query").distinct().withColumn("norm", S.normalized(F.col("query")))
    keys = nodes.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("grade"), k.alias("key")) for i, k in enumerate((F.col("id"), F.col("name"), S.normalized(F.col("name")), F.element_at(F.split("name", r"\."), -1)))))).alias("k")).select("id", "k.*")
    wanted = asked.select("query", F.explode(F.array(*(F.struct(F.lit(i).alias("grade"), F.col(c).alias("key")) for i, c in enumerate(("query", "query", "norm", "query"))))).alias("k")).select("query", "k.*")
    found = wanted.join(keys, ["grade", "key"]).groupBy("query", "grade").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = found.groupBy("query").agg(F.min_by(F.struct("grade", "n", "id"), "grade").alias("b"))
    rows = asked.select("query").join(best, "query", "left")
    return rows.select("query", F.col("b.grade").alias("grade"), F.coalesce("b.n", F.lit(0)).alias("n"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a glob: ``**`` any folders, ``*`` and ``?`` within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_- " else "\\" + c), i + 1
    return f"^{out}$"


def last_glob(paths: DataFrame, path: str, globs: list[tuple[str, str | None]], name: str) -> DataFrame:
    """``paths`` with the value of the last glob that fits (null values too), by one expression and without a join."""
    out = F.lit(None).cast("string")
    for glob, value in globs:
        out = F.when(F.col(path).rlike(glob_pattern(glob)), F.lit(value)).otherwise(out)
    return paths.withColumn(name, out)
