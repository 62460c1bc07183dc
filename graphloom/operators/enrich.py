"""Edges that follow from joining facts: routes, injections, links across services, and the assembly of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import parts_for, small, spread, staged
from graphloom.operators.texts import route

# Files that say what they are by their path; fixed values, in this order.
DETECTORS = (("migration", r"(^|/)(migrations?|flyway|liquibase)/"), ("docker-image", r"(^|/)Dockerfile(\.[a-z]+)?$"), ("ci-check", r"(^|/)\.github/workflows/[^/]+\.ya?ml$"), ("configuration-file", r"\.(ya?ml|toml|ini)$"))

#: So many calls or endpoints of a route make a slice, of which all pairs with a slice of the other side are made in a task.
SLICE_ROWS = 1_500


def enriched(parts: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """Edges of several sources (id, type, source_id, target_id): of equal ids that of the first source, and only those whose ends are nodes."""
    ranked = reduce(DataFrame.unionByName, [df.select("id", "type", "source_id", "target_id", F.lit(i).alias("rank")) for i, df in enumerate(parts)])
    first = spread(ranked, parts_for(ranked), "id").groupBy("id").agg(F.min_by(F.struct("type", "source_id", "target_id"), F.struct("rank", "type", "source_id", "target_id")).alias("e")).select("id", "e.*")
    ends = nodes.select(F.col("id").alias("n"))
    return first.join(ends, F.col("source_id") == F.col("n"), "left_semi").join(ends, F.col("target_id") == F.col("n"), "left_semi")


def mounted_routes(handlers: DataFrame, mounts: DataFrame) -> DataFrame:
    """(handler, verb, route): each handler's own path below every prefix that its owner is mounted at; unmounted owners at the root."""
    rows = handlers.join(mounts, "owner", "left")
    whole = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", "prefix", "path")), "/{2,}", "/")
    return rows.select("handler", F.upper("verb").alias("verb"), route(whole).alias("route"))


def injections(wants: DataFrame, provides: DataFrame) -> DataFrame:
    """(consumer, provider, type_name): a provider for each wanted type that exactly one component provides."""
    only = provides.groupBy("type_name").agg(F.count_distinct("provider").alias("n"), F.min("provider").alias("provider")).filter("n = 1")
    return wants.join(only, "type_name").select("consumer", "provider", "type_name")


def placeholders(values: DataFrame, column: str, settings: DataFrame, module: str | None = None) -> DataFrame:
    """``values`` with resolved and refusal, one of which is null: what ``${key}`` or ``${key:default}`` stands for.

    A text that is not just one placeholder, or not a bare name in the end (it has white space or a slash), is refused, and so is a
    key that is set to several values, to another placeholder (nothing is expanded twice), or to nothing without a default. With
    ``module``, a column of both tables, a setting holds in its own module.
    """
    by = ["_module"] if module else []
    own = F.col(module) if module else F.lit(None)
    agreed = settings.select("key", "value", own.alias("_module")).groupBy(F.col("key").alias("_key"), "_module").agg(F.count_distinct("value").alias("_n"), F.min("value").alias("_set"))
    agreed = agreed if by else agreed.drop("_module")
    pattern = r"^\$\{([^{}:]+)(?::([^{}]*))?\}$"
    whole, key, default = F.col(column).rlike(pattern), F.trim(F.regexp_extract(column, pattern, 1)), F.regexp_extract(column, pattern, 2)
    rows = values.withColumn("_key", F.when(whole & (key != ""), key)).withColumn("_module", own)
    rows = rows.join(agreed, ["_key", *by], "left")
    found = F.when(F.col("_n") == 1, F.col("_set")).when(F.col("_n").isNull() & (default != ""), default)
    bare = found.rlike(r"^[^\s/]+$")
    refusal = (
        F.when(F.col("_key").isNull(), "not-a-placeholder").when(F.col("_n") > 1, "conflict").when((F.col("_n") == 1) & F.contains("_set", F.lit("${")), "nested")
        .when(found.isNull(), "unknown-key").when(~bare, "not-a-bare-name")
    )
    return rows.select(*values.columns, F.when(refusal.isNull(), found).alias("resolved"), refusal.alias("refusal"))


def linked_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(caller, endpoint, verb): calls (caller, verb, path) to endpoints (endpoint, verb, path) of the same verb and route; others have no endpoint.

    All pairs of a route are listed. Its calls and its endpoints are dealt over slices of about ``SLICE_ROWS``, and each slice of the one meets each of
    the other, so that a task holds one slice and makes some squares of it, however many pairs a route has.
    """
    key, none = ["verb", "route"], F.lit(0).cast("long")
    known = staged(endpoints.select("endpoint", F.upper("verb").alias("verb"), route(F.col("path")).alias("route")).distinct())
    asked = staged(calls.select("caller", F.upper("verb").alias("verb"), route(F.col("path")).alias("route")))
    sizes = staged(asked.groupBy(*key).agg(F.count("*").alias("calls")).join(known.groupBy(*key).agg(F.count("*").alias("ends")), key))
    parts = 1 + (sizes.agg(F.sum(F.col("calls").cast("double") * F.col("ends"))).first()[0] or 0) // SLICE_ROWS**2
    slices = lambda n: F.expr(f"1 + {n} div {SLICE_ROWS}L")
    large = small(sizes.filter((F.col("calls") > SLICE_ROWS) | (F.col("ends") > SLICE_ROWS)).select(*key, slices("calls").alias("across"), slices("ends").alias("down")))

    def dealt(rows, own, mine, other):
        """In a slice of its own side, and copied to each of the other; routes of which there are few are one slice."""
        each = F.explode(F.sequence(none, F.coalesce(F.col(other), F.lit(1)) - 1)).alias(f"{other}_slice")
        place = F.coalesce(F.pmod(F.xxhash64(own), mine), none).alias(f"{mine}_slice")
        return spread(rows.join(large, key, "left").select(own, *key, place, each), int(parts), *key, "across_slice", "down_slice")

    found = dealt(asked, "caller", "across", "down").join(dealt(known, "endpoint", "down", "across").hint("shuffle_hash"), [*key, "across_slice", "down_slice"], "left")
    return found.select("caller", "endpoint", "verb")


def delivery_chains(*hops: tuple[DataFrame, str, str]) -> DataFrame:
    """The chains over several kinds of edges, each from where the last ended: one join a hop."""
    out = None
    for df, a, b in hops:
        out = df.select(a, b).distinct() if out is None else out.join(df.select(a, b).distinct(), a)
    return out


def detected(files: DataFrame, path: str) -> DataFrame:
    """``files`` with kind: what a file is by the first pattern that its path fits; others are left out."""
    kind = reduce(lambda out, kv: F.when(F.col(path).rlike(kv[1]), kv[0]).otherwise(out), reversed(DETECTORS), F.lit(None).cast("string"))
    return files.withColumn("kind", kind).filter("kind is not null")


def custom_detections(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, produces): facts (id, kind, name) that a rule (rule, kind, name, produces) asks for."""
    return facts.join(small(rules), ["kind", "name"]).select("id", "rule", "produces")


def exported_names(exports: DataFrame, wanted: DataFrame, max_hops: int = 12) -> DataFrame:
    """(file, name, target): the symbol that a file's exported name comes to, over re-exports with aliases.

    ``exports`` has file, name, symbol (null for a re-export), from_file, from_name and position; of several re-exports of a
    name the first that leads to a symbol counts (the order of positions along the way). A cycle leads nowhere.
    """
    own = staged(exports.filter("symbol is not null").groupBy("file", "name").agg(F.min_by("symbol", "position").alias("symbol")))
    links = staged(exports.filter("symbol is null").select(F.col("file").alias("f"), F.col("name").alias("n"), "from_file", "from_name", "position"))
    frontier = staged(wanted.select("file", "name", F.col("file").alias("f"), F.col("name").alias("n"), F.array().cast("array<int>").alias("ord")))
    seen, found = frontier.select("file", "name", "f", "n"), None
    for hop in range(max_hops + 1):
        here = frontier.join(own.select(F.col("file").alias("f"), F.col("name").alias("n"), "symbol"), ["f", "n"]).select("file", "name", "symbol", "ord")
        found = here if found is None else found.unionByName(here)
        if hop == max_hops:
            break
        step = frontier.join(own.select(F.col("file").alias("f"), F.col("name").alias("n")), ["f", "n"], "left_anti").join(links, ["f", "n"])
        step = step.select("file", "name", F.col("from_file").alias("f"), F.col("from_name").alias("n"), F.concat("ord", F.array("position")).alias("ord")).groupBy("file", "name", "f", "n").agg(F.min("ord").alias("ord"))
        frontier = staged(step.join(seen, ["file", "name", "f", "n"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("file", "name", "f", "n"))
    best = found.groupBy("file", "name").agg(F.min_by("symbol", "ord").alias("target"))
    return wanted.select("file", "name").distinct().join(best, ["file", "name"], "left")


def call_sites(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``facts`` (file, line, callee) whose callee's short name (after the last dot) is a symbol's name."""
    short = F.element_at(F.split("callee", r"\."), -1)
    return facts.withColumn("name", short).join(symbols.select("name").distinct(), "name", "left_semi")


def references(edges: DataFrame, nodes: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(kind, id, other, name): for each kind of reference (edge type, and which end asks) the other ends with their names."""
    rows = []
    for type_ in dict.fromkeys(t for t, _ in kinds.values()):  # edges of a type are read once
        asked = [(kind, ("source_id", "target_id") if end == "source" else ("target_id", "source_id")) for kind, (t, end) in kinds.items() if t == type_]
        each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(mine).alias("id"), F.col(other).alias("other")) for kind, (mine, other) in asked)))
        rows.append(edges.filter(F.col("type") == type_).select(each.alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, rows).join(nodes.select(F.col("id").alias("other"), "name"), "other").select("kind", "id", "other", "name")


def disclosed(rows: DataFrame, group: str, order: list[Column], budget: int) -> tuple[DataFrame, DataFrame]:
    """The first ``budget`` rows in order, and how many of each group stay hidden."""
    shown = staged(rows.orderBy(*order).limit(budget))
    hidden = rows.join(F.broadcast(shown.select("id")), "id", "left_anti").groupBy(group).agg(F.count("*").alias("hidden"))
    return shown, hidden
