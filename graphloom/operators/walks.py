"""Walks beside impact: paths with parents, members up a heritage, field flow, runtime chains, layers, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import small, staged, steps

HERITAGE, MEMBERSHIP = ("EXTENDS", "IMPLEMENTS"), ("DECLARES_MEMBER", "CONTAINS")
FLOW = ("FLOWS_TO", "RENAMED_TO", "SERIALIZED_AS")
RUNTIME = ("RESOLVES_TO", "ROUTES_TO", "RUNS_IN", "DEPLOYED_AS", "CONTAINS")
BOUNDARIES = (
    "api-endpoint", "topic", "queue", "subscription", "pubsub-topic", "pubsub-subscription", "openapi-operation", "openapi-document", "external-api", "third-party-service",
    "unresolved-external-boundary", "outbox-record", "push-endpoint",
)
OPEN = "unresolved-external-boundary"
HOP_KINDS = {
    "service-url": "configured-url", "environment-variable": "configured-url", "terraform-local": "resolution", "terraform-output": "resolution", "terraform-variable": "resolution",
    "terraform-resource": "runtime-resource", "cloud-run-service": "runtime-resource", "cloud-run-job": "runtime-resource", "container": "process", "runtime-process": "process",
    "service": "handler", "application": "handler", "handler": "handler", "controller": "handler", "api-endpoint": "handler",
}


def numbered_by(df: DataFrame, key: str, order: list[str], name: str, most: int = 1_000_000) -> DataFrame:
    """``df`` with a gapless number from 1 in each group, in order. Groups of more than ``most`` rows are dealt by range over group and
    order, so that a group of any size spreads over tasks; the starts of its parts come from sums of counts."""
    large = staged(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key))
    if large.isEmpty():
        return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))
    few = df.join(F.broadcast(large), key, "left_anti").withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long"))
    dealt = staged(df.join(F.broadcast(large), key, "left_semi").repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_at", F.row_number().over(W.partitionBy(key, "_part").orderBy(*order)))
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = local.join(starts, [key, "_part"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    return few.unionByName(numbered)


def adjacency_positions(edges: DataFrame) -> DataFrame:
    """(source_id, position, edge_id): the outgoing edges of each node in the order of their ids, a row each."""
    return numbered_by(edges.select("source_id", F.col("id").alias("edge_id")), "source_id", ["edge_id"], "position")


def neighbours_of(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, direction: str = "both", types: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """(id, neighbour): the distinct nodes one step from each anchor, by direction (out, in, both), edge types and node categories."""
    kept = edges.filter(F.col("type").isin(*types)) if types else edges
    each = steps(kept)
    each = each if direction == "both" else each.filter(F.col("dir") == direction)
    ends = nodes.filter(F.col("category").isin(*categories)) if categories else nodes
    near = each.join(anchors.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("neighbour")).distinct()
    return near.join(ends.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")


def shortest_paths(edges: DataFrame, anchors: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth, path): one shortest path from an anchor to each node within ``max_depth`` steps in any direction; of equal
    ones that of the first discovery, in the order of the frontier, then outgoing before incoming, then edge ids."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.concat(F.lit("0"), "id").alias("hop"))
    walk = staged(out.unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.concat(F.lit("1"), "id").alias("hop"))))
    known = staged(anchors.select("id").distinct().select("id", F.lit(0).alias("depth"), F.col("id").alias("path"), F.array("id").alias("ord")))
    frontier = known
    for depth in range(1, max_depth + 1):
        reached = walk.join(frontier.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.lit(">"), "b").alias("path"), F.concat("ord", F.array("hop")).alias("ord"))
        fresh = reached.join(known.select("id"), "id", "left_anti").groupBy("id", "depth").agg(F.min_by(F.struct("path", "ord"), "ord").alias("w"))
        frontier = staged(fresh.select("id", "depth", "w.path", "w.ord"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.drop("ord")


def resolve_members(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, max_depth: int = 16) -> DataFrame:
    """(id, member, outcome, provider, inherited, open, supertypes) for each row of ``wanted`` (id, member).

    A container's own members come first, then those of its supertypes, breadth first in the order of edge ids; the first
    provider that declares the name wins. Behind an open boundary nothing is seen, so that a member not found may still be
    there. ``nodes`` has (id, type, name), ``edges`` the membership and heritage edges.
    """
    wanted = staged(wanted.select("id", "member").distinct())
    asked = small(wanted.select("member").distinct())
    tail = F.transform(F.sequence(F.lit(1), F.size("segments")), lambda i: F.array_join(F.slice("segments", i, F.size("segments")), "."))
    names = nodes.select(F.col("id").alias("target_id"), F.regexp_replace("name", r"\?$", "").alias("bare")).filter("bare is not null")
    # only names that are, or end in, a wanted one (after a dot) can be declarations of it
    names = names.withColumn("segments", F.split("bare", r"\.", -1)).withColumn("member", F.explode(F.array_distinct(tail))).join(asked, "member").select("target_id", "bare", "member")
    held = edges.filter(F.col("type").isin(*MEMBERSHIP)).select("source_id", "target_id").join(names, "target_id")
    owners = nodes.select(F.col("id").alias("source_id"), F.concat(F.col("name"), F.lit(".")).alias("prefix"))
    bare = F.when(F.startswith("bare", F.col("prefix")), F.expr("substring(bare, length(prefix) + 1)")).otherwise(F.col("bare"))
    held = held.join(owners, "source_id").filter(bare == F.col("member"))
    declared = staged(held.select(F.col("source_id").alias("provider"), "member").distinct())
    types = nodes.select(F.col("id").alias("provider"), (F.col("type") == OPEN).alias("closed_off"))
    # what stands above is looked up once, not once a level
    heritage = edges.filter(F.col("type").isin(*HERITAGE)).select(F.col("source_id").alias("below"), F.col("target_id").alias("provider"), F.col("id").alias("hop"))
    above = staged(heritage.join(types, "provider").select(F.col("below").alias("provider"), F.col("provider").alias("next"), "hop", F.col("closed_off").alias("next_closed")))
    frontier = staged(wanted.select("id", "member", F.col("id").alias("provider"), F.array().cast("array<string>").alias("ord")).join(types, "provider"))
    seen, found = frontier, None
    for depth in range(max_depth + 1):
        hits = frontier.filter("not closed_off").join(declared, ["provider", "member"]).groupBy("id", "member").agg(F.min_by("provider", "ord").alias("provider")).withColumn("depth", F.lit(depth))
        hits = staged(hits)
        found = hits if found is None else found.unionByName(hits)
        if depth == max_depth:
            break
        rest = frontier.filter("not closed_off").join(hits.select("id", "member"), ["id", "member"], "left_anti")
        reached = rest.join(above, "provider").groupBy("id", "member", F.col("next").alias("provider"), F.col("next_closed").alias("closed_off")).agg(F.min(F.concat("ord", F.array("hop"))).alias("ord"))
        frontier = staged(reached.join(seen.select("id", "member", "provider"), ["id", "member", "provider"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(seen.columns))
    missed = seen.groupBy("id", "member").agg(F.bool_or("closed_off").alias("open"), F.count_if(~F.col("closed_off") & (F.col("provider") != F.col("id"))).alias("supertypes"))
    rows = missed.join(found, ["id", "member"], "left")
    got = F.col("provider").isNotNull()
    return rows.select("id", "member", F.when(got, "found").otherwise("not-found").alias("outcome"), "provider", F.when(got, F.col("provider") != F.col("id")).alias("inherited"), F.when(~got, F.col("open")).alias("open"), F.when(~got, F.col("supertypes")).alias("supertypes"))


def field_flow(edges: DataFrame, starts: DataFrame, max_hops: int = 12) -> DataFrame:
    """(start, direction, id, via): what each field flows to (forward) and from (backward) over flow edges; a node once for every kind of edge that reaches it."""
    flow = edges.filter(F.col("type").isin(*FLOW))
    ways = flow.select(F.lit("forward").alias("direction"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("type").alias("via"))
    ways = staged(ways.unionByName(flow.select(F.lit("backward"), F.col("target_id"), F.col("source_id"), F.col("type")).toDF("direction", "a", "b", "via")))
    frontier = staged(starts.select(F.col("id").alias("start"), F.explode(F.array(F.lit("forward"), F.lit("backward"))).alias("direction"), "id"))
    seen, hops = frontier, None
    for _ in range(max_hops):
        step = staged(frontier.withColumnRenamed("id", "a").join(ways, ["direction", "a"]).select("start", "direction", F.col("b").alias("id"), "via").distinct())
        hops = step if hops is None else hops.unionByName(step)
        frontier = staged(step.select("start", "direction", "id").distinct().join(seen, ["start", "direction", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return hops.distinct()


def runtime_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int = 12) -> DataFrame:
    """(start, hops, n_hops, reason): the chain from each start over its only successor; a chain of one hop is none.

    It ends at a node that is no hop, at one without successor (complete if some hop is a handler), at one with several, at a
    cycle or at the budget; reason is null only if it is complete. The number of successors and the only one come from one aggregate,
    so that a step is one join for all chains together.
    """
    kinds = F.create_map(*(F.lit(x) for kv in HOP_KINDS.items() for x in kv))
    nexts = edges.filter(F.col("type").isin(*RUNTIME)).groupBy(F.col("source_id").alias("at")).agg(F.count("*").alias("ways"), F.min("target_id").alias("next"))
    info = staged(nodes.select(F.col("id").alias("at"), kinds[F.col("type")].alias("kind")).join(nexts, "at", "left"))
    live = staged(starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("hops"), F.lit(False).alias("handled")))
    done = None
    for hop in range(max_hops + 1):
        # many chains meet in few nodes, which alone are joined then, and are broadcast where they are few
        met = small(staged(info.join(staged(live.select("at").distinct()), "at", "left_semi"))) if hop else info
        here = live.join(met, "at", "left")
        full = F.size("hops") >= max_hops
        reason = (
            F.when(full, "budget").when(F.array_contains("hops", F.col("at")), "cycle").when(F.col("kind").isNull(), "not-a-hop")
            .when(F.col("ways").isNull() & ~(F.col("handled") | (F.col("kind") == "handler")), "no-handler").when(F.col("ways") > 1, "fan-out")
        )
        ended = reason.isNotNull() | F.col("ways").isNull()
        added = F.when(full | F.array_contains("hops", F.col("at")) | F.col("kind").isNull(), F.col("hops")).otherwise(F.concat("hops", F.array("at")))
        step = staged(here.select("start", "next", added.alias("hops"), (F.col("handled") | F.coalesce(F.col("kind") == "handler", F.lit(False))).alias("handled"), reason.alias("reason"), ended.alias("ended")))
        over = step.filter("ended").select("start", "hops", "reason")
        done = over if done is None else done.unionByName(over)
        live = step.filter("not ended").select("start", F.col("next").alias("at"), "hops", "handled")
        if live.isEmpty():
            break
    return done.filter(F.size("hops") >= 2).select("start", F.array_join("hops", ">").alias("hops"), F.size("hops").cast("long").alias("n_hops"), "reason")


def layers(groups: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(id, layer): the length of the longest chain of group edges (source, target) that ends in a group, below ``most``."""
    level = staged(groups.select("id", F.lit(0).alias("layer")))
    pairs = staged(edges.select("source", "target").distinct())
    for _ in range(most):
        up = pairs.join(level.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max(F.least(F.col("layer") + 1, F.lit(most - 1))).alias("next"))
        moved = staged(level.join(up, "id", "left").select("id", F.greatest("layer", F.coalesce("next", "layer")).alias("layer"), "layer").toDF("id", "layer", "old"))
        level = moved.drop("old")
        if moved.filter("layer <> old").isEmpty():
            break
    return level


def round_robin(members: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """``budget`` rows: groups by size (larger first, then by name), one member of each in turn. Adds turn (from 1)."""
    sizes = members.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = sizes.orderBy(F.desc("_size"), group).limit(budget).withColumn("_rank", F.row_number().over(W.orderBy(F.desc("_size"), group)))
    taken = members.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("turn") <= budget)
    return taken.join(F.broadcast(ranked), group).orderBy("turn", "_rank").limit(budget).drop("_size", "_rank")
