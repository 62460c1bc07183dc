"""The impact model of many requirements at once: from their statements to impacts with roles, and warnings.

All state is keyed by requirement, so that one walk serves them all, however many they are.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import first_of
from graphloom.operators import impact as I
from graphloom.operators import texts as X
from graphloom.operators.graph import small, spread, staged
from graphloom.operators.matching import match_concepts, speculative
from graphloom.operators.walks import numbered_by
from graphloom.plans import vocabulary as V


#: So many steps of expansions, which are a row each once they are unfolded, make a part.
STEPS_PER_PART = 1_000_000
#: Edge types that are walked; the place of a type is its code, and its bit among those of a route.
KINDS = (*V.OWNERSHIP, *V.PROPAGATING, *V.SUPPORTING)
#: Bits of a route behind those of its types: that it is admissible, and that it isn't weak.
ADMISSIBLE, STRONG = len(KINDS), len(KINDS) + 1
#: A step is the key of its end and, in so many bits, the code of its type and whether it goes up. Up to so many keys are broadcast.
STEP_BITS, MOST_KEYS = 7, 1_000_000


def predicted_change(statement: str) -> list:
    """Columns change, compatibility and cue: what a statement's wording predicts, and the words that say so."""
    text, patterns = F.col(statement), [(n, f"(?i){p}") for n, p in V.CHANGE_KINDS]
    kind = first_of(text, patterns, "unknown")
    cue = F.lit(V.NO_CUE)
    for _, pattern in reversed(patterns):
        cue = F.when(text.rlike(pattern), F.lower(F.regexp_extract(text, pattern, 0))).otherwise(cue)
    return [kind.alias("change"), F.expr(V.case("change", V.COMPATIBILITY)).alias("compatibility"), cue.alias("cue")]


def placed(steps: DataFrame, degree: DataFrame, most: int) -> DataFrame:
    """The first ``most`` steps of each node with their place, from 1; nodes of very many steps are dealt by range."""
    if degree.filter("degree > 1000000").isEmpty():
        rows = steps.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy("hop")).cast("long"))
    else:
        rows = numbered_by(steps, "a", ["hop"], "place")
    return rows.filter(F.col("place") <= most)


def numbered_steps(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The steps of a walk with their place among the steps of their node, from 1, as far as ``most``; and (a, degree)."""
    steps = I.walk_steps(edges)
    degree = staged(steps.groupBy("a").agg(F.count("*").alias("degree")))
    return staged(placed(steps, degree, most).select("a", "b", "type", "up", "place")), degree


def guarded_walk(edges: DataFrame, seeds: DataFrame, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Routes (as ``impact.traverse`` makes them, with requirement), and (requirement, expansions, exhausted).

    ``seeds`` has (requirement, rank, concept, mechanism, ambiguous, test_only, id, max_depth, max_chain, max_expansions).
    A requirement's seeds are walked in the order of rank, each breadth first, and every step that is tried is an
    expansion, whether or not a budget then refuses it. Exactly the first max_expansions (up to ``most``) of a requirement
    happen, as if they were done one after the other: each step of a seed has a number, from the sum of the degrees of what
    is expanded before it; no seed takes more steps than a requirement may; what earlier seeds have used goes off the later
    ones at the end. Seeds themselves always count as reached.
    """
    steps, degree = numbered_steps(edges, most)
    key = ["requirement", "rank"]
    held = (*key, "concept", "mechanism", "ambiguous", "test_only", "anchor", "strength", "max_depth", "max_chain", "max_expansions")
    empty = F.array().cast("array<string>")
    start = staged(seeds.select(
        *key, "concept", "mechanism", "ambiguous", "test_only", F.col("id").alias("anchor"), F.expr(V.case("mechanism", V.MECHANISM_STRENGTH, "0")).alias("strength"), "max_depth", "max_chain",
        F.least("max_expansions", F.lit(most)).alias("max_expansions"), "id", F.lit(0).alias("distance"), F.col("id").alias("path"), empty.alias("edge_types"), F.lit(0).alias("depth"), F.lit(0).alias("chain"),
        F.lit(True).alias("admissible"), F.lit(False).alias("weak"), F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("used"),
    ))
    levels = start.agg(F.max(F.col("max_depth") + F.col("max_chain"))).first()[0] or 0
    routes, frontier, seen, spent = start, start, start.select(*key, "id"), []
    chained, by = F.col("type").isin(*V.CHAIN), W.partitionBy(*key)
    ahead = by.orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    first_owned = F.element_at("edge_types", 1).isin(*V.OWNERSHIP)
    for level in range(1, levels + 1):
        # at most max_expansions rows of a seed are at a frontier; a seed's levels end with the sum of its own budgets
        tried = frontier.filter(F.col("distance") < F.col("max_depth") + F.col("max_chain")).join(degree, F.col("id") == F.col("a")).drop("a")
        spent.append(tried.groupBy(*key).agg((F.max("used") + F.sum("degree")).alias("used")))
        tried = tried.withColumn("begin", F.col("used") + F.coalesce(F.sum("degree").over(ahead), F.lit(0))).withColumn("used", F.col("used") + F.sum("degree").over(by))
        tried = tried.filter(F.col("begin") < F.col("max_expansions"))
        met = (F.col("id") == F.col("a")) & (F.col("begin") + F.col("place") <= F.col("max_expansions"))
        arrived = tried.join(steps, met).select(
            *held, F.col("b").alias("id"), F.lit(level).alias("distance"), F.concat("path", F.lit(">"), "b").alias("path"), F.concat("edge_types", F.array("type")).alias("edge_types"),
            F.when(chained, 0).otherwise(F.col("depth") + 1).alias("depth"), (F.col("chain") + chained.cast("int")).alias("chain"),
            (F.col("admissible") & ((F.size("edge_types") == 0) | ~F.coalesce(first_owned, F.lit(False)) | F.col("up"))).alias("admissible"),
            ((F.col("distance") == 0) & ((F.col("type") == V.NEVER_STRONG) | F.col("up") & F.col("type").isin(*V.WEAK_REVERSED))).alias("weak"),
            (F.col("begin") + F.col("place")).alias("number"), "used",
        )
        arrived = staged(arrived.filter((F.col("depth") <= F.col("max_depth")) & (F.col("chain") <= F.col("max_chain"))))
        routes = routes.unionByName(arrived)
        rest = [c for c in arrived.columns if c not in (*key, "id")]
        first = arrived.filter(F.col("used") <= F.col("max_expansions")).groupBy(*key, "id").agg(F.min_by(F.struct(*rest), "number").alias("first"))
        frontier = staged(first.join(seen, [*key, "id"], "left_anti").select(*key, "id", "first.*"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*key, "id"))
    every = start.select(*key, F.lit(0).cast("long").alias("used"))
    for more in spent:
        every = every.unionByName(more)
    used = every.groupBy(*key).agg(F.max("used").alias("used"))
    earlier = W.partitionBy("requirement").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    used = staged(used.withColumn("earlier", F.coalesce(F.sum("used").over(earlier), F.lit(0))))
    kept = routes.join(used.select(*key, "earlier"), key).filter((F.col("distance") == 0) | (F.col("number") + F.col("earlier") <= F.col("max_expansions")))
    limits = start.groupBy("requirement").agg(F.max("max_expansions").alias("most"))
    total = used.groupBy("requirement").agg(F.sum("used").alias("tried")).join(limits, "requirement")
    return kept.drop("number", "used", "earlier"), total.select("requirement", F.least("tried", "most").alias("expansions"), (F.col("tried") > F.col("most")).alias("exhausted"))


def of_kinds(kinds: tuple[str, ...]) -> Column:
    """Whether kind, the code of a type, is that of one of ``kinds``."""
    return F.expr(f"(shiftright({sum(1 << i for i, k in enumerate(KINDS) if k in kinds)}L, kind) & 1L) = 1L")


def has_bit(bits: str, place: int) -> Column:
    return F.getbit(bits, F.lit(place)) == 1


def key_of(column: str, salt: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(salt)), STEP_BITS)


def known_ids(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, int]:
    """(key, id, degree, node) of all ends of ``edges`` and all ``seeds``, and the salt of the keys, which is such that no two ids share one.
    The degree counts the steps of a node, and is null where there is none."""
    end = lambda df, id_, n: df.select(F.col(id_).alias("id"), n.cast("long").alias("n"))
    ends = end(edges, "target_id", F.lit(1)).unionByName(end(edges, "source_id", (~F.col("type").isin(*V.UPWARD_ONLY)).cast("int"))).unionByName(end(seeds, "id", F.lit(0)))
    known = ends.groupBy("id").agg(F.sum("n").alias("degree")).withColumn("degree", F.when((F.col("degree") > 0) & F.col("id").isNotNull(), F.col("degree")))
    if nodes is None:
        known = known.withColumn("node", F.lit(None).cast("struct<category: string, type: string>"))
    else:
        known = known.join(nodes.dropDuplicates(["id"]).select("id", F.struct("category", "type").alias("node")), "id", "left")
    known, salt = staged(known), 0
    while not known.groupBy(key_of("id", salt).alias("key")).count().filter("count > 1").isEmpty():
        salt += 1
    return known.withColumn("key", key_of("id", salt)), salt


def steps_of(edges: DataFrame, near: DataFrame, degree: DataFrame, salt: int, most: int) -> DataFrame:
    """(a, steps): a row for each of ``near`` (key) that has steps, with the first ``most`` of them in order. A step is one number: the key of
    its end, the code of its type, and whether it goes up."""
    steps = I.walk_steps(edges).filter("a is not null").withColumn("k", key_of("a", salt))
    steps = steps.join(small(near, MOST_KEYS), F.col("k") == F.col("key"), "left_semi")
    code = F.expr(V.case("type", {k: 2 * i for i, k in enumerate(KINDS)})) + F.col("up").cast("int")
    step = F.shiftleft(key_of("b", salt), STEP_BITS).bitwiseOR(code.cast("long"))
    rows = placed(steps.select(F.col("k").alias("a"), "hop", step.alias("step")), degree, most)
    return staged(rows.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"]).alias("steps")))


def unfolded(packed: DataFrame) -> DataFrame:
    """A row a step of ``packed`` expansions with b (the key of its end), kind, up and number, as far as depth and chain go."""
    rows = packed.select("*", F.posexplode("steps").alias("at", "step")).drop("steps")
    rows = rows.withColumn("b", F.shiftrightunsigned("step", STEP_BITS)).withColumn("kind", F.expr(f"cast(shiftright(step, 1) & {2 ** (STEP_BITS - 1) - 1}L as int)")).withColumn("up", F.expr("(step & 1L) = 1L"))
    chained = of_kinds(V.CHAIN)
    rows = rows.withColumn("number", F.col("begin") + F.col("at") + 1).withColumn("depth", F.when(chained, 0).otherwise(F.col("depth") + 1)).withColumn("chain", F.col("chain") + chained.cast("int"))
    return rows.filter((F.col("depth") <= F.col("max_depth")) & (F.col("chain") <= F.col("max_chain"))).drop("step", "at")


def packed(expansions: DataFrame, steps: DataFrame) -> DataFrame:
    """``expansions`` with the list of their steps, as far as the budget goes."""
    few = F.slice("steps", F.lit(1), (F.col("budget") - F.col("begin")).cast("int"))
    return expansions.join(steps, expansions["b"] == steps["a"]).withColumn("steps", few).drop("a", "b")


class Walk(NamedTuple):
    """What a walk of requirements' seeds has come to."""

    known: DataFrame  # (key, id, degree, node)
    seeds: DataFrame
    expansions: DataFrame  # a row an expansion: its node (b), the state in which that was first met, begin and budget
    steps: DataFrame  # (a, steps), see steps_of
    parts: int  # over how many parts the steps of all expansions are dealt
    spent: DataFrame  # (requirement, expansions, exhausted)


def walk(edges: DataFrame, seeds: DataFrame, most: int = 20_000, nodes: DataFrame | None = None) -> Walk:
    """The walk that ``guarded_walk`` does, for walks of few levels that reach very many nodes: see there.

    Nodes are numbers in it, and an expansion is a row with the steps of its node in one list, which is looked up as it is read; only nodes that are
    expanded have their steps gathered. What is met is told by numbers alone, and only what is expanded gets its path. What earlier seeds have used
    goes off the later ones at each level as far as it is known, and for good at the end.
    """
    key, limits = ["seed"], ("max_depth", "max_chain", "max_expansions")
    edges = staged(edges.filter(F.col("type").isin(*KINDS)).select("id", "type", "source_id", "target_id"))  # written once, taken both ways as it is read
    known, salt = known_ids(edges, seeds, nodes)
    degree = known.filter("degree is not null")
    zero, by = F.lit(0).cast("long"), W.partitionBy(*key)
    start = staged(seeds.select(
        "requirement", "rank", "concept", "mechanism", "ambiguous", "test_only", F.col("id").alias("anchor"), F.expr(V.case("mechanism", V.MECHANISM_STRENGTH, "0")).alias("strength"), "max_depth", "max_chain",
        F.least("max_expansions", F.lit(most)).alias("max_expansions"), "id",
    ).join(known, "id").withColumn("seed", F.monotonically_increasing_id()))
    ahead = by.orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("requirement").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    none, spent, seen, live, lists = start.select(*key, zero.alias("used")), [], [], [], []

    def used_by_now():
        used = reduce(DataFrame.unionByName, spent, none).groupBy(*key).agg(F.max("used").alias("used")).join(start.select(*key, "requirement", "rank"), key)
        return staged(used.withColumn("earlier", F.coalesce(F.sum("used").over(before), F.lit(0))))

    def parts_of(expansions):
        return 1 + (expansions.agg(F.sum(F.least("n", F.col("max_expansions").cast("long")))).first()[0] or 0) // STEPS_PER_PART

    used = used_by_now()
    levels = start.agg(F.max(F.col("max_depth") + F.col("max_chain"))).first()[0] or 0
    for level in range(1, max(levels, 1) + 1):
        further = F.lit(level - 1) < F.col("max_depth") + F.col("max_chain")
        if level == 1:
            met = start.filter(further & F.col("degree").isNotNull()).select(*key, F.col("key").alias("b"), zero.alias("first"), zero.alias("parent"), zero.alias("spent"), "max_expansions")
        else:
            last = live[-1].filter((F.col("used") <= F.col("budget")) & further)
            if last.isEmpty():
                break
            few = packed(last, reduce(DataFrame.unionByName, lists)).select(*key, *limits, "begin", "used", "depth", "chain", "steps")
            first = F.shiftleft("number", STEP_BITS).bitwiseOR((2 * F.col("kind") + F.col("up").cast("int")).cast("long"))
            met = unfolded(spread(few, parts_of(last), *key)).select(*key, "b", first.alias("first"), F.col("begin").alias("parent"), F.col("used").alias("spent"), "max_expansions")
            old = reduce(DataFrame.unionByName, seen).join(small(last.select(*key).distinct()), key, "left_semi")
            met = met.unionByName(spread(old, parts_of(last), *key).select(*key, "b", F.lit(-1).cast("long").alias("first"), zero.alias("parent"), zero.alias("spent"), F.lit(0).alias("max_expansions")))
            met = met.groupBy(*key, "b").agg(F.min_by("parent", "first").alias("parent"), F.min("first").alias("first"), F.max("spent").alias("spent"), F.max("max_expansions").alias("max_expansions")).filter("first >= 0")
        tried = met.join(degree.select(F.col("key").alias("b"), F.col("degree").alias("n")), "b").withColumn("number", F.shiftright("first", STEP_BITS))
        tried = tried.withColumn("begin", F.col("spent") + F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("used", F.col("spent") + F.sum("n").over(by))
        # of a seed whose budget is spent one row stays, which says what it has used
        tried = staged(tried.filter((F.col("begin") < F.col("max_expansions")) | (F.col("begin") == F.col("spent"))))
        spent.append(tried.groupBy(*key).agg(F.max("used").alias("used")))
        seen.append(tried.select(*key, "b"))
        used = used_by_now()
        kept = tried.join(used.select(*key, "earlier"), key).withColumn("budget", F.col("max_expansions") - F.col("earlier")).filter(F.col("begin") < F.col("budget"))
        kept = kept.select(*key, "b", "first", "parent", "n", "begin", "used", "budget")
        own = ("path", "edge_types", "kinds", "depth", "chain", "admissible")
        if level == 1:
            held = start.select(*key, *limits, F.col("id").alias("path"), F.array().cast("array<string>").alias("edge_types"), zero.alias("kinds"), F.lit(0).alias("depth"), F.lit(0).alias("chain"), F.lit(True).alias("admissible"))
            state = kept.drop("first", "parent").join(held, key)
        else:
            rows = kept.join(live[-1].select(*key, *limits, *own, F.col("begin").alias("parent")), [*key, "parent"]).join(known.select(F.col("key").alias("b"), "id"), "b")
            rows = rows.withColumn("kind", F.expr(f"cast(shiftright(first, 1) & {2 ** (STEP_BITS - 1) - 1}L as int)")).withColumn("up", F.expr("(first & 1L) = 1L"))
            state = rows.select(
                *key, "b", "n", "begin", "used", "budget", *limits, F.concat("path", F.lit(">"), "id").alias("path"), F.concat("edge_types", F.array(F.get(F.array(*map(F.lit, KINDS)), F.col("kind")))).alias("edge_types"),
                F.col("kinds").bitwiseOR(F.expr("shiftleft(1L, kind)")).alias("kinds"), F.when(of_kinds(V.CHAIN), 0).otherwise(F.col("depth") + 1).alias("depth"), (F.col("chain") + of_kinds(V.CHAIN).cast("int")).alias("chain"),
                flags_of_route(first_owned())["admissible"].alias("admissible"),
            )
        live.append(staged(state.withColumn("level", F.lit(level))))
        near = live[-1].select(F.col("b").alias("key")).distinct()
        if lists:
            near = near.join(reduce(DataFrame.unionByName, lists).select(F.col("a").alias("key")), "key", "left_anti")
        lists.append(steps_of(edges, staged(near), degree, salt, most))
    total = used.groupBy("requirement").agg(F.sum("used").alias("tried")).join(start.groupBy("requirement").agg(F.max("max_expansions").alias("most")), "requirement")
    told = total.select("requirement", F.least("tried", "most").alias("expansions"), (F.col("tried") > F.col("most")).alias("exhausted"))
    every = reduce(DataFrame.unionByName, live).drop("budget", "used").join(small(used.select(*key, "earlier")), key).withColumn("budget", F.col("max_expansions") - F.col("earlier")).filter(F.col("begin") < F.col("budget"))
    return Walk(known, start, every.drop("n", "earlier"), reduce(DataFrame.unionByName, lists), parts_of(every), told)


def first_owned() -> Column:
    return F.coalesce(F.get("edge_types", F.lit(0)).isin(*V.OWNERSHIP), F.lit(False))


def flags_of_route(owned: Column) -> dict[str, Column]:
    """Whether the route of a row of ``unfolded`` expansions is admissible, and whether it is weak; ``owned``: its first step is one of ownership."""
    return {
        "admissible": F.col("admissible") & (~owned | F.col("up")),
        "weak": (F.col("level") == 1) & (of_kinds((V.NEVER_STRONG,)) | F.col("up") & of_kinds(V.WEAK_REVERSED)),
    }


def routes_of(w: Walk, nodes: bool) -> DataFrame:
    """All routes of a walk as ``guarded_walk`` makes them; with ``nodes``, they have node (category, type), null where there is none."""
    node = ["node"] if nodes else []
    seed = ("requirement", "rank", "concept", "mechanism", "ambiguous", "test_only", "anchor", "strength")
    flags = flags_of_route(first_owned())
    rows = unfolded(spread(packed(w.expansions, w.steps), w.parts, "seed")).join(w.known.select(F.col("key").alias("b"), "id", "node"), "b").join(w.seeds.select("seed", *seed), "seed")
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    limits = ("max_depth", "max_chain", "max_expansions")
    rows = rows.select(*seed, *limits, "id", F.col("level").alias("distance"), F.concat("path", F.lit(">"), "id").alias("path"), F.concat("edge_types", F.array(kind)).alias("edge_types"), "depth", "chain", *(c.alias(n) for n, c in flags.items()), *node)
    own = w.seeds.select(
        *seed, *limits, "id", F.lit(0).alias("distance"), F.col("id").alias("path"), F.array().cast("array<string>").alias("edge_types"), F.lit(0).alias("depth"), F.lit(0).alias("chain"),
        F.lit(True).alias("admissible"), F.lit(False).alias("weak"), *node,
    )
    return own.unionByName(rows)


def packed_walk(edges: DataFrame, seeds: DataFrame, most: int = 20_000, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Routes and expansions as ``guarded_walk`` makes them, out of ``walk``."""
    w = walk(edges, seeds, most, nodes)
    return routes_of(w, nodes is not None), w.spent


def strongest(w: Walk, most: int) -> DataFrame:
    """Of the nodes that a walk reaches in admissible routes: the anchors of each requirement, and the others from the highest confidence down to
    that of the place behind the ``most``-th, but for those that as many others are before that differ from them by id alone. As ``impact.confident`` makes them of merged routes, with over (how many nodes there are beyond
    ``most``), anchors and farthest (the highest confidence of a node that is no anchor).

    A route is two numbers: pick, by which one of a node's nearest routes is chosen (the turn of its beginning in the order of strength and path,
    then the signal of its mechanism and its last type), and the bits of its types. Paths and names are looked up for those that remain.
    """
    numbers = w.seeds.withColumn("no", F.min("seed").over(W.partitionBy("requirement")))  # requirements are numbers too
    matched, empty, zero = ("concept", "mechanism", "ambiguous", "test_only"), F.array().cast("array<string>"), F.lit(0).cast("long")
    own = numbers.select(
        "no", "requirement", "rank", "strength", *matched, F.col("key").alias("b"), F.lit("").alias("path"), empty.alias("edge_types"), zero.alias("kinds"), F.lit(-1).alias("depth"), F.lit(0).alias("chain"),
        F.lit(True).alias("admissible"), zero.alias("begin"), F.lit(1).cast("long").alias("budget"), "max_depth", "max_chain", F.lit(0).alias("level"),
    )
    begun = w.expansions.join(numbers.select("seed", "no", "requirement", "rank", "strength", *matched), "seed").select(own.columns)
    turn = F.row_number().over(W.partitionBy("no").orderBy(F.desc("strength"), F.concat("path", F.lit(">")), "rank"))
    signal = F.expr(V.case("mechanism", V.MECHANISM_SIGNAL, "50")) + F.when(F.col("ambiguous"), V.AMBIGUITY).otherwise(0) + F.when(F.col("test_only"), V.TEST_ONLY).otherwise(0)
    turned = staged(begun.unionByName(own).withColumn("turn", turn).withColumn("pick", (F.col("turn").cast("long") * 1024 + signal + 512) * len(KINDS)))
    away = F.col("distance") > 0
    if turned.filter((F.col("level") > 0) & (F.size(F.split("path", ">")) != F.col("level"))).isEmpty():
        few = turned.select("no", "b", "begin", "budget", "depth", "chain", "max_depth", "max_chain", "level", "admissible", first_owned().alias("owned"), "kinds", "pick")
        lists = packed(few.filter("level > 0"), w.steps).unionByName(few.filter("level = 0").withColumn("steps", F.array(F.shiftleft("b", STEP_BITS))).drop("b"))
        flag = {n: c.cast("long") for n, c in flags_of_route(F.col("owned")).items()}
        bits = F.when(F.col("level") == 0, F.lit(2**ADMISSIBLE + 2**STRONG)).otherwise(F.col("kinds").bitwiseOR(F.expr("shiftleft(1L, kind)")).bitwiseOR(F.shiftleft(flag["admissible"], ADMISSIBLE)).bitwiseOR(F.shiftleft(1 - flag["weak"], STRONG)))
        routes = unfolded(spread(lists, w.parts, "no")).select("no", "b", F.col("level").alias("distance"), (F.col("pick") + F.col("kind")).alias("pick"), bits.alias("bits"))
        each = routes.groupBy("no", "b", "distance").agg(F.min("pick").alias("pick"), F.bit_or("bits").alias("bits"))
        near = each.groupBy("no", "b").agg(F.min("distance").alias("distance"), F.min_by("pick", "distance").alias("pick"), F.min_by("bits", "distance").alias("bits")).filter(has_bit("bits", ADMISSIBLE))
        gone = w.known.filter("node is null").select(F.col("key").alias("b"))
        if not gone.isEmpty():
            near = near.join(small(gone), "b", "left_anti")
        total = F.expr(f"cast(pick div {len(KINDS)} % 1024 - 512 as int)") + F.col("distance") * V.HOP
        for more in sorted(set(V.EDGE_SIGNAL.values())):
            total += F.bit_count(F.col("bits").bitwiseAND(F.lit(sum(1 << KINDS.index(k) for k, v in V.EDGE_SIGNAL.items() if v == more)))) * more
        near = near.withColumn("confidence", F.greatest(F.lit(V.LEAST), F.least(F.lit(V.MOST), total)).cast("long"))
    else:  # an id with > in it: paths aren't in the order of their beginnings
        near = I.confident(I.merged(routes_of(w, True), ["requirement"])).withColumn("no", F.col("requirement"))
    # places are told from counts by confidence, so that nothing is sorted
    counts = near.groupBy("no", away.alias("away"), "confidence").agg(F.count("*").alias("n"))
    higher = F.sum("n").over(W.partitionBy("no").orderBy("away", F.desc("confidence")).rowsBetween(W.unboundedPreceding, -1))
    said = counts.withColumn("place", F.coalesce(higher, F.lit(0)) + 1).groupBy("no").agg(
        (F.sum("n") - most).alias("over"), F.sum(F.when(~F.col("away"), F.col("n")).otherwise(0)).alias("anchors"), F.max(F.when(F.col("away"), F.col("confidence"))).alias("farthest"),
        F.min(F.when(F.col("away") & (F.col("place") <= most + 1), F.col("confidence"))).alias("floor"),
    )
    said = F.broadcast(said) if w.seeds.limit(MOST_KEYS + 1).count() <= MOST_KEYS else said
    near = near.join(said, "no").filter(~away | (F.col("confidence") >= F.col("floor"))).drop("floor")
    if "pick" not in near.columns:
        return near.drop("no")
    near = near.withColumn("kind", F.expr(f"cast(pick % {len(KINDS)} as int)")).withColumn("turn", F.expr(f"cast(pick div {len(KINDS) * 1024} as int)")).drop("pick")
    rows = near.join(w.known.select(F.col("key").alias("b"), "id", "node.category", "node.type"), "b")
    rows = rows.join(turned.select("no", "turn", "requirement", F.col("path").alias("begun"), F.col("edge_types").alias("taken"), *matched), ["no", "turn"])
    # nodes that are alike in all that classes them are taken in the order of their ids, so that few are classified
    alike = W.partitionBy("no", "distance", "confidence", "bits", "kind", "taken", "mechanism", "ambiguous", "test_only", F.contains("concept", F.lit("/")), "category", "type").orderBy("id")
    rows = rows.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= most + 1)
    kinds = F.array(*map(F.lit, KINDS))
    rows = rows.select(
        "requirement", "id", "distance", F.when(away, F.concat("begun", F.lit(">"), "id")).otherwise(F.col("id")).alias("path"), F.when(away, F.concat("taken", F.array(F.get(kinds, F.col("kind"))))).otherwise(F.col("taken")).alias("edge_types"),
        *matched, F.sort_array(F.filter(kinds, lambda k, i: F.getbit("bits", i) == 1)).alias("corroborating"),
        F.lit(True).alias("admissible"), (~has_bit("bits", STRONG)).alias("weak"), "category", "type", "confidence", "over", "anchors", "farthest",
    )
    return rows.withColumn("confidence", F.when(away, F.col("confidence")).otherwise(I.confidence()))


def change_shapes(requirements: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(requirement, shape, max_depth, max_chain, max_expansions) for each of ``requirements``; ``anchors`` has
    (requirement, id, type, path). A change is distributed where it has no anchor, where one is of a far-reaching type or at a chain
    edge, or where they lie in several top-level containers."""
    ends = edges.filter(F.col("type").isin(*V.CHAIN))
    ids = anchors.select("id").distinct()
    chained = ends.select(F.col("source_id").alias("id")).unionByName(ends.select(F.col("target_id").alias("id"))).join(ids, "id", "left_semi").distinct().withColumn("chained", F.lit(True))
    root = F.coalesce(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("(unattributed)"))
    reach = anchors.join(chained, "id", "left").groupBy("requirement").agg((F.bool_or(F.col("type").isin(*V.FAR_REACHING) | F.coalesce("chained", F.lit(False))) | (F.count_distinct(root) > 1)).alias("far"))
    shape = F.when(F.coalesce("far", F.lit(True)), "distributed").otherwise("contained")
    rows = requirements.select("requirement").join(reach, "requirement", "left").select("requirement", shape.alias("shape"))
    return rows.select("*", *(F.expr(V.case("shape", {k: v[i] for k, v in V.BUDGETS.items()})).alias(name) for i, name in enumerate(("max_depth", "max_chain", "max_expansions"))))


def impact_model(requirements: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Impacts and warnings of ``requirements`` (requirement, statement).

    Impacts: (requirement, id, distance, path, concept, mechanism, shape, change, confidence, likelihood, basis, impact_type, role), the
    hundred strongest of each requirement, anchors before all others. Warnings: (requirement, code, subject, amount): concepts that are
    unknown or ambiguous, a walk that was cut (traversal-exhausted), impacts left out (traversal-cutoff, with how many and the
    confidence of the strongest), a requirement without any impact (unmatched-requirement).
    """
    asked = staged(requirements.select("requirement", "statement", F.posexplode_outer(X.concepts(F.col("statement"))).alias("at", "concept")))
    matches = staged(match_concepts(asked.filter("concept is not null").select("concept"), nodes, aliases))
    found = asked.join(matches, "concept")
    place = F.row_number().over(W.partitionBy("requirement").orderBy("at", "id"))
    seeds = staged(found.filter("id is not null").select("requirement", "at", "concept", F.col("outcome").alias("mechanism"), "id").withColumn("rank", place))
    anchors = seeds.join(nodes.select("id", "type", "path"), "id").select("requirement", "id", "type", "path")
    shapes = staged(change_shapes(requirements, anchors, edges))
    no = F.lit(False)
    walked = walk(edges, seeds.join(shapes, "requirement").select("*", no.alias("ambiguous"), no.alias("test_only")), nodes=nodes)
    told = requirements.select("requirement", *predicted_change("statement")).select("requirement", "change").join(shapes.select("requirement", "shape"), "requirement")
    # what can't be among the strongest goes by its confidence, before it is classified, but for what is said of it
    all_of, away = W.partitionBy("requirement"), F.col("distance") > 0
    rows = strongest(walked, V.MOST_IMPACTS).join(told, "requirement")
    scored = I.classified(rows, nodes, F.col("change"))
    named = (F.col("distance") == 0) & F.col("mechanism").isin("exact", "alias", "path-suffix")
    strength = all_of.orderBy(away, F.desc("confidence"), F.expr(V.case("likelihood", V.LIKELIHOOD_RANK)), "id")
    ranked = scored.withColumn("strength", F.row_number().over(strength))
    next_ = F.max(F.when((F.col("strength") > V.MOST_IMPACTS) & away, F.col("confidence"))).over(all_of)
    ranked = I.with_role(ranked.withColumn("highest", F.when(F.col("anchors") > V.MOST_IMPACTS, F.col("farthest")).otherwise(next_)).filter(F.col("strength") <= V.MOST_IMPACTS), named)
    ranked = staged(ranked.select("requirement", "id", "distance", "path", "concept", "mechanism", "shape", "change", "confidence", "likelihood", "basis", "impact_type", "role", "strength", "over", "highest"))
    kept = ranked.select("requirement", "id", "distance", "path", "concept", "mechanism", "shape", "change", "confidence", "likelihood", "basis", "impact_type", "role")
    warned = lambda df, code, subject, amount: df.select("requirement", F.lit(code).alias("code"), subject.cast("string").alias("subject"), amount.cast("long").alias("amount"))
    none = F.lit(None)
    cut = ranked.filter((F.col("strength") == 1) & (F.col("over") > 0))
    warnings = [
        warned(found.filter((F.col("outcome") == "unknown") & ~speculative("concept")), "unknown-concept", F.col("concept"), none),
        warned(found.filter(F.col("outcome") == "ambiguous"), "ambiguous-concept", F.col("concept"), none),
        warned(walked.spent.filter("exhausted"), "traversal-exhausted", none, F.col("expansions")),
        warned(cut, "traversal-cutoff", F.coalesce("highest", F.lit(0)), F.col("over")),
        warned(requirements.join(kept.select("requirement"), "requirement", "left_anti"), "unmatched-requirement", none, none),
    ]
    every = warnings[0]
    for more in warnings[1:]:
        every = every.unionByName(more)
    return kept, every
