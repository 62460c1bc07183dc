"""Questions that competing readings of a requirement raise, where they lead to different changes, and what each reading implies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import impact as I
from graphloom.operators.graph import staged
from graphloom.operators.matching import match_concepts
from graphloom.operators.requirements import guarded_walk
from graphloom.plans import vocabulary as V

# How grave a difference is, and what a footprint weighs.
SEVERITIES = {"blocking": 0, "important": 1, "minor": 2}
API_TYPES, EVENT_TYPES = ("api-endpoint", "controller", "handler", "route"), ("topic", "subscription", "domain-event", "queue")
MOST_NAMES, HEAVY, MIDDLE = 4, 15, 6
RISKS = {
    "migrations": "touches migrations — existing records need a backfill decision",
    "data": "changes data the repository already stores — verify whether a migration is needed",
    "events": "crosses an event boundary — consumers change independently of this deployment",
    "apis": "changes an exposed API surface — existing callers may break",
    "infra": "requires infrastructure changes — deployment is not code-only",
    "untested": "no test node in the footprint — the change would land unverified",
}


def footprints(drafts: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(requirement, place, id): what each reading (requirement, place, concepts) reaches from the nodes that its concepts match, all
    readings in one walk with the budgets of a change that goes far."""
    named = staged(drafts.select("requirement", "place", F.posexplode("concepts").alias("at", "concept")))
    found = match_concepts(named.select("concept"), nodes, aliases).filter("id is not null")
    key = F.to_json(F.struct("requirement", "place"))
    seeds = named.join(found, "concept").select(
        key.alias("requirement"), F.row_number().over(W.partitionBy("requirement", "place").orderBy("at", "id")).alias("rank"), "concept", F.col("outcome").alias("mechanism"), F.lit(False).alias("ambiguous"),
        F.lit(False).alias("test_only"), "id", *(F.lit(n).alias(c) for c, n in zip(("max_depth", "max_chain", "max_expansions"), V.BUDGETS["distributed"], strict=True)),
    )
    routes, _ = guarded_walk(edges, staged(seeds))
    reached = I.merged(routes, ["requirement"]).filter("admissible")
    kind = drafts.schema["requirement"].dataType.simpleString()
    return reached.select(F.from_json("requirement", f"requirement {kind}, place int").alias("k"), "id").select("k.requirement", "k.place", "id")


def compared(drafts: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(requirement, place, divergent, severity, names) for each reading after the first: how many nodes only one of the two has, how
    grave that is, and the names of the first four by id. Readings that lead to the same changes don't occur."""
    others = drafts.filter("place > 0").select("requirement", "place")
    first = prints.filter("place = 0").select("requirement", "id").join(others, "requirement").select("requirement", "place", "id")
    both = first.unionByName(prints.filter("place > 0"))
    apart = both.groupBy("requirement", "place", "id").agg(F.count("*").alias("n")).filter("n = 1")
    told = apart.join(nodes.select("id", "category", "name"), "id")
    grave = F.bool_or(F.col("category").isin("data", "integration"))
    severity = F.when(grave, "blocking").when(F.bool_or(F.col("category") == "infrastructure") | (F.count("*") >= 2), "important").otherwise("minor")
    place = F.row_number().over(W.partitionBy("requirement", "place").orderBy("id"))
    named = F.array_sort(F.collect_list(F.when(F.col("turn") <= MOST_NAMES, F.struct("turn", "name"))))
    return told.withColumn("turn", place).groupBy("requirement", "place").agg(F.count("*").alias("divergent"), severity.alias("severity"), F.transform(named, lambda x: x["name"]).alias("names"))


def questions(drafts: DataFrame, differences: DataFrame, known: DataFrame) -> DataFrame:
    """(id, requirement, place, question, divergent, severity), the grave ones first to be asked; ``drafts`` has (requirement, place,
    title, assumption), ``known`` (question) what was asked already. A question that several requirements raise is asked once; questions are told apart by
    their texts (but for case and white space)."""
    side = lambda p, where: drafts.filter(where).select("requirement", *([] if p == "a" else ["place"]), F.col("title").alias(f"{p}_title"), F.col("assumption").alias(f"{p}_said"))
    rows = differences.join(side("a", "place = 0"), "requirement").join(side("b", "place > 0"), ["requirement", "place"])
    text = F.concat(F.lit("'"), "a_title", F.lit("' or '"), "b_title", F.lit("'? The readings lead to different changes in "), F.array_join("names", ", "), F.lit(" — "), "a_said", F.lit(" Or: "), "b_said")
    same = S.flattened(F.col("question"))  # ids are of 32 bits, and different questions may share one
    asked = rows.withColumn("question", text).withColumn("same", same)
    fresh = asked.join(known.select(same.alias("same")).distinct(), "same", "left_anti")
    columns = ("requirement", "place", "question", "divergent", "severity")
    one = fresh.groupBy("same").agg(F.min_by(F.struct(*columns), F.struct("requirement", "place")).alias("q"))
    return one.select(S.content_id("question", F.col("same")).alias("id"), "q.*")


def implications(drafts: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(requirement, place, components, complexity, risks) of each reading, from what its footprint holds."""
    types, category = F.col("type"), F.col("category")
    migration = types == "migration"
    is_ = {"migrations": migration, "data": ~migration & (category == "data"), "apis": types.isin(*API_TYPES), "events": types.isin(*EVENT_TYPES) | (category == "integration"), "infra": category == "infrastructure", "tests": types == "test"}
    held = prints.join(nodes.select("id", "type", "category"), "id").groupBy("requirement", "place").agg(F.count("*").alias("components"), *(F.count_if(c).alias(n) for n, c in is_.items()))
    rows = drafts.select("requirement", "place").join(held, ["requirement", "place"], "left").fillna(0)
    weight = F.col("components") + 2 * F.col("data") + 3 * F.col("migrations") + 2 * F.col("events") + 2 * F.col("infra")
    risky = {"migrations": F.col("migrations") > 0, "data": (F.col("migrations") == 0) & (F.col("data") > 0), "events": F.col("events") > 0, "apis": F.col("apis") > 0, "infra": F.col("infra") > 0, "untested": (F.col("tests") == 0) & (F.col("components") > 0)}
    risks = F.filter(F.array(*(F.when(c, RISKS[n]) for n, c in risky.items())), lambda x: x.isNotNull())
    return rows.select("requirement", "place", "components", F.when(weight >= HEAVY, "high").when(weight >= MIDDLE, "medium").otherwise("low").alias("complexity"), risks.alias("risks"))


def clarified(drafts: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and options of readings (requirement, place, title, assumption, concepts).

    Readings are numbered from 0 in each requirement, the first being the most plausible, with which each other one is compared. Options
    are (requirement, place, title, question, components, complexity, risks): the readings of what is asked, the first one linked to its first question.
    A requirement of a single reading asks nothing.
    """
    prints = staged(footprints(drafts, nodes, edges, aliases))
    differences = staged(compared(drafts, prints, nodes))
    asked = questions(drafts, differences, known)
    every = questions(drafts, differences, known.limit(0))
    linked = every.select("requirement", "place", F.col("id").alias("question"))
    first = every.groupBy("requirement").agg(F.min_by("id", "place").alias("question")).select("requirement", F.lit(0).alias("place"), "question")
    options = drafts.select("requirement", "place", "title").join(reduce(DataFrame.unionByName, [linked, first]), ["requirement", "place"]).join(implications(drafts, prints, nodes), ["requirement", "place"])
    return asked, options.select("requirement", "place", "title", "question", "components", "complexity", "risks")
