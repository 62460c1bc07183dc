"""Concepts that match nothing: what their absence may mean, and the warnings that matches give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.matching import speculative
from graphloom.plans import wording as T


def shape_of(concept: str) -> Column:
    """How a concept is written: route, path, identifier or term."""
    text = F.trim(concept)
    ended = text.rlike(r"\.[A-Za-z0-9]{1,5}$")
    named = text.rlike(r"^[A-Za-z_$][\w$]*$") & text.rlike("[A-Z_]")
    return F.when(text.rlike(r"\s"), "term").when(F.startswith(text, F.lit("/")) & ~ended, "route").when(F.contains(text, F.lit("/")), "path").when(ended | named, "identifier").otherwise("term")


def unresolved_surfaces(requirements: DataFrame, unknown: DataFrame, near: DataFrame, nodes: DataFrame, missing: int = 0) -> DataFrame:
    """(concept, shape, kind, others, requirements, nearest, confidence) for each concept of ``unknown`` (requirement, concept).

    ``requirements`` has (requirement, statement), ``near`` (concept, name) what came close, ``missing`` is how many repositories are
    not indexed. Of several requirements that name a concept any one's wording counts. kind is the first reading that anything
    supports, others those that stay open. Speculative concepts are left out.
    """
    types = nodes.select("type").distinct()
    kinds = {t for _, names in T.SURFACES for t in names}
    indexed = types.filter(F.col("type").isin(*kinds)).agg(F.collect_set("type").alias("indexed"))  # of a fixed list
    rows = unknown.filter(~speculative("concept")).distinct().join(requirements, "requirement").crossJoin(F.broadcast(indexed))
    sibling = reduce(lambda a, b: a | b, [F.col("statement").rlike(p) & F.arrays_overlap("indexed", F.array(*(F.lit(n) for n in names))) for p, names in T.SURFACES])
    signs = rows.groupBy("concept").agg(
        F.bool_or(F.col("statement").rlike(T.CREATION)).alias("creates"), F.bool_or(F.col("statement").rlike(T.OUTSIDE)).alias("outside"), F.bool_or(F.coalesce(sibling, F.lit(False))).alias("sibling"),
        F.array_sort(F.collect_set("requirement")).alias("requirements"),
    )
    close = near.groupBy("concept").agg(F.array_sort(F.collect_set("name")).alias("nearest"))
    told = signs.join(close, "concept", "left").withColumn("shape", shape_of("concept")).withColumn("nearest", F.slice(F.coalesce("nearest", F.array().cast("array<string>")), 1, T.MOST_NEAREST))
    open_ = [
        F.when(F.lit(missing > 0), "coverage-gap"), F.when(F.col("outside"), "external-dependency"), F.when((F.col("shape") != "term") & (F.col("creates") | F.col("sibling")), "new-surface"), F.when(F.size("nearest") > 0, "terminology-mismatch"),
    ]
    told = told.withColumn("readings", F.filter(F.array(*open_), lambda x: x.isNotNull()))
    kind = F.coalesce(F.get("readings", 0), F.lit("insufficient-evidence"))
    others = F.when(F.size("readings") == 0, F.array(*(F.lit(x) for x in T.OPEN_READINGS))).otherwise(F.slice("readings", 2, 9))
    sure = reduce(lambda out, kv: F.when(kind == kv[0], kv[1]).otherwise(out), T.READINGS.items(), F.lit(0))
    return told.select("concept", "shape", kind.alias("kind"), others.alias("others"), "requirements", "nearest", sure.alias("confidence"))


def match_warnings(asked: DataFrame, matches: DataFrame) -> DataFrame:
    """(requirement, code, concept): warnings of the concepts that requirements ask for (requirement, concept), by their ``matches``
    (concept, outcome, id). One that nothing matches is told twice, as unknown and as unresolved, unless it is speculative."""
    found = asked.distinct().join(matches.select("concept", "outcome").distinct(), "concept")
    codes = F.when((F.col("outcome") == "unknown") & ~speculative("concept"), F.array(F.lit("unknown-concept"), F.lit("unresolved-concept"))).when(F.col("outcome") == "ambiguous", F.array(F.lit("ambiguous-concept")))
    return found.select("requirement", F.explode(codes).alias("code"), "concept")
