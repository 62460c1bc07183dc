"""Impact, rule, overlay and review operators over node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_violations(edges: DataFrame, contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges whose ends lie in the contexts that a rule forbids: (rule, source_id, target_id).

    ``contexts`` has (id, context), ``rules`` has (rule, source_context, target_context).
    """
    side = lambda end: contexts.select(F.col("id").alias(f"{end}_id"), F.col("context").alias(f"{end}_context"))
    return edges.join(side("source"), "source_id").join(side("target"), "target_id").join(rules, ["source_context", "target_context"]).select("rule", "source_id", "target_id")


def missing_companions(changes: DataFrame, commit: str, trigger: Column, companion: Column) -> DataFrame:
    """Commits that hold a row for which ``trigger`` is true but none for which ``companion`` is."""
    each = changes.groupBy(commit).agg(F.count_if(trigger).alias("triggers"), F.count_if(companion).alias("companions"))
    return each.filter("triggers > 0 and companions = 0").select(commit, "triggers")


def effective(candidates: DataFrame, key: str, rank: Column, position: str, value: str) -> DataFrame:
    """Per key the value of lowest rank; among equal ranks the latest position wins. One partial aggregate, no sort."""
    best = F.min(F.struct(rank.alias("rank"), (-F.col(position)).alias("later"), F.col(value).alias("value")))
    return candidates.groupBy(key).agg(best.alias("best"), F.count("*").alias("candidates")).select(key, F.col("best.value").alias(value), (-F.col("best.later")).alias(position), "candidates")


def compared(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Adds finding to rows with two flags: matched, missing (predicted only) or unexpected (actual only)."""
    return pairs.withColumn("finding", F.when(F.col(predicted) & F.col(actual), "matched").when(F.col(predicted), "missing").otherwise("unexpected"))


def shared_names(df: DataFrame, name: Column, renamed: Column) -> DataFrame:
    """Effective names that several rows share, at least one of them by a renaming."""
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.bool_or(renamed).alias("renamed")).filter("n > 1 and renamed").select("name", "n")
