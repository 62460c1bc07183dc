"""Filter interaction audit by a walk over all subsets of filters in Gray-code order.

Every document is read once, for the mask of the filters that it fails. Counts by part, mask and label are all that the
audit needs: a part has at most one cell for each mask. From one subset of active filters to the next a single filter
is toggled; each cell counts its active failures, and enters or leaves the running survivors where that count leaves or
reaches zero. The survivors of all subsets are kept, and any step of any order is a difference of two of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import small_side, table

#: Ends of words: ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"


def rules(text: Column) -> dict[str, Column]:
    """The failure conditions of the filters that read nothing but a document's own text (never null)."""
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def subset_survivors(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """For every subset of ``filters`` filters (a bit each), the column sums of ``counts`` over the cells whose mask has no
    filter of the subset: one walk, one filter toggled at a time."""
    kept = np.empty((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    kept[0] = running
    subset = 0
    for turn in range(1, 1 << filters):
        bit = (turn & -turn).bit_length() - 1
        subset ^= 1 << bit
        on = subset >> bit & 1
        touched = np.flatnonzero(masks >> bit & 1)
        failing[touched] += 1 if on else -1
        if on:
            running = running - counts[touched[failing[touched] == 1]].sum(axis=0)
        else:
            running = running + counts[touched[failing[touched] == 0]].sum(axis=0)
        kept[subset] = running
    return kept


def order_steps(kept: np.ndarray, names: str) -> pd.DataFrame:
    """A row for each order of the filters ``names`` and each of its steps, from ``subset_survivors``' columns: documents,
    good ones, toxic ones."""
    n = len(names)
    full = (1 << n) - 1
    shapley = {}
    for f in range(n):
        without = [s for s in range(1 << n) if not s >> f & 1]
        shapley[f] = sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(kept[s, 0] - kept[s | 1 << f, 0]) for s in without)
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(names[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = kept[before] - kept[after]
            fails = kept[0, 0] - kept[1 << f, 0]
            rows.append((name, step, kept[after, 0], gone[0], fails - gone[0], kept[full ^ 1 << f, 0] - kept[full, 0], gone[1], gone[2], shapley[f]))
            before = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of ``docs`` (doc_id, text, lang) fail just the filters of ``mask``.

    Bits 0 to 4 are A to E. Texts are told apart by SHA-256 and never shuffled. Copies are added up before they meet, so
    that a text, a part or a document that holds most rows takes a row for each task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.lit(0)
    for i, fails in enumerate(rules(F.col("text")).values()):
        own = own + F.when(fails, 1 << i).otherwise(0)
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), own.alias("mask"))
    each = rows.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = each.join(small_side(marks.filter("good = 1 or toxic = 1")), "doc_id", "left")
    groups = marked.groupBy("key", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    lead = F.min("first.doc_id").over(W.partitionBy("key"))
    firsts = groups.withColumn("once", F.col("nameless") + F.when(F.col("first.doc_id") == lead, F.col("first.n")).otherwise(0))
    parts = F.explode(F.array(F.struct(F.col("mask"), F.col("once").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("once")).alias("n"))))
    cells = firsts.select("part", "good", "toxic", parts.alias("cell")).filter("cell.n > 0")
    return cells.groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic").agg(F.sum("cell.n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row, zeros
    included, for each value of lang, each of the 120 orders of the filters A to E, and each of its five steps.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are ignored. A null lang and an
    empty one are the part "". A null text is empty: it fails A only, and E as a copy of any other empty text. Rows that
    share doc_id and text are each counted and not copies of each other; a row without a doc_id is neither a copy nor an
    original, and has no label. Of several labels of a doc_id any 1 counts. An empty table gives an empty result.
    """

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        n = cells["n"].to_numpy(np.int64)
        counts = np.stack([n, n * cells["good"].to_numpy(np.int64), n * cells["toxic"].to_numpy(np.int64)], axis=1)
        steps = order_steps(subset_survivors(cells["mask"].to_numpy(np.int64), counts, 5), "ABCDE")
        steps.insert(0, "part", cells["part"].iloc[0])
        return steps

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return failure_cells(docs, labels).groupBy("part").applyInPandas(walk, f"part string, filter_order string, step int, {longs}")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all ``documents``, in every order, by language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe
  FROM w LEFT JOIN l USING (doc_id)
), fails AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [fa, fb, fc, fd, fe][i]) AS bad FROM f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
cells AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
at_step AS (
  SELECT part, filter_order, step, n, good, toxic, bad, filter_order[step] AS own, list_contains(bad, filter_order[step]) AS fails_own,
    len(list_filter(bad, lambda b: strpos(filter_order[1:step - 1], b) > 0)) > 0 AS gone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails_own AND len(bad) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails_own THEN toxic ELSE 0 END) AS toxic_lost
  FROM at_step GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
