"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size, and each goes to the least-loaded shard through a heap. Groups are
summed to size classes of 1/256 relative width first, so that the heap runs over a bounded table (256 classes an
octave, some 12,000 at most) and not over the groups: a class of c groups of equal size takes the same shards as c
single steps would, found by filling up to a common level and the heap for the rest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import numbered, stage, table


def lpt(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """From (class, groups, bytes) the ranges (class, end, shard): a class's groups up to number ``end`` go to ``shard``."""
    load = [0.0] * shards
    out = []
    for key, count, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        size, given, left = total / count, [0] * shards, count
        if left > 2 * shards:
            low, high = min(load), max(load) + size * count
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, int((level - x) / size)) for x in load) <= count:
                    low = level
                else:
                    high = level
            given = [max(0, int((low - x) / size)) for x in load]
            left -= sum(given)
        heap = [(x + size * n, s) for s, (x, n) in enumerate(zip(load, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(left):
            x, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (x + size, s))
        end = 0
        for s, n in enumerate(given):
            if n:
                load[s] += size * n
                end += n
                out.append((key, end, s))
    return out


def assign_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard and slot. Needs doc_id, size (long, at least 1) and the group's identity g1, g2 (long).

    Rows of one group share a shard whatever their number; the sizes of shards are as near equal as LPT gets them.
    slot counts the rows of a shard from 0 without gaps, by doc_id.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    octave = F.greatest(F.lit(0), F.floor(F.log2(F.col("bytes") + 0.5)).cast("int") - 8)
    groups = stage(groups.withColumn("class", octave.cast("long") * 512 + F.floor(F.col("bytes") / F.pow(F.lit(2.0), octave)).cast("long")))
    classes = [tuple(r) for r in groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()]
    plan = sorted(lpt(classes, shards))
    key, end, shard = (np.array([p[i] for p in plan], np.int64) for i in range(3))

    starts = {int(k): (int(np.searchsorted(key, k)), int(np.searchsorted(key, k, "right"))) for k in np.unique(key)}

    def place(batches):
        for batch in batches:
            c, n = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("class", "number"))
            at = np.empty(len(c), np.int64)
            for k in np.unique(c):
                lo, hi = starts[int(k)]
                at[c == k] = lo + np.searchsorted(end[lo:hi], n[c == k], "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard[at])], names=["g1", "g2", "shard"])

    ranked = numbered(groups.select("g1", "g2", "class"), ["class"], ["g1", "g2"], "number")
    placed = ranked.select("g1", "g2", "class", "number").mapInArrow(place, "g1 long, g2 long, shard long")
    dealt = rows.join(placed, ["g1", "g2"]).drop("g1", "g2")
    return numbered(dealt, ["shard"], ["doc_id"], "slot")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    Size is the text's UTF-8 bytes plus 16. A null text counts as empty and shares the empty texts' group. Law
    ``bytes``: equal texts stay together and sizes of shards are near equal, unless one group is larger than a shard's
    share. grown_shard is null, as another shard count is another schedule. Repeated rows are kept; rows that agree in
    doc_id get their slots in any order. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(41), text).alias("g2")))
    out = assign_shards(rows, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` into 40 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))
