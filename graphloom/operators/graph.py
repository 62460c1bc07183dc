"""Graph operators: functions from node and edge DataFrames to DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Up to so many kinds of ids are told to a filter, and so many bytes of files make a part of a shuffle.
MOST_KINDS, PART_BYTES = 100, 16_000_000


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` (narrow) rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over at least ``parts`` parts, or as many as shuffles have anyway."""
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def parts_for(*dfs: DataFrame) -> int:
    """How many parts a shuffle of ``dfs`` takes, so that a task holds no more as the files that they are read from grow."""
    spark = dfs[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted({f for df in dfs for f in df.inputFiles()})]
    return 1 + sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // PART_BYTES


def of_knowledge(df: DataFrame, provenance: str, wanted: tuple[str, ...]) -> DataFrame:
    """Rows whose provenance is of one of the wanted categories: deterministic, ai-inferred or human-confirmed."""
    category = F.when(F.col(provenance) == "llm-inferred", "ai-inferred").when(F.col(provenance) == "human-confirmed", "human-confirmed")
    category = category.when(F.col(provenance).isin("static-analysis", "configuration", "git-history", "framework-convention"), "deterministic")
    return df.filter(category.isin(*wanted))


def find_nodes(nodes: DataFrame, category: str | None = None, type_: str | None = None, name_part: str | None = None) -> DataFrame:
    """Nodes that pass all given filters; ``name_part`` is a case-insensitive substring."""
    for given, condition in ((category, F.col("category") == category), (type_, F.col("type") == type_), (name_part, F.contains(F.lower("name"), F.lit((name_part or "").lower())))):
        if given is not None:
            nodes = nodes.filter(condition)
    return nodes


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source or target is no node, with the missing side."""
    ids = nodes.select(F.col("id").alias("node_id"))
    sides = [edges.join(ids, F.col(side) == F.col("node_id"), "left_anti").select("id", F.lit(side).alias("missing")) for side in ("source_id", "target_id")]
    return sides[0].unionByName(sides[1])


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return count_by(df, *keys).filter("n > 1")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``.

    Ends of kinds (what stands before the colon of an id) that no node has go where they are read, if the kinds are few, and few nodes
    are broadcast.
    """
    ids = small(nodes.select(F.col("id").alias("n")))
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    kinds = [r[0] for r in ids.filter("n is not null").select(kind(F.col("n"))).distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) <= MOST_KINDS:
        edges = edges.filter(kind(F.col("source_id")).isin(kinds) & kind(F.col("target_id")).isin(kinds))
    return edges.join(ids, F.col("source_id") == F.col("n"), "left_semi").join(ids, F.col("target_id") == F.col("n"), "left_semi")


def steps(edges: DataFrame) -> DataFrame:
    """(a, b, dir, edge_type): each edge in both directions."""
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit("out").alias("dir"), F.col("type").alias("edge_type"))
    return out.unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.lit("in").alias("dir"), F.col("type").alias("edge_type")))


def neighbours(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Neighbours of (id) in both directions."""
    return steps(edges).join(anchors.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "dir", "edge_type")


def shared_folder(spark) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where that is unset, a session that runs in
    this process alone gets one of its own; on a cluster it is an error, as a local folder would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark, name: str) -> str:
    """A new folder of its own in the shared folder; it goes when the session ends, with all that is written in it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that lineage ends there; the files go when the session ends."""
    path = scratch(df.sparkSession, "graph") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distances(edges: DataFrame, anchors: DataFrame, max_depth: int, directed: bool = False) -> DataFrame:
    """(id, depth): the least number of steps from any anchor, up to ``max_depth``. One join a level; what is known
    already is anti-joined, so that a frontier holds every node once."""
    walk = staged(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))  # repeated steps end with what a level reaches
    if not directed:
        walk = walk.unionByName(walk.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = staged(anchors.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in range(1, max_depth + 1):
        reached = walk.join(small(frontier.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = staged(reached.join(known, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def longest_prefix(df: DataFrame, path: str, owners: DataFrame) -> DataFrame:
    """``df`` with owner: the longest owner path that is a whole-segment prefix of ``path``; null if there is none.

    Prefixes are exploded and hash-joined, never compared pair by pair. Rows are told apart by (id).
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = df.filter(F.col(path).isNotNull()).select("id", F.explode(prefixes).alias("prefix"))
    best = each.join(owners.select(F.col("path").alias("prefix"), F.col("id").alias("owner_id")), "prefix").groupBy("id").agg(F.max_by("owner_id", F.length("prefix")).alias("owner"))
    return df.join(best, "id", "left")


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def two_dp(x: Column) -> Column:
    """Half-up rounding to two places of a ratio that is not negative."""
    return F.floor(x * 100 + 0.5) / 100
