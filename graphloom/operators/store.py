"""Versioned snapshots, caches, artifacts and logs as tables; and scans, diffs and canonical text."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LARGEST_FILE = 1_000_000


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file context, and the path; whatever store the path is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), at


def _publish(spark: SparkSession, root: str, number: int, record: dict) -> bool:
    """Put a commit's record under its number, whole and only if there is none yet; whether it was put."""
    context, at = _files(spark, f"{root}/commits/{number:020d}.json")
    jvm = spark.sparkContext._jvm
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/drafts/{record['data']}.json")
    fs.mkdirs(at.getParent())
    out = fs.create(draft, True)
    out.write(bytearray((json.dumps(record) + "\n").encode()))
    out.close()
    try:
        context.rename(draft, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in str(failed.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False
    return True


def put_snapshot(tables: dict[str, DataFrame], snapshot_id: str, created_at: str, root: str) -> str:
    """Write the tables of a snapshot under ``root`` and commit them; the folder of this version.

    Each version has a folder of its own that nothing ever writes to again. It is seen once its commit is there: a small file
    that is put under the next free number by a rename which fails if that number is taken. So a snapshot is seen whole or not at
    all, writers that meet take numbers one after the other, and putting an id again leaves what is being read as it is.
    """
    spark = next(iter(tables.values())).sparkSession
    data = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/data/{data}/{name}")
    number = 1 + (commits(spark, root).agg(F.max("number")).first()[0] or 0)
    while not _publish(spark, root, number, {"number": number, "id": snapshot_id, "created_at": created_at, "data": data, "tables": sorted(tables)}):
        number += 1
    return f"{root}/data/{data}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(number, id, created_at, data, tables) of all commits."""
    schema = "number long, id string, created_at string, data string, tables array<string>"
    context, at = _files(spark, f"{root}/commits")
    if not context.util().exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{root}/commits/*.json")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The last commit of each snapshot."""
    last = commits(spark, root).groupBy("id").agg(F.max_by(F.struct("number", "created_at", "data", "tables"), "number").alias("c"))
    return last.select("id", "c.*")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(id, created_at), newest first."""
    return versions(spark, root).select("id", "created_at").orderBy(F.desc("created_at"), "id")


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The snapshot that was committed last."""
    row = commits(spark, root).orderBy(F.desc("number")).first()
    return row["id"] if row else None


def pinned(spark: SparkSession, root: str, snapshot_id: str) -> str:
    """The folder of a snapshot's last version. Tables under it stay as they are, whatever is put later."""
    row = versions(spark, root).filter(F.col("id") == snapshot_id).first()
    if row is None:
        raise KeyError(snapshot_id)
    return f"{root}/data/{row['data']}"


def of_snapshot(spark: SparkSession, root: str, name: str, snapshot_id: str) -> DataFrame:
    """One table of a snapshot's last version, pinned to it; only its folder is read."""
    return spark.read.parquet(f"{pinned(spark, root, snapshot_id)}/{name}")


def swept(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete the data of all but the last ``keep`` commits of each snapshot; the folders deleted. Readers of those must be done."""
    old = commits(spark, root).withColumn("age", F.row_number().over(W.partitionBy("id").orderBy(F.desc("number")))).filter(F.col("age") > keep)
    gone = [f"{root}/data/{r['data']}" for r in old.select("data").collect()]  # a row a commit
    for folder in gone:
        context, at = _files(spark, folder)
        if context.util().exists(at):
            context.delete(at, True)
    return gone


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys; one join without a sort."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(old.columns).unionByName(new.select(old.columns))


def last_write(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """For each key the columns of the row of the highest ``order``."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *columns), order).alias("b"))
    return best.select(*keys, "b.*")


def reuse_plan(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, hash) with reused: whether the cache has that path with that hash."""
    known = cache.select("path", "hash", F.lit(True).alias("reused")).distinct()
    return files.join(known, ["path", "hash"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def forward_only(events: DataFrame, key: str, order: str, status: str, ladder: tuple[str, ...]) -> DataFrame:
    """(key, status): the furthest status of the ladder that an append-only log reached; entries that go back are ignored."""
    rank = reduce(lambda out, kv: F.when(F.col(status) == kv[1], kv[0]).otherwise(out), enumerate(ladder), F.lit(-1))
    names = F.array(*(F.lit(x) for x in ladder))
    return events.groupBy(key).agg(F.max(rank).alias("r")).filter("r >= 0").select(key, F.element_at(names, F.col("r") + 1).alias(status))


def json_lines(lines: DataFrame, column: str, schema: str, needed: tuple[str, ...]) -> DataFrame:
    """The records of a log with one JSON object a line; lines that are none, or lack a needed field, are left out."""
    read = lines.select(F.from_json(column, schema).alias("r")).filter("r is not null").select("r.*")
    return read.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]))


def name_status(diffs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, status, path, old_path) of NUL-separated name-status text: a status, then a path, or two after R and C."""
    cells = F.filter(F.split(column, "\\x00"), lambda x: x != "")
    start = F.struct(F.lit("").alias("status"), F.lit("").alias("first"), F.array().cast("array<struct<status:string,path:string,old_path:string>>").alias("done"))

    def step(s, cell):
        twice = s["status"].rlike("^[RC]")
        entry = lambda path, old: F.concat(s["done"], F.array(F.struct(F.substring(s["status"], 1, 1).alias("status"), path.alias("path"), old.alias("old_path"))))
        make = lambda status, first, done: F.struct(status.alias("status"), first.alias("first"), done.alias("done"))
        nothing = F.lit("")
        return (
            F.when(s["status"] == "", make(cell, nothing, s["done"])).when(twice & (s["first"] == ""), make(s["status"], cell, s["done"]))
            .when(twice, make(nothing, nothing, entry(cell, s["first"]))).otherwise(make(nothing, nothing, entry(cell, F.lit(None).cast("string"))))
        )

    return diffs.select(key, F.explode(F.aggregate(cells, start, step, lambda s: s["done"])).alias("e")).select(key, "e.*")


def scanned(files: DataFrame, ignored: Column, links: Column | None = None) -> DataFrame:
    """``files`` (path, length) with skip: why a file is left out (ignored, link, too-large), or null."""
    out = F.when(ignored, "ignored")
    if links is not None:
        out = out.when(links, "link")
    return files.withColumn("skip", out.when(F.col("length") > LARGEST_FILE, "too-large"))


def last_rule(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a path is ignored: the last (pattern, negated) that fits decides."""
    return reduce(lambda out, rule: F.when(path.rlike(rule[0]), not rule[1]).otherwise(out), rules, F.lit(False))


def rooted(roots: dict[str, DataFrame], path: str) -> DataFrame:
    """The files of several roots, their paths below the root's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("root", F.lit(name)).withColumn(path, F.concat_ws("/", F.lit(name), path)) for name, df in roots.items()])


def golden(rows: DataFrame, *columns: str) -> DataFrame:
    """(line): the columns joined by a bar, nulls as nothing."""
    return rows.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def manifest_facts(manifests: DataFrame, key: str, column: str) -> DataFrame:
    """(key, block, name, version) of package manifests: the four dependency blocks, the first block that has a name winning; and their entry points."""
    blocks = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = ", ".join(f"`{b}` map<string, string>" for b in blocks) + ", `main` string, `module` string, `bin` map<string, string>"
    read = manifests.select(key, F.from_json(column, schema).alias("m"))
    row = lambda place, block, name, version: F.struct(F.lit(place).alias("place"), F.lit(block).alias("block"), name.alias("name"), version.alias("version"))
    of_map = lambda c, place, block: F.coalesce(F.transform(F.map_entries(c), lambda e: row(place, block, e["key"], e["value"])), F.array())
    points = F.filter(F.array(*(row(len(blocks), "entry", F.lit(n), F.col(f"m.{n}")) for n in ("main", "module"))), lambda x: x["version"].isNotNull())
    every = F.concat(*(of_map(f"m.{b}", i, b) for i, b in enumerate(blocks)), points, of_map("m.bin", len(blocks), "entry"))
    each = read.select(key, F.explode(every).alias("e")).select(key, "e.*")  # a manifest is read once
    own = F.when(F.col("place") == len(blocks), F.monotonically_increasing_id() + 1).otherwise(0)  # entry points all stay
    first = each.withColumn("own", own).groupBy(key, "name", "own").agg(F.min_by(F.struct("block", "version"), "place").alias("b"))
    return first.select(key, "b.block", "name", "b.version")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, payload): every record as JSON with its version, nulls left out."""
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(F.lit(1).alias("version"), *df.columns)).alias("payload"))
    return told(nodes, "node").unionByName(told(edges, "edge"))


def read_graph_json(records: DataFrame, kind: str, schema: str) -> DataFrame:
    """The records of a kind read back; those of another version are left out."""
    read = records.filter(F.col("kind") == kind).select(F.from_json("payload", f"version int, {schema}").alias("r"))
    return read.filter("r.version = 1").select("r.*").drop("version")


def snapshot_round_trip(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` written as the current snapshot of ``root`` and read back by the pointer."""
    spark = nodes.sparkSession
    put_snapshot({"nodes": nodes, "edges": edges}, "s1", "2024-01-01T00:00:00Z", root)
    at = current_snapshot(spark, root)
    return of_snapshot(spark, root, "nodes", at), of_snapshot(spark, root, "edges", at)

