"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: A side of a join is broadcast only when a count showed at most so many rows, and a sum at most so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 48_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``, opened by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a session that runs in
    this process alone gets one of its own; on a cluster it is an error, as a local folder would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, both of them measured; else
    unchanged, so that the join shuffles."""
    if df.limit(rows + 1).count() > rows:
        return df
    fixed = 16 + sum(8 for f in df.schema.fields if isinstance(f.dataType, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType))
    open_ended = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType)]
    wide = F.lit(fixed)
    for name in open_ended:
        kind = df.schema[name].dataType
        wide += F.coalesce(F.octet_length(name) if isinstance(kind, StringType | BinaryType) else 2 * F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
    most = df.agg(F.sum(wide.cast("long"))).first()[0] or 0 if open_ended else fixed * rows if fixed * rows <= size else fixed * df.count()
    return F.broadcast(df) if most <= size else df


@contextmanager
def arrow_rows(spark: SparkSession, most: int | None):
    """What runs meanwhile hands its Python workers ``most`` rows at once, or as many as the session says if that is null."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Gives freed memory of this process back, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """At the end of a task: what its arrays held goes back to the machine, as the next task may run in the same worker."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000):
    """``batch`` in parts of about ``most`` bytes of the (string) column, one row at least; copies nothing."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    share = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:], strict=False):
        if end > start:
            yield batch.slice(start, end - start)


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` doesn't have (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (w, *(f"{w}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken) for w in wanted]


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as DDL."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (id, label), label being the smallest id reachable.

    Each round every vertex takes the smallest label among its neighbours, then the label of its label. All state
    is in written tables; nothing is collected. Vertices without links don't occur.
    """
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        moved = stage(step.join(up, "next", "left").select("id", "old", F.least("next", F.coalesce("above", "next")).alias("label")))
        labels = moved.select("id", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, label) of the components that ``labels`` are of and more ``links`` (a, b): as ``components`` of all links gives them,
    from the graph of those components that the new links join."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    named = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    joins = stage(named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b").distinct())
    if joins.isEmpty():
        return labels
    above = components(joins).select(F.col("id").alias("label"), F.col("label").alias("above"))
    moved = labels.join(above, "label", "left").select("id", F.coalesce("above", "label").alias("label"))
    new = above.join(labels.select(F.col("id").alias("label")), "label", "left_anti").select(F.col("label").alias("id"), F.col("above").alias("label"))
    return stage(moved.unionByName(new))


def link_buckets(members: DataFrame, info: DataFrame, verify, compare, block: int = 2048, pivot_rounds: int = 3, few: int = 32, exact: bool = False) -> DataFrame:
    """Components of the graph whose links are the true pairs among rows that share a bucket.

    ``members`` has (key, id, pivot, n): buckets of at least two ids, each with its smallest id and its size.
    ``info(ids)`` gives (id, size, sketch) of the rows of ``ids`` at least. ``verify`` takes pairs (a, b), a < b, and returns those that are true links.
    ``compare(size, sketch)`` takes the sizes (array) and sketches (list of bytes) of some rows in order of size, and
    yields for each row i the later rows j that may be linked with it, as (i, array of j).

    Pairs of a bucket are not listed while one component holds it: first every member is held against the pivot;
    then only buckets whose other members still are in several components go on. Those over ``few`` members take
    more pivots first, each of which costs no more than a pair a member. What is left is compared across components in cells of two blocks of bounded size each, and only
    pairs that pass ``compare`` are listed and verified, so that no link is lost. Returns (id, label) for linked ids.

    With ``exact``, ``compare`` also gets the labels, and what it yields are true links, enough of them to join all rows of a cell
    that true links join. Then nothing more is verified, and only buckets over a block take more pivots.
    """
    links = stage(verify(members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()))
    labels = components(links)

    def apart(rows):
        """Rows (key, id) of the buckets that several components hold."""
        named = rows.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        state = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("pivot"), F.min_by("label", "id").alias("pivot_label"), F.count("*").alias("n")).filter("lo <> hi")
        return stage(named.join(state.drop("lo", "hi"), "key"))

    rest = apart(members.filter("n > 2 and id <> pivot").select("key", "id"))
    few = max(few, block) if exact else few
    hot = rest.filter(F.col("n") > few)
    aside = rest.filter(F.col("n") <= few).select("key", "id")  # small buckets wait until the large ones have had their pivots
    moved = False
    for _ in range(pivot_rounds):
        if hot.isEmpty():
            break
        pairs = hot.filter("label <> pivot_label").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        labels, moved = grown(labels, stage(verify(pairs.distinct()))), True
        hot = apart(hot.filter("id <> pivot").select("key", "id"))
        aside = aside.unionByName(hot.filter(F.col("n") <= few).select("key", "id"))
        hot = hot.filter(F.col("n") > few)
    if moved:
        rest = apart(aside).unionByName(hot)
    if rest.isEmpty():
        return labels
    pairs = _compared(rest, info, compare, block, exact).distinct()
    return grown(labels, stage(pairs if exact else verify(pairs)))


def _compared(rest: DataFrame, info: DataFrame, compare, block: int, exact: bool) -> DataFrame:
    """Pairs (a, b) across components that pass ``compare``, from rows (key, id, label, n)."""

    def cells(batches):
        held, rows = None, []

        def listed(low, high):
            columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (low, high)]
            low.clear(), high.clear()
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        def pairs():
            rows.sort()
            size, name, label, part = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            if (label == label[0]).all():
                return
            low, high, n = [], [], 0
            for i, js in compare(size, [r[4] for r in rows], *([label] if exact else [])):
                js = js[(label[js] != label[i]) & ((part[js] != part[i]) | (held[1] == held[2]))]
                low.append(np.minimum(name[js], name[i]))
                high.append(np.maximum(name[js], name[i]))
                n += len(js)
                if n > 50_000:
                    n = 0
                    yield listed(low, high)
            yield listed(low, high)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                    if held != (key, lo, hi):
                        if len(rows) > 1:
                            yield from pairs()
                        held, rows = (key, lo, hi), []
                    rows.append(tuple(row))
        if len(rows) > 1:
            yield from pairs()
        release()

    blocks = F.ceil(F.col("n") / block).cast("int")
    part = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = rest.join(info(rest.select("id").distinct()), "id").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "size", "id", "label", "part", "sketch")
    return cell.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(cells, "a long, b long")


def led(keys: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The keys of some rows as three lists a row: ``sole`` (no other of these rows has the key), ``lead`` (the first
    of several that have it) and ``tail`` (the others)."""
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    held = key[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.empty(0, bool)
    last = np.append(new[1:], True) if len(held) else new
    out = []
    for chosen in (new & last, new & ~last, ~new):
        at = np.sort(order[chosen])
        ends = np.cumsum(np.bincount(row[at], minlength=len(keys))) if len(keys) else []
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key[at], pa.int64())))
    return tuple(out)


def flat(df: DataFrame, *lists: str, most: int = 100_000) -> DataFrame:
    """(key, id, more) of (id, lists of keys), about ``most`` at a time: ``more`` is 1 for keys of every list but the first."""

    def run(batches):
        for batch in batches:
            for more, column in enumerate(batch.columns[1:]):
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
                for start, end in zip(edges, edges[1:], strict=False):
                    key = column.slice(start, end - start).flatten()
                    if len(key):
                        owner = np.repeat(batch.column(0).slice(start, end - start).to_numpy(), sizes[start:end])
                        yield pa.RecordBatch.from_arrays([key, pa.array(owner, pa.int64()), pa.array(np.full(len(key), min(more, 1)), pa.int64())], names=["key", "id", "more"])
        release()

    return df.select("id", *lists).mapInArrow(run, "key long, id long, more long")


def multi_buckets(made: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """From written rows (id, sole, lead, tail) as ``led`` makes them, the buckets (key, id, pivot, n) of at least two
    ids: pivot is the smallest id of the key, n the number of its ids. ``names`` (id, name) renames ids first.

    A key sends one row for every group of rows that ``led`` saw together to its task, and so a key that all rows have
    no more than a row for some thousands of them. Which row that is stands in the table, so that a task that runs
    again, or cut otherwise, finds the same. Repeats join no one: their key has a lead, and so is of several rows.
    """
    by = W.partitionBy("key")
    heads = flat(made, "sole", "lead").withColumn("rows", F.count("*").over(by) + F.sum("more").over(by)).filter("rows > 1").select("key", "id")
    every = stage(heads.unionByName(flat(made, "tail").select("key", "id")))
    if names is not None:
        every = every.join(names, "id").select("key", F.col("name").alias("id"))
    every = stage(every.distinct())
    sizes = every.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    return every.join(stage(sizes), "key").select("key", "id", "pivot", "n")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in each group of ``by``, in the order of ``order``.

    Rows are dealt by range over groups and order together, so a group of any size spreads over many tasks; the
    starts of a group's parts come from sums of counts. ``by`` has one integer column, without nulls.
    """
    (key,) = by
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = schema_of(df)
    part_, index_, start_, most_ = free(df, "_part", "_index", "_start", "_most")

    def local(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            if not len(values):
                continue
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            index = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
            if values[0] == last:
                index[: starts[1] if len(starts) > 1 else len(values)] += n
            last, n = values[-1], int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part)), pa.array(index)], names=[*batch.schema.names, part_, index_])

    dealt = df.repartitionByRange(width, *by, *order).sortWithinPartitions(*by, *order)
    kept = stage(dealt.mapInArrow(local, f"{schema}, {part_} long, {index_} long"))
    counts = kept.groupBy(key, part_).agg(F.max(index_).alias(most_))
    before = W.partitionBy(key).orderBy(part_).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, part_, F.coalesce(F.sum(F.col(most_) + 1).over(before), F.lit(0)).alias(start_))
    return kept.join(small_side(stage(starts)), [key, part_]).withColumn(name, F.col(start_) + F.col(index_)).drop(part_, index_, start_)
