"""N-gram Jaccard join by parity sketches.

Words of a text give a set of hashed shingles. A parity sketch XORs every shingle into one band of a wide bit
vector, so that the Hamming distance of two sketches is at most the size of the sets' symmetric difference. Two sets
with Jaccard similarity of at least p/100 and sizes of one size band differ in at most D elements, D known from the
band. With K > D bands at least K - D bands of such a pair are equal bit by bit, so the join on (size band, band
number, band bits) loses no pair. All-zero bands say nothing, and are skipped while a set has fewer than K - D of them;
the few sets with more emit them as well. Candidates pass a Hamming test on a folded sketch and are then verified on
the exact shingle sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free, led, link_buckets, multi_buckets, release, slices, small_side, stage, table

U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    """Word to 64-bit hash; forgets everything at a bounded size."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of the whole text; of all words if there are fewer."""
    if not text:
        return np.empty(0, U)
    hashed = np.array([words[w] for w in text.encode("utf-8", "surrogatepass").lower().split()], U)
    if not len(hashed):
        return hashed
    k = min(width, len(hashed))
    rows = len(hashed) - k + 1
    out = np.full(rows, k, U)
    for i in range(k):
        out = mix(out ^ hashed[i : i + rows], i)
    return np.unique(out)


@lru_cache(maxsize=None)
def size_bands(percent: int, limit: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each size band, and its D and K. A pair at the threshold lies in one band or in neighbours."""
    step = 100 / percent if percent < 90 else (100 / percent) ** 2
    first, most, parts = [1], [], []
    while first[-1] < limit:
        lo, hi = first[-1], max(first[-1], int(first[-1] * step))
        d = 2 * hi * (100 - percent) // (100 + percent)
        slack = 0
        if d:
            slack = 2
            for _ in range(8):
                empty = (d + 1 + slack) * math.exp(-lo / (d + 1 + slack))
                slack = min(d + 2, max(2, math.ceil(empty + 3 * math.sqrt(empty))))
        most.append(d)
        parts.append(d + 1 + slack)
        first.append(hi + 1)
    return np.array(first), np.array(most), np.array(parts)


def band_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of one set, for its own size band and for the next if a larger partner may lie there."""
    n = len(found)
    if not n:
        return np.empty(0, np.int64)
    first, most, parts = size_bands(percent)
    own = int(np.searchsorted(first, n, "right")) - 1
    keys = []
    for band in (own, own + 1) if n * 100 // percent >= first[own + 1] else (own,):
        k, d = int(parts[band]), int(most[band])
        where = (found >> U(20)) % U(k)
        order = np.argsort(where, kind="stable")
        bits = np.concatenate([np.zeros(1, U), np.bitwise_xor.accumulate(mix(found, 77)[order])])
        ends = np.searchsorted(where[order], np.arange(k + 1, dtype=U))
        part = bits[ends[1:]] ^ bits[ends[:-1]]
        full = part != 0
        chosen = np.arange(k) if k - int(full.sum()) >= k - d else np.flatnonzero(full)
        keys.append(mix(mix(part[chosen] ^ U(band), 3) + chosen.astype(U), 4))
    return np.concatenate(keys).view(np.int64)


def folded(found: np.ndarray) -> bytes:
    """The sketch folded to about two bits an element: the parity of the elements of each bit."""
    width = max(64, 1 << (2 * len(found)).bit_length())
    counts = np.bincount((found & U(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def features(docs: DataFrame, width: int, percent: int, most: int = 250_000) -> DataFrame:
    """(doc_id, n, h1, h2, sketch, sole, lead, tail) for each row of (doc_id, text); the keys of about ``most`` at a time
    are told apart, and copies of a set among them have none."""

    def run(batches):
        words, rows, keys, seen, total = Words(), [], [], set(), 0

        def flush():
            doc_id, n, h1, h2, sketch = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip((doc_id, n, h1, h2, sketch), kinds, strict=True)]
            made = pa.RecordBatch.from_arrays([*columns, *led(keys)], names=["doc_id", "n", "h1", "h2", "sketch", "sole", "lead", "tail"])
            rows.clear(), keys.clear(), seen.clear()
            return made

        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = shingles(text.as_py(), width, words)
                    with np.errstate(over="ignore"):
                        name = (len(found), *(int(mix(found, salt).sum(dtype=U).view(np.int64)) for salt in (101, 202)))
                    rows.append((doc_id, *name, folded(found)))
                    keys.append(np.empty(0, np.int64) if name in seen else band_keys(found, percent))
                    seen.add(name)
                    total += len(keys[-1])
                    if total > most or len(rows) >= 4096:
                        total = 0
                        yield flush()
        if rows:
            yield flush()
        words.clear()
        release()

    lists = ", ".join(f"{x} array<long>" for x in ("sole", "lead", "tail"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n long, h1 long, h2 long, sketch binary, {lists}")


def most_apart(n, m, percent: int):
    """The largest symmetric difference of linked sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def verified(docs: DataFrame, info: DataFrame, width: int, percent: int):
    """A function from candidate pairs (a, b) to the true links."""

    def close(batches):
        for batch in batches:
            x = [batch.column(i).to_pylist() for i in range(6)]
            keep = []
            for n, m, s, t in zip(*x[2:], strict=True):
                if len(s) > len(t):
                    s, t = t, s
                p, q = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8).reshape(-1, len(s))
                keep.append(int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q, axis=0)).sum()) <= most_apart(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["a", "b"])

    def exact(batches):
        words, last = Words(), (None, None)
        for batch in batches:
            a, b, s, t = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                x = a[i].as_py()
                if last[0] != x:
                    last = (x, shingles(s[i].as_py(), width, words))
                other = shingles(t[i].as_py(), width, words)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
        words.clear()
        release()

    def verify(pairs: DataFrame) -> DataFrame:
        left = info.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = info.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        near = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        near = stage(near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(close, "a long, b long"))
        ids = stage(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(ids), "doc_id", "left_semi")
        both = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), "a")
        return both.select("a", "b", "t_a", "t_b").mapInArrow(exact, "a long, b long")

    return verify


def near(percent: int):
    """For link_buckets: the rows whose sketches, folded to one width, are near enough to be linked."""

    def compare(size, sketches):
        width = min(map(len, sketches))
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0) for s in sketches])
        bits = bits.view(np.uint64)
        for i in range(len(size) - 1):
            end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
            apart = np.bitwise_count(bits[i + 1 : end] ^ bits[i]).sum(axis=1)
            yield i, i + 1 + np.flatnonzero(apart <= most_apart(size[i + 1 : end], size[i], percent))

    return compare


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    ``docs`` has doc_id and text; other columns are ignored. Words are runs without ASCII white space, A-Z
    lower-cased, of the whole text. Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    ``width``-word shingles (all words as one shingle if there are fewer). Null or wordless texts have no shingle, link
    with nothing and are their own component. Rows with a null doc_id are left out; rows that share a doc_id are each
    reported, and a link of one counts for the component of that doc_id's set of shingles. Exact copies of a set share
    one representative, so copies are never expanded into pairs. An empty table gives an empty result.
    """
    made = stage(features(docs.filter("doc_id is not null"), width, percent))
    sets = made.select("doc_id", "n", "h1", "h2")
    firsts = stage(sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id")))
    names = sets.join(firsts, ["n", "h1", "h2"]).select(F.col("doc_id").alias("id"), F.col("id").alias("name")).distinct()
    sketches = made.select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "sketch")
    members = stage(multi_buckets(made.select(F.col("doc_id").alias("id"), "sole", "lead", "tail"), names))
    labels = link_buckets(members, lambda ids: sketches, verified(docs, made.select("doc_id", "n", "sketch"), width, percent), near(percent))
    named = firsts.join(labels, "id", "left").select("n", "h1", "h2", F.coalesce("label", "id").alias("component_id"))
    return sets.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with only the document of smallest doc_id of each component; columns as they were.

    Where rows share a doc_id they are compared row by row, so that of different texts under one doc_id each stays unless it
    is linked with another row, and of rows that are linked under one doc_id one stays. Rows without a doc_id aren't compared
    and stay. Texts aren't shuffled while the ids of what goes are few enough to broadcast.
    """
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        classes = jaccard_classes(docs, width, percent)
        gone = stage(classes.filter("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    (row,) = free(docs, "row_mark")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    named = rows.filter("doc_id is not null")
    classes = stage(jaccard_classes(named.select(F.col(row).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias(row), "component_id"))
    ids = classes.join(named.select(row, "doc_id"), row)
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", row))[row].alias("first"))
    gone = stage(ids.join(first, "component_id").filter(F.col(row) != F.col("first")).select(row))
    return rows.join(small_side(gone), row, "left_anti").select(docs.columns)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at 90 percent of 3-word shingles."""
    return jaccard_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (n + m - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT id, b FROM reach JOIN both_ways ON other = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON id = doc_id
"""
