"""Line dedup by a segment-partition edit join.

Two lines within t edits share one of the t + 1 segments that the shorter one is split into, at nearly the same place.
Every line gives its own segments and the substrings at which it may hold a segment of a line up to t shorter (the
multi-match-aware choice), all keyed by that length and the segment's number. Lines that share a key are candidates,
and are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free, led, link_buckets, multi_buckets, release, slices, small_side, stage, table


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """Start and length of the t + 1 near-even segments of a line."""
    base, longer = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = base + (i >= t + 1 - longer)
        out.append((at, n))
        at += n
    return out


class Probes(dict):
    """Length of a line to the (length, segment number, start, end) it is to be looked up by."""

    def __init__(self, t: int):
        self.t = t

    def __missing__(self, length: int) -> list[tuple[int, int, int, int]]:
        out = []
        for shorter in range(max(self.t + 1, length - self.t), length + 1):
            gap = length - shorter
            for i, (p, n) in enumerate(segments(shorter, self.t)):
                lo = max(p - i, p + gap - (self.t - i), 0)
                hi = min(p + i, p + gap + (self.t - i), length - n)
                out += [(shorter, i, s, s + n) for s in range(lo, hi + 1)]
        self[length] = out
        return out


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance of two lines is at most t, by bit vectors over the band of 2 t + 1 diagonals."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > t:
        return False
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    band = (1 << (2 * t + 1)) - 1
    # bit r of state d: a[: j - t + r] is within d edits of b[:j]
    states = [((1 << (d + 1)) - 1) << t & band for d in range(t + 1)]
    for j, c in enumerate(b):
        here = places.get(c, 0)
        equal = (here >> (j - t) if j >= t else here << (t - j)) & band
        last = new = states[0] & equal
        out = [new]
        for d in range(1, t + 1):
            before = states[d - 1]
            new = (states[d] & equal) | before >> 1 | before | (last << 1 & band)
            # nothing lies before the start of a
            out.append(last := new & (band << max(0, t - j - 1)) & band)
        states = out
        if not states[t]:
            return False
    r = len(a) - len(b) + t
    return bool(states[t] >> r & 1)


def marks(line: str) -> tuple[int, int]:
    """Parities of the counts of characters and of character pairs, 64 bits each: an edit turns at most two of the first
    and four of the second."""
    wide = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    pairs = (wide[:-1] * np.uint64(31) + wide[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)
    one = np.uint64(1)
    return int(np.bitwise_xor.reduce(one << (wide & np.uint64(63)))), int(np.bitwise_xor.reduce(one << pairs))


def name_of(line: str) -> int:
    """The 64-bit hash that names a line, the same as Spark's xxhash64 of it."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def lines_of(docs: DataFrame, edits: int, min_chars: int, most: int = 250_000) -> DataFrame:
    """(doc_id, line_no, row, id, sole, lead, tail) of the lines that are not blank, of rows (doc_id, text, row).

    There are no keys for lines of up to ``edits`` characters, nor for lines that the same task met a little before;
    the others of about ``most`` at a time are told apart.
    """

    def run(batches):
        probes = Probes(edits)
        seen: set[int] = set()
        places: tuple[list, ...] = ([], [], [], [])
        keys: list[np.ndarray] = []
        none, total = np.empty(0, np.int64), 0

        def flush():
            kinds = (pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(places, kinds, strict=False)]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(np.array(places[3], np.uint64).view(np.int64)), *led(keys)], names=["doc_id", "line_no", "row", "id", "sole", "lead", "tail"])
            for held in (*places, keys):
                held.clear()
            return made

        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                for doc_id, text, row in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    for line_no, raw in enumerate((text.as_py() or "").split("\n")):
                        line = trimmed(raw)
                        if len(line) < min_chars or not line.strip():
                            continue
                        name = name_of(line)
                        found = none
                        if len(line) > edits and name not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(name)
                            wide = line.encode("utf-32-le", "surrogatepass")
                            found = np.array([xxhash.xxh3_64_intdigest(wide[4 * a : 4 * b], n * 8 + k) for n, k, a, b in probes[len(line)]], np.uint64).view(np.int64)
                        keys.append(found)
                        total += len(found) + 1
                        for column, value in zip(places, (doc_id, line_no, row, name), strict=True):
                            column.append(value)
                    if total > most:
                        total = 0
                        yield flush()
        if keys:
            yield flush()
        seen.clear()
        release()

    lists = ", ".join(f"{x} array<long>" for x in ("sole", "lead", "tail"))
    return docs.select(F.col("doc_id").cast("long"), "text", "row").mapInArrow(run, f"doc_id long, line_no int, row long, id long, {lists}")


def trimmed(raw: str) -> str:
    return raw.strip(" \t\r")


def classed(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """doc_id, line_no, id, class_id, class_lines, kept, placed: as ``line_classes``, with the line's hash, and with
    whether the kept line of the class stands at the same doc_id and line_no."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    made = stage(lines_of(docs.withColumn("row", F.monotonically_increasing_id()), edits, min_chars))
    lines = made.select("doc_id", "line_no", "id")

    def texts(ids: DataFrame) -> DataFrame:
        """(id, line), each line read from the first document that has it; the hash tells rows of one doc_id apart."""
        where = lines.join(small_side(stage(ids)), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
        places = stage(where.select("id", "at.doc_id", "at.line_no"))
        found = docs.join(small_side(places), "doc_id")
        line = F.trim(F.try_element_at(F.split("text", "\n", -1), F.col("line_no") + 1), F.lit(" \t\r"))
        return found.select("id", line.alias("line")).filter(F.xxhash64("line") == F.col("id")).dropDuplicates(["id"])

    def near(batches):
        for batch in batches:
            keep = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])
        release()

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs)
        held = stage(texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")

    def compare(size, raw, label):
        held, label = [r.decode() for r in raw], label.copy()
        one, two = np.array([marks(x) for x in held], np.uint64).T
        for i in range(len(held) - 1):
            end = int(np.searchsorted(size, size[i] + edits, "right"))
            close = np.bitwise_count(one[i + 1 : end] ^ one[i]) <= 2 * edits
            close &= np.bitwise_count(two[i + 1 : end] ^ two[i]) <= 4 * edits
            close &= label[i + 1 : end] != label[i]
            links = []
            for j in (np.flatnonzero(close) + i + 1).tolist():
                if label[j] != label[i] and within(held[i], held[j], edits):
                    links.append(j)
                    label[label == label[j]] = label[i]  # what a link has joined needs no other link
            yield i, np.array(links, np.int64)

    def info(ids: DataFrame) -> DataFrame:
        return texts(ids).select("id", F.char_length("line").cast("long").alias("size"), F.col("line").cast("binary").alias("sketch"))

    members = stage(multi_buckets(made.select("id", "sole", "lead", "tail")))
    labels = link_buckets(members, info, verify, compare, exact=True)
    rows = stage(made.select("doc_id", "line_no", "row", "id").join(small_side(labels), "id", "left").withColumn("class_id", F.coalesce("label", "id")).drop("label"))
    several = stage(rows.groupBy("class_id").agg(F.count("*").alias("class_lines")).filter("class_lines > 1"))
    place = F.struct("doc_id", "line_no", "row")
    first = rows.join(small_side(several), "class_id").groupBy("class_id").agg(F.min(place).alias("first"), F.max("class_lines").alias("class_lines"))
    first = stage(first.select("class_id", "class_lines", *(F.col(f"first.{x}").alias(f"first_{x}") for x in ("doc_id", "line_no", "row"))))
    alone = F.col("first_doc_id").isNull()
    here = alone | (F.col("doc_id") == F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    each = rows.join(small_side(first), "class_id", "left")
    return each.select("doc_id", "line_no", "id", "class_id", F.coalesce("class_lines", F.lit(1)).cast("long").alias("class_lines"), (alone | here & (F.col("row") == F.col("first_row"))).alias("kept"), here.alias("placed"))


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 1) -> DataFrame:
    """One row per line of at least ``min_chars`` characters that isn't blank: doc_id, line_no, class_id, class_lines
    (number of lines of the class), kept (true for one line of the class, the first by doc_id and line_no).

    Lines are equal if the trimmed texts are; lines of more than ``edits`` characters also link within ``edits``
    edits (code points). A class is what links reach. class_id is a hash of one of its lines (64 bits: two different lines among 100
    million fall together with a chance of 0.0003). Null and empty texts have no lines; rows with a null doc_id are
    left out; repeated rows count as lines of their own, of which one is kept. An empty table gives an
    empty result. Other columns are ignored.
    """
    return classed(docs, edits, min_chars).select("doc_id", "line_no", "class_id", "class_lines", "kept")


def drop_duplicate_lines(docs: DataFrame, edits: int = 2, min_chars: int = 16) -> DataFrame:
    """``docs`` with only the first line of each class of duplicates; other lines and columns stay, n_chars follows.

    Lines under ``min_chars`` characters (list marks, brackets, one-word answers) repeat without being copies and stay.
    Documents that lose all they say (nothing but white space is left) are duplicates themselves and go. Rows without a
    doc_id or text stay as they are. Whole rows that repeat, doc_id included, can't be told apart and keep the same
    lines; of lines at the same place of different rows that share a doc_id only the copies go.
    """
    gone, = free(docs, "_drops")
    drops = stage(classed(docs, edits, min_chars).filter("not placed").groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id")).alias(gone)))
    joined = docs.join(small_side(drops), "doc_id", "left").select(*docs.columns, gone)
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, at):
                texts = []
                for text, drop in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    out = {(d["line_no"], d["id"] & 0xFFFFFFFFFFFFFFFF) for d in drop}
                    at_all = {line_no for line_no, _ in out}
                    texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in at_all or (i, name_of(trimmed(x))) not in out))
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    shorter = joined.filter(F.col(gone).isNotNull() & F.col("text").isNotNull()).mapInArrow(cut, docs.schema).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    if "n_chars" in names:
        shorter = shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return joined.filter(F.col(gone).isNull() | F.col("text").isNull()).select(names).unionByName(shorter)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of near-equal lines of all ``documents``."""
    return line_classes(table(spark, sf_dir, "documents"))
