"""Best-fit packing with large-item matching.

Pieces above a third of the capacity are matched greedily, at most two to a sequence; smaller ones go, longest first,
into the smallest gap that takes them. The plan is made on the histogram of lengths (no more rows than the capacity),
as ranges of equal pieces that go to ranges of equal sequences; then every piece is placed by its number among the
pieces of its length.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, numbered, release, slices, stage, table

#: Printable ASCII and the letters of Latin-1, which the tokenizer's normal form leaves as they are but for the case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the tokenizer parts a lower-case chunk of those; every part is one word of its model.
PART = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Chunks of letters alone, which are one word each.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: So many words are remembered, and so many bytes of texts are tokenized at once.
MOST_WORDS, SLICE_BYTES = 50_000, 4_000_000


def packed_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Words(dict):
    """Lower-case plain word to token ids, as bytes of 32-bit integers; none is added beyond a bounded size, as common words come early."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = model
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: bytes_of.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}

    def __missing__(self, word: str) -> bytes:
        ids = packed_ids([t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
        if len(word) < 64 and len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class Slice(dict):
    """The words of one slice, each of which is looked up once; no more than the slice holds."""

    def __init__(self, words: Words):
        self.words = words

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.words[word]
        return ids


class Chunks:
    """Token ids of texts, by way of the chunks between white space, which the tokenizer drops."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)

    def chunk(self, chunk: str, words: dict | None = None) -> bytes:
        """The ids of a text without white space. What is not plain, or may hold a special token, goes to the tokenizer."""
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            return packed_ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        words = self.words if words is None else words
        lower = chunk.lower()
        if lower.isalpha():
            return words[lower]
        return b"".join([words[w] for w in PART.findall(lower)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, each text closed by id 0; and the number of ids of each."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        chunks, words = coded.dictionary, Slice(self.words)
        alone = pc.match_substring_regex(chunks, LETTERS)
        found = np.empty(len(chunks) + 1, object)
        found[:-1][alone.to_numpy(zero_copy_only=False)] = list(map(words.__getitem__, pc.utf8_lower(chunks.filter(alone)).to_pylist()))
        found[:-1][~alone.to_numpy(zero_copy_only=False)] = [self.chunk(c, words) for c in chunks.filter(pc.invert(alone)).to_pylist()]
        found[-1] = packed_ids([0])  # closes a text
        stops = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False), stops, len(chunks))
        every = np.frombuffer(b"".join(found[code].tolist()), np.uint32)
        ends = np.cumsum((np.fromiter(map(len, found), np.int64, len(found)) // 4)[code])
        return every.astype("<u4", copy=False), np.diff(ends[stops + np.arange(len(stops))], prepend=0)


def pieces(docs: DataFrame, capacity: int, path: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and then id 0, cut only where longer than ``capacity``.

    ids are little-endian unsigned 32-bit integers. Whole texts are tokenized, about ``slice_bytes`` of them at once; null texts are empty.
    """

    def run(batches):
        import public_tokenizers

        release()  # what earlier stages left in this worker
        known = Chunks(path or public_tokenizers.path("word_bpe_49k.json"))
        release()  # what reading the model took
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                yield cut(part.column(0).to_numpy(zero_copy_only=False), *known.ids(part.column(1)))
            if slice_bytes < SLICE_BYTES:
                release()
        del known
        release()

    def cut(doc_id, ids, sizes):
        count = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, sizes[row] - start)
        offsets = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        columns = [pa.array(doc_id, pa.int64(), from_pandas=True).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), held]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rules (length, first, sequence, each, offset) and the number of sequences.

    From its number ``first`` on, ``each`` pieces of a length go to each of the sequences from ``sequence`` on, the
    first of them at ``offset``, until the next rule of that length.
    """
    left, used, rules, end = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rules.append((length, used[length], sequence, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            fit = next((x for x in large if x <= min(length, capacity - length) and (left[x] > 1 if x == length else left[x])), None)
            n = left[length] if fit is None else left[length] // 2 if fit == length else min(left[length], left[fit])
            put(length, n, end, 1, 0)
            if fit is not None:
                put(fit, n, end, 1, length)
            gaps[capacity - length - (fit or 0)].append((end, n))
            end += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for gap in range(length, capacity + 1):
            if not left[length]:
                break
            if gap == capacity:
                gaps[gap].append((end, -(-left[length] // (capacity // length))))
                end += gaps[gap][-1][1]
            each, groups = gap // length, gaps.pop(gap, [])
            while groups and left[length]:
                sequence, n = groups.pop()
                whole = min(n, left[length] // each)
                if whole:
                    put(length, whole * each, sequence, each, capacity - gap)
                    gaps[gap - each * length].append((sequence, whole))
                if whole < n and 0 < (rest := left[length]):
                    put(length, rest, sequence + whole, rest, capacity - gap)
                    gaps[gap - rest * length].append((sequence + whole, 1))
                    whole += 1
                if whole < n:
                    groups.append((sequence + whole, n - whole))
            gaps[gap] += groups
    return rules, end


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` (doc_id, piece, length, any others) with sequence_id and offset; length is from 1 to ``capacity``.

    Offsets of a sequence are gapless from 0. Only the histogram of lengths, ``capacity`` rows at most, reaches the
    driver. The plan's size is bounded by the capacity likewise.
    """
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules = sorted(plan(counts, capacity)[0])
    length, first, sequence, each, offset = (np.array([r[i] for r in rules], np.int64) for i in range(5))
    starts = {int(x): (int(np.searchsorted(length, x)), int(np.searchsorted(length, x, "right"))) for x in counts}
    ranked = numbered(rows, ["length"], ["doc_id", "piece"], "number")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def place(batches):
        for batch in batches:
            size, number = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "number"))
            at = np.empty(len(size), np.int64)
            for x in np.unique(size):
                lo, hi = starts[int(x)]
                here = size == x
                at[here] = lo + np.searchsorted(first[lo:hi], number[here], "right") - 1
            step = number - first[at]
            where = [pa.array(sequence[at] + step // each[at]), pa.array(offset[at] + step % each[at] * size)]
            keep = [batch.column(batch.schema.get_field_index(f)) for f in names]
            yield pa.RecordBatch.from_arrays([*keep, *where], names=[*names, "sequence_id", "offset"])

    names = rows.columns
    return ranked.select(*names, "number").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, slice_bytes: int = SLICE_BYTES, batch_rows: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text).

    Documents are token ids and then id 0; only longer ones than ``capacity`` are cut, into pieces of that length and a
    rest. Null and empty texts have one piece of one id. Repeated rows are packed each. Other columns are ignored. An
    empty table gives an empty result. Where memory is short, fewer bytes of texts at once (``slice_bytes``) and fewer rows
    handed to a worker at once (``batch_rows``) take more time and give the same rows.
    """
    cut = pieces(docs, capacity, path, slice_bytes).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    with arrow_rows(docs.sparkSession, batch_rows):
        written = stage(cut)
    return pack(written, capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


