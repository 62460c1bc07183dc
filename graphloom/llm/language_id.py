"""Language identification by a bit-sliced Bloom filter of character n-grams.

Position by position the filter holds a bitmask of languages, so that a few reads give the languages that contain an
n-gram. A language contains an n-gram if at least two of its training documents (one of up to two) do, at a rate not far below the rate of
the language where it is most usual; passages in foreign languages thus don't spread n-grams over all of them. The
n-grams of a text are counted by language (popcounts); from each count goes what the filter finds there by chance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, small_side, stage, table

U = np.uint64
#: Lengths of n-grams. A word has a mark at either end, so that words of up to three letters are n-grams themselves.
SIZES = (3, 4, 5)


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """By code point: 0 if it is no letter, else its lower-case letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of whole texts one after the other, each word between single zeros, and the number of the text of each."""
    strings = pc.fill_null(texts.cast(pa.string()), "").to_pylist()
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    codes = folding()[np.frombuffer(("\n".join(strings) + "\n").encode("utf-32-le"), np.uint32)]
    keep = codes != 0
    keep[1:] |= keep[:-1]  # one zero after each word
    row = np.repeat(np.arange(len(strings)), size)[keep]
    codes = codes[keep]
    # the zero before a text's first word is that of the word before it, or this one
    return np.concatenate([np.zeros(1, np.uint32), codes]), np.concatenate([row[:1], row])


def grams(codes: np.ndarray, row: np.ndarray):
    """(hash, text) of the n-grams of each size: within a word, with its marks."""
    if len(codes) < min(SIZES):
        return
    with np.errstate(over="ignore"):
        wide = codes.astype(U)
        state = wide[:-1] * U(0x9E3779B97F4A7C15) + wide[1:]
        inside = np.ones(len(state), bool)  # no mark but at the ends
        for n in range(3, max(SIZES) + 1):
            state = mixed(state[:-1]) * U(0x9E3779B97F4A7C15) + wide[n - 1 :]
            inside = inside[:-1] & (codes[n - 2 : len(codes) - 1] != 0)
            if n in SIZES:
                yield mixed(state[inside]), row[n - 1 :][inside]


def training_rows(docs: DataFrame, folds: int, most: int) -> DataFrame:
    """Labelled rows of ``docs`` outside of the held-out fold: all of a language, or about ``most`` chosen by a hash of doc_id."""
    marked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    seen = marked.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", folds))
    counts = seen.groupBy("lang").agg(F.count("*").alias("of"))
    limit = F.least(F.lit(1.0), F.lit(float(most)) / F.col("of")) * (1 << 30)
    return seen.join(small_side(counts), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < limit).select("text", "lang")


def held_out(doc_id: str, folds: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def gram_counts(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(gram, lang, n): in how many of the rows (text, lang) of a language an n-gram occurs; added up before they are shuffled."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        total = 0

        def flush():
            for lang, lists in held.items():
                gram, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array([lang] * len(gram)), pa.array(n)], names=["gram", "lang", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, 0, 500_000):
                langs = part.column(1).to_pylist()
                codes, row = letters_of(part.column(0))
                every = list(grams(codes, row))
                if not every:
                    continue
                gram, text = (np.concatenate(x) for x in zip(*every, strict=True))
                order = np.lexsort((gram, text))
                gram, text = gram[order], text[order]
                once = np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])]) if len(gram) else np.empty(0, bool)
                gram, text = gram[once], text[once]
                for i, lang in enumerate(langs):
                    lo, hi = np.searchsorted(text, [i, i + 1])
                    held.setdefault(lang, []).append(gram[lo:hi])
                total += len(gram)
                if total > most:
                    total = 0
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


class Filter:
    """A bit-sliced Bloom filter: ``bits[i]`` has, for each position, the bits of languages 8 i to 8 i + 7."""

    def __init__(self, langs: list[str], bits: np.ndarray, hashes: int):
        self.langs, self.bits, self.hashes = langs, bits, hashes
        full = np.unpackbits(bits, axis=0, bitorder="little")[: len(langs)].mean(axis=1) if len(langs) else np.empty(0)
        self.chance = full**hashes  # that it finds a language that does not contain the n-gram
        self.ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """For each byte of languages the mask of those that contain each n-gram."""
        at = [positions(gram, k, self.bits.shape[1]) for k in range(self.hashes)]
        return [np.bitwise_and.reduce([part[x] for x in at]) for part in self.bits]

    def popcounts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of n-grams of each text, and of those each language contains."""
        n = len(texts)
        total, found = np.zeros(n, np.int64), np.zeros((n, 8 * len(self.bits)), np.int64)
        for gram, row in grams(*letters_of(texts)):
            total += np.bincount(row, minlength=n)
            for i, mask in enumerate(self.masks(gram)):
                found[:, 8 * i : 8 * i + 8] += np.bincount(row * 256 + mask, minlength=256 * n).reshape(n, 256) @ self.ones
        return total, found[:, : len(self.langs)]

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its corrected share of the text's n-grams."""
        total, found = self.popcounts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        share = np.clip((found / np.maximum(total, 1)[:, None] - self.chance) / (1 - np.minimum(self.chance, 0.999)), 0, 1)
        best = share.argmax(axis=1)
        langs = [self.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return langs, np.where(total > 0, share[np.arange(len(best)), best], 0.0)


def positions(gram: np.ndarray, k: int, size: int) -> np.ndarray:
    """The ``k``-th position of each n-gram; ``size`` is a power of two."""
    with np.errstate(over="ignore"):
        return (mixed(gram + U(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) & U(size - 1)).astype(np.int64)


def train(rows: DataFrame, size: int = 1 << 22, hashes: int = 3, least: int = 2, ratio: float = 0.25) -> Filter:
    """A filter from ``rows`` (text, lang). The driver gets one row for each position that is set, ``size`` at most, and
    one for each language."""
    counted = stage(rows.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang"))
    langs = sorted(((r["lang"], r["docs"]) for r in counted.collect()), key=lambda r: (-r[1], r[0]))
    names = [r[0] for r in langs]  # the most usual language first: it wins ties
    depth = max(1, -(-len(names) // 8))
    bits = np.zeros((depth, size), np.uint8)
    if names:
        place = F.broadcast(rows.sparkSession.createDataFrame([(a, i, float(n)) for i, (a, n) in enumerate(langs)], "lang string, at int, docs double"))
        rate = F.col("n") / F.col("docs")
        by = gram_counts(rows).join(place, "lang").select("gram", "at", F.least(F.lit(least), F.ceil(F.col("docs") / 2)).alias("least"), "n", rate.alias("rate"))
        held = by.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("at", "least", "n", "rate")).alias("langs"))
        known = held.select("gram", F.explode(F.filter("langs", lambda x: (x.n >= x.least) & (x.rate >= ratio * F.col("top")))).alias("x")).select("gram", "x.at")

        def spots(batches):
            for batch in batches:
                gram, at = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy()
                for k in range(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(at // 8, pa.int32()), pa.array(positions(gram, k, size)), pa.array(1 << at % 8, pa.int32())], names=["part", "at", "bit"])

        marks = known.mapInArrow(spots, "part int, at long, bit int").groupBy("part", "at").agg(F.bit_or("bit").alias("bits"))
        found = marks.toArrow()
        part, at, value = (found.column(i).to_numpy() for i in range(3))
        bits[part, at] = value.astype(np.uint8)
    return Filter(names, bits, hashes)


def predict(docs: DataFrame, model: Filter, folds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of ``docs`` (doc_id, text), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 250_000):
                langs, score = shared.value.judge(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    kept = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", folds).alias("held_out"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 5, most: int = 2_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    held_out: crc32 of doc_id as text is a multiple of ``folds``; such rows and rows without lang or text are never learnt
    from. Of the others the filter is fitted on all of a language, or on a sample of about ``most`` of its documents.
    lang_pred is a learnt value of lang, "und" for a text that is null or has no letter (and for every text if there is
    nothing to learn from). score: the share of the text's n-grams that the language contains, corrected for false
    positives. Ties, and texts of which nothing is known, go to the language with most training documents. Rows without a
    doc_id are not held out; repeated rows are judged each; other columns are ignored. An empty table gives an empty
    result.
    """
    return predict(docs, train(stage(training_rows(docs, folds, most))), folds)


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    return identify_languages(table(spark, sf_dir, "documents"))
