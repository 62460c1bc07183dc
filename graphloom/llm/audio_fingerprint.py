"""Chroma audio fingerprints as media columns.

A recording's spectrum is folded to twelve pitch classes per frame. Sixteen filters, rectangles of an integral image
over the frames, give two bits each, packed to one 32-bit integer a frame. Recordings are aligned by the histogram of
offsets at which the filters' signs agree in two integers a little apart, and judged by the bit errors at every such
offset. A query is read at four starts within a frame's step, so that it meets a recording that begins anywhere.

The tables hold no sound, so the query renders each embedding to a recording: one note a dimension.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stage, table

RATE, FRAME, HOP = 5512, 2048, 1024
#: Starts of a query within a step, in samples; and the loudness (of 32,767) under which a frame is silent.
STARTS, SILENCE = (0, 256, 512, 768), 8.0
#: Cuts between the two-bit levels of a filter's log ratio; neighbouring levels differ in one bit.
CUTS, GRAY = (-0.12, 0.0, 0.12), np.array([0, 1, 3, 2], np.uint64)
NOTE_SECONDS = 0.2
#: The bits of an integer that say which half of a filter is the louder, and how far apart the two of a key are.
SIGNS, APART = 0xAAAAAAAA, 4


@lru_cache(maxsize=1)
def pitches() -> tuple[np.ndarray, np.ndarray]:
    """Which bins of a spectrum count, and the pitch class of each as a matrix."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hertz > 100) & (hertz < 2600)
    pitch = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12
    fold = np.zeros((int(use.sum()), 12))
    fold[np.arange(len(pitch)), pitch] = 1
    return use, fold


def chroma(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From recordings of one length (a row each) their frames by 12 pitch classes, smoothed over time and scaled to
    unit sum, and which frames are silent."""
    window = np.hanning(FRAME).astype(np.float32)
    wave = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP] * window, axis=2)
    power = wave.real**2 + wave.imag**2
    silent = power.sum(axis=2) < SILENCE**2 * FRAME / 2 * float((window**2).sum())
    use, fold = pitches()
    image = (power[:, :, use] @ fold.astype(np.float32)).astype(float)
    padded = np.pad(image, ((0, 0), (1, 1), (0, 0)), mode="edge")
    image = padded[:, :-2] * 0.5 + padded[:, 1:-1] + padded[:, 2:] * 0.5
    return image / np.maximum(image.sum(axis=2, keepdims=True), 1e-9), silent


def filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch, height and width of each filter, by rule: every kind at four heights and widths."""
    return [(f % 4, 5 * f % 12, 2 * (1 + f // 4), 2 + 2 * (f // 4)) for f in range(16)]


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """One 32-bit integer a frame for recordings of one length (a row each), -1 where all frames below a filter are
    silent; none if the recordings are shorter than the widest filter."""
    bank = filters()
    wide = max(b[3] for b in bank)
    n = (pcm.shape[1] - FRAME) // HOP + 2 - wide
    if n < 1:
        return np.empty((len(pcm), 0), np.int64)
    image, silent = chroma(pcm)
    # pitch wraps around, so the image is laid twice side by side
    total = np.zeros((len(pcm), image.shape[1] + 1, 25))
    total[:, 1:, 1:] = np.cumsum(np.cumsum(np.concatenate([image, image], axis=2), axis=1), axis=2)
    at = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[:, at + t1, p1] - total[:, at + t0, p1] - total[:, at + t1, p0] + total[:, at + t0, p0]

    out = np.zeros((len(pcm), n), np.uint64)
    for i, (kind, p, h, w) in enumerate(bank):
        ph, wh = p + h // 2, w // 2
        whole = box(0, w, p, p + h)
        if kind == 0:
            part = box(0, w, p, ph)
        elif kind == 1:
            part = box(0, wh, p, p + h)
        elif kind == 2:
            part = box(0, wh, p, ph) + box(wh, w, ph, p + h)
        else:
            part = box(w // 4, w - w // 4, p, p + h)
        level = np.digitize(np.log((part + 0.01) / (whole - part + 0.01)), CUTS)
        out |= GRAY[level] << np.uint64(2 * i)
    quiet = np.lib.stride_tricks.sliding_window_view(silent, wide, axis=1).all(axis=2)
    return np.where(quiet, -1, out.astype(np.int64))


@lru_cache(maxsize=1)
def notes() -> np.ndarray:
    """One note of each pitch class, with its octave."""
    turn = 2 * np.pi * (220 * 2 ** (np.arange(12) / 12))[:, None] * (np.arange(int(NOTE_SECONDS * RATE)) / RATE)[None, :]
    return np.sin(turn) + 0.4 * np.sin(2 * turn)


def render(vector: list[float] | None) -> np.ndarray:
    """A recording of a vector: a note and its octave for each dimension, pitch by value and loudness by size."""
    value = np.nan_to_num(np.array([0.0 if x is None else x for x in vector or ()], float), posinf=0, neginf=0)
    if not len(value):
        return np.empty(0, np.int16)
    wave = notes()[(np.floor(value * 60) % 12).astype(int)] * (0.4 + 0.6 * np.minimum(1, np.abs(value) * 5))[:, None]
    return np.round(wave.ravel() * 9000).astype(np.int16)


def sound_of(raw: bytes | None) -> np.ndarray:
    """16-bit mono samples, little-endian; a last odd byte says nothing."""
    return np.frombuffer((raw or b"")[: len(raw or b"") // 2 * 2], "<i2")


def fingerprints(recordings: DataFrame, read=sound_of, every: int = 100) -> DataFrame:
    """(rec_id, codes, starts) of (rec_id, sound), ``read`` giving the samples of a sound; recordings that are null,
    short or silent have no codes. ``starts`` has the codes from each of STARTS, for rec_ids divisible by ``every``."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 16):
                ids = batch.column(0).slice(first, 16).to_pylist()
                sounds = [read(x) for x in batch.column(1).slice(first, 16).to_pylist()]
                codes: list = [[] for _ in ids]
                starts: list = [None] * len(ids)
                by_length: dict[int, list[int]] = {}
                for i, x in enumerate(sounds):
                    by_length.setdefault(len(x), []).append(i)
                for length, rows in by_length.items():
                    if length < FRAME:
                        continue
                    for i, found in zip(rows, fingerprint(np.stack([sounds[i] for i in rows])), strict=True):
                        codes[i] = found if (found >= 0).any() else []
                    asked = [i for i in rows if ids[i] % every == 0 and len(codes[i])]
                    if asked:
                        held = np.stack([sounds[i] for i in asked])
                        for i, *found in zip(asked, *(fingerprint(held[:, s:]) for s in STARTS), strict=True):
                            starts[i] = found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.list_(pa.int64())))], names=["rec_id", "codes", "starts"])

    return recordings.select(F.col("rec_id").cast("long"), "sound").mapInArrow(run, "rec_id long, codes array<long>, starts array<array<long>>")


def heard(a: str, b: str, offset: str):
    """The differing bits of each two codes of a and b that meet where b starts ``offset`` frames before a; silence left out."""
    first_a, first_b = F.greatest(F.col(offset), F.lit(0)), F.greatest(-F.col(offset), F.lit(0))
    most = F.greatest(F.least(F.size(a) - first_a, F.size(b) - first_b), F.lit(0))
    pairs = F.zip_with(F.slice(a, first_a + 1, most), F.slice(b, first_b + 1, most), lambda x, y: F.when((x >= 0) & (y >= 0), F.bit_count(x.bitwiseXOR(y)).cast("long")))
    return F.filter(pairs, lambda x: x.isNotNull())


def align(queries: DataFrame, prints: DataFrame, max_error: float = 0.15, min_overlap: int = 20) -> DataFrame:
    """(query_id, rec_id, offset, start, votes, overlap, errors): recordings that hold the sound of a query.

    ``queries`` has (rec_id, starts), ``prints`` (rec_id, codes). A key is the signs of two codes APART frames from each
    other; equal keys vote for an offset (a key that lasts votes once, where it begins). Every offset with a vote is judged: a match has at
    most ``max_error`` of the bits of an overlap of at least ``min_overlap`` codes, or of all codes of the shorter
    recording. The offset of fewest errors is given, at ties the one of most votes, then the one nearest 0. Recordings of
    up to APART codes have no key and match only their copies.
    """

    def keyed(df: DataFrame, codes: str, *names: str) -> DataFrame:
        n = F.greatest(F.size(codes) - APART, F.lit(0))
        made = F.zip_with(F.slice(codes, 1, n), F.slice(codes, F.lit(1 + APART), n), lambda x, y: F.when((x >= 0) & (y >= 0), F.shiftleft(x.bitwiseAND(F.lit(SIGNS)), 31).bitwiseOR(F.shiftright(y.bitwiseAND(F.lit(SIGNS)), 1))))
        rows = df.select(*names, made.alias("keys"))
        runs = F.zip_with("keys", F.concat(F.array(F.lit(None).cast("long")), "keys"), lambda x, before: F.when(~x.eqNullSafe(before), x))
        return rows.select(*names, F.posexplode(runs).alias("pos", "key")).filter("key is not null")

    asked = queries.select(F.col("rec_id").alias("query_id"), F.posexplode("starts").alias("start", "qc"))
    left = keyed(asked, "qc", "query_id", "start").withColumnRenamed("pos", "q")
    right = keyed(prints, "codes", "rec_id").withColumnRenamed("pos", "r")
    votes = left.join(right, "key").filter("query_id <> rec_id").groupBy("query_id", "rec_id", "start", (F.col("q") - F.col("r")).alias("offset")).agg(F.count("*").alias("votes"))
    both = votes.join(asked, ["query_id", "start"]).join(prints.select("rec_id", F.col("codes").alias("rc")), "rec_id")
    told = both.withColumn("heard", heard("qc", "rc", "offset")).withColumn("overlap", F.size("heard")).withColumn("errors", F.aggregate("heard", F.lit(0).cast("long"), lambda s, x: s + x))
    enough = F.least(F.lit(min_overlap), F.size(F.filter("qc", lambda x: x >= 0)), F.size(F.filter("rc", lambda x: x >= 0)))
    held = told.filter((F.col("overlap") > 0) & (F.col("overlap") >= enough) & (F.col("errors") <= F.col("overlap") * 32 * max_error))
    order = F.struct(F.col("errors") / F.col("overlap"), -F.col("votes"), F.abs("offset"), "start", "offset")
    best = held.groupBy("query_id", "rec_id").agg(F.min(F.struct(order.alias("order"), F.struct("offset", "start", "votes", "overlap", "errors").alias("m"))).alias("b"))
    return best.select("query_id", "rec_id", "b.m.*")


def match_recordings(recordings: DataFrame, every: int = 100, read=sound_of) -> DataFrame:
    """One row per recording of (rec_id, sound): rec_id, class_id, n_codes, n_matches, matches.

    A class is the recordings of equal fingerprint, named by its smallest rec_id; those without codes (null, short or
    silent) stay alone. Queries are the classes that hold a rec_id divisible by ``every``, against all classes. matches lists
    ``class:offset:errors`` of the query classes that the row's class aligns with, by class. Rows with a null rec_id are
    left out; repeated rows are kept; other columns are ignored. An empty table gives an empty result.
    """
    prints = stage(fingerprints(recordings.filter("rec_id is not null"), read, every).withColumn("h", F.xxhash64("codes")).withColumn("g", F.xxhash64(F.lit(7), "codes")))
    classes = stage(prints.filter(F.size("codes") > 0).groupBy("h", "g").agg(F.min("rec_id").alias("class_id"), F.first("starts", ignorenulls=True).alias("starts"), F.first("codes").alias("codes")))
    sides = classes.select(F.col("class_id").alias("rec_id"), "codes", "starts")
    hits = align(sides.filter("starts is not null").drop("codes"), sides.drop("starts"))
    told = hits.groupBy(F.col("rec_id").alias("class_id")).agg(F.count("*").alias("n_matches"), F.sort_array(F.collect_list(F.struct("query_id", "offset", "errors"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["query_id"], x["offset"], x["errors"])), ",")
    named = classes.select("h", "g", "class_id").join(told.select("class_id", "n_matches", text.alias("matches")), "class_id", "left")
    out = prints.join(named, ["h", "g"], "left")
    return out.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.size("codes").cast("long").alias("n_codes"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("matches", F.lit("")).alias("matches"))


def op3_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Alignments among the recordings of all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("sound"))
    return match_recordings(vectors, read=render).withColumnRenamed("rec_id", "vec_id")
