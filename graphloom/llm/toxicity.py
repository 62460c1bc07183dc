"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all ordered thresholds t_k. Features are the words of a
text and their leading characters, each at a few levels of how often it occurs; those that speak for the toxic label are chosen by a test whose
level follows from the sample, whatever its size. Labels only say toxic or not. Grade 0 is clean; toxic rows of one half
of the sample get grade 2 or 1 as they show more or fewer than the median of the features that the other half chose.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release, slices, stage, table

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the leading parts of words that are features.
PREFIXES = (3, 4, 5, 6, 7)


#: Occurrences in a text from which a feature counts at its next level.
LEVELS = (2, 3, 5)


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Known(dict):
    """Word to its features, only those of ``wanted`` if given; forgets everything at a bounded size."""

    def __init__(self, wanted=None):
        self.wanted = None if wanted is None else {f.partition("#")[0] for f in wanted}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 50_000:
            self.clear()
        self[word] = found = tuple(f for f in word_features(word) if self.wanted is None or f in self.wanted)
        return found


def features_of(text: str | None, known: Known) -> list[str]:
    """The features of a whole text, each once, with ``#n`` for the level of n occurrences."""
    found: dict[str, int] = {}
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in known[word]:
            found[f] = found.get(f, 0) + n
    return [*found, *(f"{f}#{level}" for f, n in found.items() if n > 1 for level in LEVELS if n >= level)]


@dataclass
class OrdinalModel:
    """Weights by feature, and ascending thresholds between the grades 0, 1, 2 ..."""

    weights: dict[str, float]
    thresholds: list[float]

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -60, 60)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, width: int, levels: int, penalty: float = 0.0001, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by full-batch Adam on the mean likelihood of the thresholds' binary splits.

    The rows' features are given sparsely: ``row`` and ``feature`` of each that is present.
    """
    w, cuts, n = np.zeros(width), np.linspace(1.0, 2.0, levels - 1), len(grade)
    target = (grade[:, None] > np.arange(levels - 1)[None, :]).astype(float)
    m, v = np.zeros(width + len(cuts)), np.zeros(width + len(cuts))
    for step in range(1, steps + 1):
        score = np.bincount(row, w[feature], n)
        off = (1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -60, 60))) - target) / n
        grad = np.concatenate([np.bincount(feature, off.sum(axis=1)[row], width) + penalty * w, -off.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, cuts = w - move[:width], np.sort(cuts - move[width:])
    return w, cuts


def spoken(counts: list[tuple[str, int, int]], bad: int, good: int, tests: int, level: float) -> list[str]:
    """Of (feature, toxic rows, rows) those that speak for the label: the largest set of the smallest p-values of a
    signed chi-square test whose share of chance finds among ``tests`` is expected to be at most ``level``."""
    found = []
    for name, a, n in counts:
        b, c, d = n - a, bad - a, good - (n - a)
        if a > 1 and a * d > b * c:
            chi = (a * d - b * c) ** 2 * (bad + good) / ((a + b) * (c + d) * bad * good)
            found.append((math.erfc(math.sqrt(chi / 2)) / 2, name))
    found.sort()
    last = max((i for i, (p, _) in enumerate(found, 1) if p <= level * i / tests), default=0)
    return [name for _, name in found[:last]]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, level: float = 0.05) -> OrdinalModel | None:
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of doc_id; None if one label is missing.

    ``labels`` has doc_id and toxic (0 or 1); rows that share a doc_id count as toxic if one of them does; nulls are
    left out. Features are counted by Spark over the sample. Only those that more of its toxic rows have than chance
    would give reach the driver, and only their presence in the sample's rows is fitted; both are bounded by ``max_rows``.
    """
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = told.orderBy(F.xxhash64("doc_id")).limit(max_rows)
    half = F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(2)).cast("int").alias("half")
    sample = stage(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", half))

    def counted(batches):
        known = Known()
        for batch in batches:
            for part in slices(batch, 0, 1_000_000):
                counts: dict[str, list[int]] = {}
                for text, toxic, side in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    for f in features_of(text, known):
                        held = counts.setdefault(f, [0, 0, 0, 0])
                        held[2 * side] += toxic
                        held[2 * side + 1] += 1
                columns = [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *columns], names=["feature", "t0", "n0", "t1", "n1"])

    totals = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    sums = [(totals.get((h, 1), 0), totals.get((h, 0), 0)) for h in (0, 1)]
    bad, good = (sum(x) for x in zip(*sums, strict=True))
    if not bad or not good:
        return None
    kinds = ("t0", "n0", "t1", "n1")
    count = stage(sample.select("text", "toxic", "half").mapInArrow(counted, "feature string, " + ", ".join(f"{k} long" for k in kinds)).groupBy("feature").agg(*(F.sum(k).alias(k) for k in kinds)))
    tests = count.count()
    rows = [tuple(r) for r in count.filter("t0 + t1 > 1").filter(F.expr("t0 + t1") * good > F.expr("n0 + n1 - t0 - t1") * bad).collect()]
    top = spoken([(f, t0 + t1, n0 + n1) for f, t0, n0, t1, n1 in rows], bad, good, tests, level)
    if not top:
        return OrdinalModel({}, [1.0, 2.0])
    at = {f: i for i, f in enumerate(top)}

    def present(batches):
        known = Known(at)
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                hits = [sorted(at[f] for f in features_of(text, known) if f in at) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "toxic", "half", "at"])

    held = sample.mapInArrow(present, "doc_id long, toxic int, half int, at array<int>").orderBy("doc_id").collect()
    grade = np.array([r["toxic"] for r in held])
    for h in (0, 1):
        (t, g), column = sums[1 - h], 1 + 2 * (1 - h)
        others = {at[f] for f in spoken([(r[0], r[column], r[column + 1]) for r in rows], t, g, tests, level) if f in at} if t and g else set()
        shown = {i: sum(f in others for f in r["at"]) for i, r in enumerate(held) if r["toxic"] and r["half"] == h}
        middle = np.median([n for n in shown.values() if n] or [0])
        for i, n in shown.items():
            grade[i] += n > middle
    row = np.repeat(np.arange(len(held)), [len(r["at"]) for r in held])
    feature = np.array([i for r in held for i in r["at"]], np.int64)
    w, cuts = fit_ordinal(row, feature, grade, len(top), 3)
    return OrdinalModel({f: float(v) for f, v in zip(top, w, strict=True) if v}, [float(c) for c in cuts])


def scores(texts: list[str | None], model: OrdinalModel, known: Known) -> np.ndarray:
    """P(grade > k) for each text and threshold."""
    total = []
    for text in texts:
        total.append(math.fsum(model.weights.get(f, 0.0) for f in features_of(text, known)))
    return model.grades(np.array(total, float))


def score(docs: DataFrame, model: OrdinalModel | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade, rounded to 6 places), p_toxic (of grade 1 or above, likewise), is_toxic.

    Whole texts are scored. Null and empty texts get the score of no feature. Without a model all are 0 and clean.
    Repeated rows are scored each; other columns are ignored.
    """

    def run(batches):
        known = Known(model.weights)
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                p = scores(part.column(1).to_pylist(), model, known)
                first = np.round(p[:, 0], 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(p.sum(axis=1), 6)), pa.array(first), pa.array(first >= threshold)], names=["doc_id", "severity", "p_toxic", "is_toxic"])

    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("is_toxic"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, is_toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; columns as they were. Every row is scored by itself, where
    it is read, so that nothing is shuffled. Without a model all stay."""
    model, at = train(docs, labels), docs.columns.index("text")
    if model is None:
        return docs

    def run(batches):
        known = Known(model.weights)
        for batch in batches:
            for part in slices(batch, at, 1_000_000):
                yield part.filter(pa.array(np.round(scores(part.column(at).to_pylist(), model, known)[:, 0], 6) < threshold))
        del known
        release()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all ``documents``, trained on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
