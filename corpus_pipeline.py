"""Corpus pipeline: stages over documents, each writing Parquet that the next reads."""

from __future__ import annotations

from graphloom.llm import decontaminate, line_dedup, ngram_jaccard, packing, toxicity
from graphloom.llm.common import stage, table


def without_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_duplicate_lines(spark, docs, sf_dir):
    return line_dedup.drop_duplicate_lines(docs)


def without_near_duplicates(spark, docs, sf_dir):
    return ngram_jaccard.keep_one(docs, width=5, percent=80)


def without_benchmark(spark, docs, sf_dir):
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """In small portions, as the executors still hold what the stages before have grown to."""
    return packing.pack_documents(docs, slice_bytes=1_000_000, batch_rows=500)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_duplicate_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained, hashed and tokenized stages are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
