"""Registered queries on given tables, edge cases of every operator, and the pipeline's stages."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import audio_fingerprint, chat_format, decontaminate, line_dedup, ngram_jaccard, packing, registry, secret_scan, sharding, toxicity, url_filter

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard": {"doc_id", "n_shingles", "component_id"}, "op5_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op7_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    want = duck.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, DIR).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame(want.fetchall(), got.schema).collect())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs_over_its_whole_table(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    assert set(got.columns) >= COLUMNS.get(name, set())
    rows = got.count()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    if name in ("op2_toxicity", "op7_secret_scan", "op8_sharding"):
        assert rows == docs
    elif name in ("op3_audio_fingerprint", "op6_url_filter"):
        assert rows == spark.read.parquet(f"{DIR}/{'embeddings' if name[2] == '3' else 'pages'}.parquet").count()
    elif name == "op10_packing":
        assert rows >= docs
    else:
        assert rows > 0


def tokens(text):
    return [t for t in regex.split(r"[^\p{L}\p{Nd}]+", regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "").lower()) if t]


def test_leaks_against_brute_force(spark):
    """All documents of the given table against all benchmark items, word for word."""
    docs, bench = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = {r.item_id: tokens(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        have = tokens(r.text)
        windows = Counter(tuple(have[i : i + 8]) for i in range(len(have) - 7))
        for item, own in items.items():
            n = len(own) - 7
            if n > 0 and sum(tuple(own[i : i + 8]) in windows for i in range(n)) >= min(6, -(-n // 2)):
                want.add((r.doc_id, item))
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want


def test_leaks_in_other_case_with_names_and_edges(spark):
    item = "If Anna Miller drives 120 km from Lyon to Geneva in 3 hours, how fast does Anna Miller drive on that road to Geneva?"
    long = "word " * 100_000 + item
    docs = spark.createDataFrame([(1, item.upper(), 0), (2, item.lower(), 0), (3, long, 0), (3, long, 0), (4, None, 0), (5, "", 0), (None, item, 0)], "doc_id long, text string, pos int")
    bench = spark.createDataFrame([(9, item, 1), (9, item, 1), (10, None, 1)], "item_id long, text string, width int")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert sorted(got) == [(1, 9), (2, 9), (3, 9)]
    assert decontaminate.find_leaks(docs.filter("false"), bench).count() == decontaminate.find_leaks(docs, bench.filter("false")).count() == 0
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns and {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {4, 5, None}


def test_jaccard_of_repeated_rows_and_long_texts(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 60_000))
    rows = [(5, long, 1), (3, long + " tail", 1), (7, "a b c d e f", 1), (7, "a b c d e f", 1), (8, "A B C D E F", 1), (9, None, 1), (None, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch int")
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_classes(docs).collect())
    assert got == [(3, 3), (5, 3), (7, 7), (7, 7), (8, 7), (9, 9)]
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]


def test_links_of_a_large_group_in_many_slices(spark, monkeypatch):
    """Copies and near copies over many small groups of keys, so that leads, tails and renamed ids all occur."""
    made = ngram_jaccard.features
    monkeypatch.setattr(ngram_jaccard, "features", lambda d, w, p: made(d, w, p, most=300))
    words = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(words if i % 3 else [*words[:-1], f"x{i % 7}"])) for i in range(120)] + [(500 + i, f"other text number {i} of its own {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(docs, 3, 90).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[500 + i] == 500 + i for i in range(40))


def test_lines_of_repeated_rows(spark):
    line = "the same line of some length in every row of it"
    rows = [(1, f"{line}\nfirst row of the document with a line of its own", "a"), (1, line, "b"), (2, line, "c"), (3, f"{line}\n{line}!", "d"), (3, f"{line}\n{line}!", "d"), (4, None, "e"), (None, line, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _drops string").withColumn("n_chars", F.length("text"))
    classes = line_dedup.line_classes(docs).collect()
    by = defaultdict(list)
    for r in classes:
        by[r.class_id].append(r)
    assert sorted(len(v) for v in by.values()) == [1, 7] and all(sum(r.kept for r in v) == 1 and {r.class_lines for r in v} == {len(v)} for v in by.values())
    cut = line_dedup.drop_duplicate_lines(docs)
    assert cut.columns == docs.columns
    left = sorted((str(r.doc_id), r.text, r.n_chars) for r in cut.collect())
    assert left == sorted([("1", rows[0][1], len(rows[0][1])), ("1", line, len(line)), ("4", None, None), ("None", line, len(line))])
    long = "\n".join(f"line number {i} of a very long document {i * 7919 % 10007}" for i in range(20_000))
    assert line_dedup.line_classes(spark.createDataFrame([(1, long)], "doc_id long, text string")).count() == 20_000


def test_names_of_lines_are_sparks_hash(spark):
    lines = ["", "a", "ünïcode 你好 😀", "x" * 1000]
    got = [r[0] & 0xFFFFFFFFFFFFFFFF for r in spark.createDataFrame([(x,) for x in lines], "t string").select(F.xxhash64("t")).collect()]
    assert got == [line_dedup.name_of(x) for x in lines]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "good words here " + ("vile scum" if i % 4 == 0 else "and there"), 1, 2.0) for i in range(80)] + [(80, None, 1, 2.0), (81, "vile scum " * 50_000, 1, 2.0)], "doc_id long, text string, toxic int, severity double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(80)) and not got[80] and got[81]
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in range(81) if i % 4 or i == 80}
    assert toxicity.score(docs.filter("false"), model).count() == 0 and toxicity.drop_toxic(docs, labels.filter("false")).count() == 82
    assert toxicity.train(docs.filter("false"), labels) is None


def test_toxicity_recall_on_held_out_labels(spark):
    """Fitted on the even half of the labels of a tenth, measured on the odd half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    held = docs.join(F.broadcast(labels.filter("doc_id % 2 = 1")), "doc_id")
    told = toxicity.score(held, model).join(labels, "doc_id")
    n = told.agg(*(F.count_if(F.expr(c)).alias(a) for a, c in (("bad", "toxic = 1"), ("hit", "toxic = 1 and is_toxic"), ("good", "toxic = 0"), ("wrong", "toxic = 0 and is_toxic")))).first()
    assert n.hit >= 0.9 * n.bad and n.wrong <= 0.01 * n.good


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 1), (1, 0, "user", "x", 1), (1, 0, "user", "x", 1), (1, 1, "assistant", None, 1), (2, None, None, "</s>" * 20_000, 1)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 1), 1: (3, 0), 2: (1, 0)}
    assert chat_format.read_back(chat_format.format_chats(chats.filter("false"))).count() == 0


def test_shards_and_packing_edges(spark):
    rows = [(1, "x y z", 7), (1, "x y z", 7), (2, None, 7), (3, "", 7), (4, "long words " * 30_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumn("_part", F.lit(1)).withColumn("sequence_id", F.lit(2))
    shards = sharding.shard_documents(docs, 3).collect()
    assert Counter(r.doc_id for r in shards) == {1: 2, 2: 1, 3: 1, 4: 1} and len({r.shard for r in shards if r.doc_id in (2, 3)}) == 1
    pieces = packing.pack_documents(docs, 64).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4} and sum(r.length for r in pieces if r.doc_id == 4) == 60_001 and [r.length for r in pieces if r.doc_id in (2, 3)] == [1, 1]
    assert not {c for c, n in Counter((r.sequence_id, r.offset) for r in pieces).items() if n > 1}


def test_audio_ties_and_empty_tables(spark):
    tone = (np.sin(np.arange(60_000) * 0.5) * 9000).astype(np.int16)
    rows = [(100, bytearray(tone.tobytes()), 1), (1, bytearray(tone[:50_000].tobytes()), 1), (2, bytearray(tone.tobytes()), 1), (3, None, 1), (None, bytearray(tone.tobytes()), 1)]
    sounds = spark.createDataFrame(rows, "rec_id long, sound binary, codes int")
    got = {r.rec_id: r for r in audio_fingerprint.match_recordings(sounds).collect()}
    assert got[100].class_id == got[2].class_id == 2 and got[1].matches.startswith("2:") and got[3].n_codes == 0 and len(got) == 4
    assert audio_fingerprint.match_recordings(sounds.filter("false")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, lines that repeat, near copies, and one that holds a benchmark item."""
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeio" for c in "nrstlm"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    item = say(30)
    shared = say(14)
    rows = [(i, say(80) + (" vile scum" if i % 10 == 0 else "") + f"\n{say(12)}", "en", "s", 0) for i in range(60)]
    rows[5], rows[7] = (5, f"{rows[5][1]}\n{shared}", "en", "s", 0), (7, f"{rows[7][1]}\n{shared}", "en", "s", 0)
    head, tail = rows[11][1].split("\n")
    rows.append((70, f"{head} changed\n{tail}x y", "en", "s", 0))
    rows += [(71, f"{say(30)} {item} {say(30)}", "en", "s", 0), (72, None, "en", "s", 0), (73, "", "en", "s", 0)]
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, shared


def test_pipeline_stages_one_by_one(spark, corpus):
    folder, texts, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            docs = corpus_pipeline.stage(out)
            held[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            packed = out.collect()
    everything = {k: v for k, v in texts.items()}
    assert set(held["toxicity"]) == {k for k in everything if not (k < 60 and k % 10 == 0)} and all(held["toxicity"][k] == everything[k] for k in held["toxicity"])
    lines = held["line_dedup"]
    assert set(lines) == set(held["toxicity"]) and shared in lines[5] and shared not in lines[7] and lines[72] is None
    assert set(held["near_duplicates"]) == set(lines) - {70}
    assert set(held["decontamination"]) == set(held["near_duplicates"]) - {71}
    assert {r.doc_id for r in packed} == set(held["decontamination"])
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_pipeline_runs_as_one(spark, corpus):
    folder, texts, _ = corpus
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {k for k in texts if not (k < 60 and k % 10 == 0)} - {70, 71}


def test_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert ngram_jaccard.keep_one(docs).count() == line_dedup.drop_duplicate_lines(docs).count() == secret_scan.scan_secrets(docs).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
