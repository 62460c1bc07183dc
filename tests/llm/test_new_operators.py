"""Filter audit, spelling variants and language identification against brute force, and the mended cases of others."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import decontaminate, filter_audit, language_id, ngram_jaccard, secret_scan, spelling

DOCS = "doc_id long, text string, lang string, key string, n long"
LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """The filters that each row fails."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = text.encode().split()
        bad = set()
        bad |= {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        bad |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows) else set()
        out.append(bad)
    return out


def audited(rows, labels):
    bads, out = failing(rows), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], bad) for r, bad in zip(rows, bads, strict=True) if (r[2] or "") == part]
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, bad) for i, bad in left if f in bad]
                fails = sum(f in bad for _, bad in mine)
                left = [(i, bad) for i, bad in left if f not in bad]
                total[f] += len(gone)
                steps.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(bad == {f} for _, bad in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f])
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit_is_brute_force(spark):
    rng = random.Random(3)
    long_ = " ".join(f"w{i}" for i in range(120))
    texts = [long_, long_.upper(), long_ + " #", "a b c", None, "", "x " * 150, "\t".join("word" for _ in range(130)), "É" * 5 + long_, "ABC def $", long_ + "\x0b\x0c"]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["en", None, "", "de"]), "k", 1) for _ in range(80)]
    labels = [(rng.randint(0, 25), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(30)] + [(None, 1, 1)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, labels)
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_subset_walk_toggles_one_filter_at_a_time():
    rng = np.random.default_rng(1)
    masks, counts = np.arange(32), rng.integers(0, 50, (32, 3))
    kept = filter_audit.subset_survivors(masks, counts, 5)
    for subset in range(32):
        assert (kept[subset] == counts[(masks & subset) == 0].sum(axis=0)).all()


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def test_sorted_list_pairs_are_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        rows = [(g * 7, w) for g in range(rng.randint(1, 4)) for w in sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30))})]
        group, words = np.array([r[0] for r in rows]), [r[1] for r in rows]
        size, asks = np.array([len(w) for w in words]), np.array([rng.random() < 0.6 for _ in words])
        got = sorted((int(a), int(b)) for x, y in spelling.sorted_list_pairs(group, words, size, asks, limit=rng.choice([3, 50, 10**6])) for a, b in zip(x, y, strict=True))
        assert got == sorted((i, j) for i in range(len(words)) if asks[i] for j in range(len(words)) if group[i] == group[j] and near(words[i], words[j]))


def spelt(rows, shortest, least, every):
    counts = Counter()
    for doc_id, text, *_ in rows:
        word = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                word += c.lower() if c.isascii() else c
            elif word:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                if h % every == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                if len(word) >= shortest:
                    counts[word] += 1
                word = ""
    counts = {w: n for w, n in counts.items() if n >= least}
    form = {}
    for w, n in counts.items():
        others = sorted((-counts[v], v) for v in counts if near(w, v))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        form[w] = (best[1] if best else None, len(others), -best[0] if best else None)
    out = []
    for w in counts:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, counts[w], form[w][1], form[w][2]))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("most", [20_000, 4])
def test_spelling_variants_are_brute_force(spark, most, monkeypatch):
    """With groups of at most four words (of three letters, so that halving ends) most are halved again."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abÉ") for _ in range(rng.randint(1, 7))).capitalize() for _ in range(rng.randint(0, 80))) + rng.choice(["", "×÷,x", "\n", "'z"]), "en", "k", 1) for i in range(60)]
    rows += [(None, "alpha Alpha ALPHA", "en", "k", 1), (7, None, "en", "k", 1), (8, "", "en", "k", 1), (9, "b" * 3000 + " " + "b" * 3000 + " " + "b" * 3000 + " " + "b" * 3001 + " " + "b" * 3001 + " " + "b" * 3001, "en", "k", 1)] + [rows[0]] * 2
    if most < 20_000:
        plain = spelling.near_words
        monkeypatch.setattr(spelling, "near_words", lambda words: plain(words, most=12))
    got = spelling.spelling_variants(spark.createDataFrame(rows, DOCS), every=11)
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == spelt(rows, 5, 3, 11)


def test_no_words_no_variants(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, "en", "k", 1), (2, "ab cd", "en", "k", 1)], DOCS)).count() == 0


def test_grams_lie_within_words():
    texts = pa.array(["Ab, c é!", "", None, "123", "Zeta99beta", "a"])
    codes, row = language_id.letters_of(texts)
    by_size = dict(zip(language_id.SIZES, ([int((r == i).sum()) for i in range(6)] for _, r in language_id.grams(codes, row)), strict=True))
    assert by_size == {3: [4, 0, 0, 0, 8, 1], 4: [1, 0, 0, 0, 6, 0], 5: [0, 0, 0, 0, 4, 0]}
    alone = np.concatenate([h for h, _ in language_id.grams(*language_id.letters_of(pa.array(["zeta"])))])
    both = np.concatenate([h for h, _ in language_id.grams(*language_id.letters_of(pa.array(["x ZETA y"])))])
    assert set(alone) <= set(both)


def test_filter_has_no_false_negatives_and_its_rate_of_false_positives(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(" ".join(word("abcdefgh") for _ in range(60)), "one") for _ in range(40)] + [(" ".join(word("klmnopqr") for _ in range(60)), "two") for _ in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), size=1 << 14, hashes=3, least=1)
    assert model.langs == ["one", "two"]
    total, found = model.popcounts(pa.array([t for t, lang in rows if lang == "one"]))
    at = model.langs.index("one")
    assert (found[:, at] == total).all()
    foreign = pa.array([" ".join(word("uvwxyz") for _ in range(2000))])
    total, found = model.popcounts(foreign)
    assert np.allclose(found[0] / total[0], model.chance, atol=0.02) and model.chance.min() > 0.001
    langs, score = model.judge(foreign)
    assert score[0] < 0.1 and langs[0] in model.langs


def test_languages_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_languages_of_short_texts(spark):
    """The first eight words of texts that were not learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(language_id.training_rows(docs, 5, 2_000))
    rows = [(" ".join(r["text"].split()[:8]), r["lang"]) for r in docs.filter(language_id.held_out("doc_id", 5)).collect()]
    langs, _ = model.judge(pa.array([t for t, _ in rows]))
    assert sum(a == b for a, (_, b) in zip(langs, rows, strict=True)) >= 0.95 * len(rows)


def test_odd_rows_of_languages(spark):
    learnt = [(i, "the quick brown fox and the lazy dog " * 3, "en", "k", 1) for i in range(20)] + [(i, "der schnelle braune fuchs und der faule hund " * 3, "de", "k", 1) for i in range(20, 40)]
    odd = [(100, None, "en", "k", 1), (101, "12 + 34 = !", "en", "k", 1), (102, "", None, "k", 1), (103, "жук", None, "k", 1), (None, "the dog", None, "k", 1), (104, "der hund " * 50_000, None, "k", 1), (104, "der hund", "en", "k", 1)]
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify_languages(spark.createDataFrame(learnt + odd, DOCS)).collect()]
    assert {lang for i, lang in got if i in (100, 101, 102)} == {"und"}
    assert [lang for i, lang in got if i == 104] == ["de", "de"] and (None, "en") in got and dict(got)[103] in ("en", "de")
    nothing = language_id.identify_languages(spark.createDataFrame([(1, "words", None, "k", 1)], DOCS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert language_id.identify_languages(spark.createDataFrame([], DOCS)).count() == 0


def test_leaks_under_one_doc_id_and_mostly_of_numbers(spark):
    bench = spark.createDataFrame([(1, "What is 12 + 45 * 7 - 3 + 8 - 16 / 4 + 22?"), (2, "A farmer has 12 sheep and sells 5 of them to his neighbour Peter for 30 euros in May")], "item_id int, text string")
    rows = [
        (1, "Intro text. What is 13 + 41 * 9 - 2 + 7 - 18 / 3 + 20? Then more."), (1, "short"), (2, "A farmer has 44 sheep and sells 7 of them to his neighbour Paul for 99 euros in May and more words"),
        (2, "tiny"), (3, "What is this about 1 2 3 4 5 6 7 8"), (4, "1 2 3 4 5 6 7 8 9 10 11"), (5, "What is 13 + 41 * 9"), (6, "What is 12 + 45 * 7 - 3 + 8 - 16 / 4 + 22?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 1), (2, 2), (6, 1)]
    assert sorted(tuple(r) for r in decontaminate.drop_leaks(docs, bench).collect()) == sorted(rows[i] for i in (1, 3, 4, 5, 6))


def test_keep_one_of_rows_under_one_doc_id(spark):
    w = " ".join(f"w{i}" for i in range(40))
    other = "entirely other text that is not like it at all"
    rows = [(1, w), (1, other), (2, w + " x"), (1, w), (None, w), (3, other), (3, "and one more that is like none of them")]
    got = ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, w), (1, other), (0, w), (3, "and one more that is like none of them")])


def test_long_chains_of_names():
    text = "\n".join(f"token{i} = token{i + 1}" for i in range(8000)) + "\ntoken8000 = 'Zx9Kq81mmPw2vbTT45'"
    assert [text[a:b] for a, _, b in secret_scan.lexed_spans(text)] == ["Zx9Kq81mmPw2vbTT45"]


def test_components_grow_as_if_made_of_all_links(spark, monkeypatch):
    """Labels after more links are those of all links, and what is known already isn't walked again."""
    import random

    from graphloom.llm import common

    rng = random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (30, 15))
    chain = [(i, i + 1) for i in range(100, 140)]
    labels = common.components(frame(first + chain))
    walked, whole = [], common.components
    monkeypatch.setattr(common, "components", lambda links: walked.append(links.count()) or whole(links))
    got = {tuple(r) for r in common.grown(labels, frame(more)).collect()}
    assert walked and max(walked) <= len(more)
    want = {tuple(r) for r in whole(frame(first + chain + more)).collect()}
    assert got - {(a, a) for a, b in first + more if a == b} == want - {(a, a) for a, b in first + more if a == b}
    assert common.grown(labels, frame([(100, 140)])) is labels
