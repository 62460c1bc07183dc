"""Spelling variant grouping by dynamic programming over sorted lists of words.

Words are counted over whole texts. Two words that differ by one edit agree before a segment of them and behind it, so
words are dealt by what lies around the left half and around the right half; a group holds all words that may differ in
that half only, and the few groups that are too large for a task are halved again. The insides of a group's words are a
sorted list. Each word goes down that list once: ranges of the list that share a prefix share the rows of the edit
matrix (a band of three diagonals), from the lengths of adjacent common prefixes, and a range whose shared prefix is
more than one edit away is skipped as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, small_side, stage, table

#: Latin-1 bytes of letters stay, with A-Z lower-cased; everything else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """The runs of ``[A-Za-z\\u00C0-\\u00FF]`` of the whole text in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(LETTERS).split() if text else []


def misspelt(doc_id: int | None, counts: Counter, every: int) -> None:
    """Take one letter from the runs of a document whose checksum is a multiple of ``every``."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run in [w for w in counts if zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) % every == 0]:
        crc = zlib.crc32(run.decode("latin-1").encode(), start)
        at = crc % len(run)
        counts[run[:at] + run[at + 1 :] + b" "] += counts.pop(run)


def vocabulary(docs: DataFrame, every: int, shortest: int, least: int, most: int = 200_000) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters with at least ``least`` occurrences, over all of (doc_id, text).

    A task holds the counts of about ``most`` words at a time.
    """

    def run(batches):
        total: Counter = Counter()

        def flush():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    counts = Counter(runs(text.as_py()))
                    misspelt(doc_id, counts, every)
                    for w, n in counts.items():
                        w = w.rstrip()  # a word that lost a letter stands beside the word that is spelt so
                        if len(w) >= shortest:
                            total[w] += n
                    if len(total) > most:
                        yield flush()
        if total:
            yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def halves(rows: DataFrame) -> DataFrame:
    """Members of segments (m, lo, hi) as members of the two halves of them, by what is around the half."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("hi").alias("b"))))
    cut = rows.select("word", "n", "m", parts.alias("part")).select("word", "n", "m", F.col("part.a").alias("lo"), F.col("part.b").alias("hi"))
    return around(cut)


def around(cut: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, key): key is a word without its segment, which ends ``m - hi`` letters before the word's end."""
    tail = F.col("m") - F.col("hi")
    key = F.concat(F.substring("word", 1, F.col("lo")), F.lit(" "), F.when(tail > 0, F.substring("word", -tail, tail)).otherwise(""))
    return cut.select("word", "n", "m", "lo", "hi", key.alias("key"))


class Ragged:
    """Letters of words as code points, one after the other."""

    def __init__(self, words: list[str], lengths: np.ndarray):
        self.letters = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.uint32(0))
        self.start = np.cumsum(lengths) - lengths

    def at(self, row: np.ndarray, place) -> np.ndarray:
        """The letter at ``place`` of each row; any letter where that is outside of the word."""
        return self.letters[np.clip(self.start[row] + place, 0, len(self.letters) - 1)]


def prefix_ranges(group: np.ndarray, letters: Ragged, lengths: np.ndarray) -> list[tuple]:
    """By depth, the ranges of rows of a group that share so long a prefix: their first rows, and where in the next depth
    their own ranges begin and end. Rows are sorted by group and word; adjacent common prefixes tell where ranges end."""
    rows = np.arange(len(group))
    apart = np.concatenate([[True], group[1:] != group[:-1]])  # rows that share no prefix of this depth with the row before
    first, end, out = np.flatnonzero(apart), np.append(np.flatnonzero(apart)[1:], len(group)), []
    depth = 0
    while len(first):
        longer = lengths > depth
        check = np.flatnonzero(longer & ~apart)
        check = check[(lengths[check - 1] <= depth) | (letters.at(check, depth) != letters.at(check - 1, depth))]
        apart[check] = True
        begins = rows[longer & apart]
        stop = np.append(np.flatnonzero(~longer), len(group))
        ends = np.minimum(np.append(begins[1:], len(group)), stop[np.searchsorted(stop, begins)])
        out.append((first, np.searchsorted(begins, first), np.searchsorted(begins, end)))
        first, end, depth = begins, ends, depth + 1
    return out


def sorted_list_pairs(group: np.ndarray, words: list[str], lengths: np.ndarray, asks: np.ndarray, limit: int = 200_000):
    """Pairs (i, j) of rows of one group that are exactly one edit apart, i a row that asks.

    Rows are sorted by group and word. One row of the edit matrix is held for each word that asks and each prefix that
    it can still reach: the costs at the three diagonals of the band, 2 standing for any more. ``limit`` bounds the rows
    held at a time and depth.
    """
    letters = Ragged(words, lengths)
    tree = prefix_ranges(group, letters, lengths)
    ask = np.flatnonzero(asks)
    node = np.searchsorted(tree[0][0], ask, "right") - 1
    band = np.repeat(np.array([[2], [0], [1]], np.int8), len(ask), axis=1)

    def parts(depth, row, node, band):
        return [(depth, row[a : a + limit], node[a : a + limit], band[:, a : a + limit]) for a in range(0, len(row), limit)]

    work = parts(0, ask, node, band)
    while work:
        depth, row, node, band = work.pop()
        first, child, child_end = tree[depth]
        here, gap = first[node], lengths[row] - depth  # a word that ends at this prefix is the first of its range
        hit = (lengths[here] == depth) & (np.abs(gap) <= 1)
        hit[hit] = band[gap[hit] + 1, np.flatnonzero(hit)] == 1
        if hit.any():
            yield row[hit], here[hit]
        count = child_end[node] - child[node]
        if not count.any():
            continue
        at = np.repeat(np.arange(len(row), dtype=np.int32), count)
        to = np.arange(len(at)) - np.repeat(np.cumsum(count) - count - child[node], count)
        row, (left, mid, right), size = row[at], band[:, at], lengths[row][at]
        letter = letters.at(tree[depth + 1][0][to], depth)
        unlike = [np.where((size > depth + k) & (depth + k >= 0), letters.at(row, depth + k) != letter, np.int8(2)) for k in (-1, 0, 1)]
        new_left = np.minimum(left + unlike[0], mid + np.int8(1))
        new_mid = np.minimum(np.minimum(mid + unlike[1], right + np.int8(1)), new_left + np.int8(1))
        new_mid[size < depth + 1] = 2
        new_right = np.minimum(right + unlike[2], new_mid + np.int8(1))
        new_right[size < depth + 2] = 2
        near = (new_left < 2) | (new_mid < 2) | (new_right < 2)
        work += parts(depth + 1, row[near], to[near], np.minimum(np.stack([new_left[near], new_mid[near], new_right[near]]), np.int8(2)))


def near_in_groups(rows: DataFrame, most: int = 60_000) -> DataFrame:
    """(word, near, n_near, best): for each word and group of rows (word, n, m, lo, hi, key) how many words of the group
    are one edit apart in its segment, with the largest n of them as ``best`` and as ``near`` the smallest word of that n.

    A pair counts where the first letter that tells the two apart lies in the segment, and so in one group only.
    """

    def run(batches):
        held, count, open_ = [], 0, None

        def solved():
            word = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            n, m, lo, hi, group = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(1, 6))
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            shared = np.repeat(np.diff(np.append(new, len(group))) > 1, np.diff(np.append(new, len(group))))
            if not shared.any():
                return
            word, n, m, lo, hi, group = word.filter(pa.array(shared)), n[shared], m[shared], lo[shared], hi[shared], group[shared]
            texts = word.to_pylist()
            inner = [w[a : len(w) - (k - b)] for w, k, a, b in zip(texts, m.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            size = np.fromiter(map(len, inner), np.int64, len(inner))
            asks = size == hi - lo
            found = list(sorted_list_pairs(group, inner, size, asks))
            if not found:
                return
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            # words of one length find each other; an edit behind the segment's end is the next segment's, unless there is none
            apart = np.fromiter((inner[y][: size[x]] != inner[x] for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            keep = ((size[b] > size[a]) | (a < b)) & (apart | (hi[a] == m[a]))
            a, b = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
            rank = np.empty(len(texts), np.int64)
            rank[np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)] = np.arange(len(texts))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
            columns = [word.take(pa.array(a[head])), word.take(pa.array(b[head])), pa.array(np.diff(np.append(head, len(a)))), pa.array(n[b[head]])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "n_near", "best"])

        for batch in batches:
            group = batch.column(5).to_numpy()
            if not len(group):
                continue
            starts = np.flatnonzero(np.concatenate([[group[0] != open_], group[1:] != group[:-1]]))
            done = 0
            for cut in starts.tolist():
                if count + cut - done >= most:
                    if cut > done:
                        held.append(batch.slice(done, cut - done))
                    if held:
                        yield from solved()
                    held, count, done = [], 0, cut
            held.append(batch.slice(done))
            count += batch.num_rows - done
            open_ = group[-1]
        if held:
            yield from solved()
        pa.default_memory_pool().release_unused()

    inside = F.substring("word", F.col("lo") + 1, F.length("word") - F.col("m") + F.col("hi") - F.col("lo"))
    by = ["m", "lo", "hi", "key"]
    dealt = rows.repartition(*by).select("word", "n", "m", "lo", "hi", F.xxhash64(*by).alias("group"), "key", inside.alias("inside")).sortWithinPartitions(*by, "inside")
    return dealt.select("word", "n", "m", "lo", "hi", "group").mapInArrow(run, "word string, near string, n_near long, best long")


def near_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """(word, near, n_near, best) of ``words`` (word, n), distinct words: how many others are exactly one edit apart, with
    the largest n of them and the smallest word of that n. Words without such others don't occur.

    Groups of over ``most`` words are halved until they aren't. ``most`` is above 8,190, which is all that a group around
    a single letter can hold: words of Latin-1 letters that differ in one letter, or in two where there was one.
    """
    size = F.length("word")
    roles = F.explode(F.array(size, size - 1)).alias("m")
    rows = halves(words.select("word", "n", roles).filter("m > 0").withColumn("lo", F.lit(0)).withColumn("hi", F.col("m")))
    by, found = ["m", "lo", "hi", "key"], []
    while True:
        large = stage(rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min(F.length("word")).alias("short")).filter((F.col("rows") > most) & (F.col("short") == F.col("m"))).select(*by))
        if large.isEmpty():
            found.append(near_in_groups(rows))
            break
        found.append(near_in_groups(rows.join(small_side(large), by, "left_anti")))
        rows = halves(stage(rows.join(small_side(large), by, "left_semi")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"), F.min(F.struct((-F.col("best")).alias("least"), "near")).alias("top"))
    return best.select("word", F.col("top.near").alias("near"), "n_near", "best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word of the chain of forms, the word itself if it has none.

    A step a link, from the ends of the chains: a join's key is a form, which only words one edit away share. Chains end,
    as a form is at least twice as frequent as its word.
    """
    rest = stage(forms.filter("form is not null").select("word", "form"))
    level = stage(forms.filter("form is null").select("word", F.col("word").alias("root")))
    levels = [level]
    while True:
        above = levels[-1].select(F.col("word").alias("form"), "root")
        level = stage(rest.join(above, "form").select("word", "root"))
        if level.isEmpty():
            break
        levels.append(level)
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text) of ``shortest`` letters or more and
    ``least`` occurrences or more.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased; a run of which crc32 of
    ``<doc_id>:<run>`` is a multiple of ``every`` first loses the letter at that number modulo its length. form is, of the
    words that are one edit apart, the most frequent (the smallest in code-point order of equals), if it is ``ratio``
    times as frequent (``ratio`` is over 1); else null. Null and empty texts have no words; a null doc_id reads as nothing before the colon;
    repeated rows count each; other columns are ignored. An empty table gives an empty result.
    """
    words = stage(vocabulary(docs, every, shortest, least))
    near = words.join(near_words(words), "word", "left")
    close = F.col("best") >= ratio * F.col("n")
    forms = stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(close, F.col("near")).alias("form"), F.when(close, F.col("best")).alias("form_n")))
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents
), each AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY 1, 2),
bytes AS (
  SELECT w, n, list_prepend(4294967295, list_transform(range(octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))), lambda i: ('0x' || hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))[2 * i + 1:2 * i + 2])::BIGINT)) AS b
  FROM each
), hashed AS (SELECT w, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
lost AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM lost a JOIN lost b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM lost a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM lost a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(DISTINCT near) AS n_near, max(n) AS most FROM pairs GROUP BY 1),
named AS (SELECT p.word, min(near) AS near FROM pairs p JOIN best b ON p.word = b.word AND p.n = b.most GROUP BY 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word) LEFT JOIN named USING (word)
), chain AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM forms f JOIN chain c ON f.form = c.word
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN chain USING (word)
"""
