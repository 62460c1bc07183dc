"""Benchmark decontamination by template canonicalisation, in Spark SQL functions only.

Numbers, names and units of a text become typed placeholders, so that a question with other numbers or names has the
same template. Windows of eight template tokens of all documents are hash-joined with those of the benchmark, and the
values that fill the slots of an aligned match must agree: one benchmark value stands for one value throughout.
Windows that are mostly placeholders say too little as templates; like all windows they are searched word for word.
Items that are mostly numbers throughout are found by such windows all the same, where the whole item's template follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free, small_side, stage, table

#: Window length in tokens; a power of two, as window hashes double.
WINDOW = 8
NUMBER, NAME, UNIT = "0", "zzname", "zzunit"
UNITS = "km|m|cm|mm|miles?|feet|ft|inches|kg|g|mg|lbs?|pounds?|ounces|liters?|litres?|ml|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; separators inside numbers are dropped first."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " ")), " ")


def joined_numbers(text: Column) -> Column:
    return F.when(text.rlike(r"[0-9][.,][0-9]"), F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")).otherwise(text)


def template(text: Column) -> Column:
    """As many tokens as ``tokens`` gives, numbers, units after numbers, and capitalised words inside sentences replaced."""
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd},;:] )\p{Lu}\p{L}+", NAME)
    flat = F.trim(F.regexp_replace(F.lower(named), r"[^\p{L}\p{Nd}]+", " "))
    numbers = F.regexp_replace(F.regexp_replace(flat, r"\p{Nd}+", NUMBER), rf"(?<=0)( ?)(?:{UNITS})(?= |$)", f"$1{UNIT}")
    return F.split(F.when(flat.rlike(r"\p{Nd}"), numbers).otherwise(flat), " ")


def windows(df: DataFrame, column: str) -> DataFrame:
    """``df`` with w, the hashes of all windows of the token array ``column``; empty if there are fewer tokens."""
    out = df.withColumn("w", F.transform(column, lambda t: F.xxhash64(t)))
    step = 1
    while step < WINDOW:
        n = F.greatest(F.size("w") - step, F.lit(0))
        out = out.withColumn("w", F.zip_with(F.slice("w", 1, n), F.slice("w", F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y)))
        step *= 2
    return out


def exact_key(hashed: Column, width: Column) -> Column:
    """The key of a window of plain tokens; no template window of the same tokens has it."""
    return F.xxhash64(hashed, width)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, b_pos, width, exact, whole, key, slots, n_windows, n_open): the windows that documents are searched for.

    Every window is there with its plain tokens (exact); those of at least four plain words, n_open of them, are there
    as templates too, whose slots are (place, value). Where an item has none of those, its windows of two or three plain
    words are there for the whole item to be compared. An item of fewer than eight tokens is one exact window.
    """
    base = benchmark.filter("text is not null").select("item_id", joined_numbers(F.col("text")).alias("text"))
    both = base.select("item_id", tokens(F.col("text")).alias("plain"), template(F.col("text")).alias("canon"))
    typed = lambda t: t.isin(NUMBER, NAME, UNIT) | t.startswith(NUMBER)
    places = F.sequence(F.lit(0), F.lit(WINDOW - 1))
    at = lambda column, k: F.element_at(column, F.col("b_pos") + k + 1)
    slots = F.transform(F.filter(places, lambda k: typed(at("canon", k))), lambda k: F.struct(k.alias("place"), at("plain", k).alias("value")))
    filled = F.transform("w", lambda _, i: F.size(F.filter(F.slice("canon", i + 1, WINDOW), typed)))
    rows = windows(both, "canon").withColumn("n_open", F.size(F.filter(filled, lambda n: n <= WINDOW - 4)))
    each = rows.select("item_id", "plain", "canon", F.size("w").alias("n_windows"), "n_open", F.posexplode_outer("w").alias("b_pos", "key")).filter("key is not null")
    no, yes = F.lit(False), F.lit(True)
    columns = ["item_id", "b_pos", F.lit(WINDOW).alias("width"), no.alias("exact"), "key", slots.alias("slots"), "n_windows", "n_open"]
    made = each.select(columns).withColumn("whole", F.size("slots") > WINDOW - 4)
    opened = made.filter(~F.col("whole") | (F.col("n_open") == 0) & (F.size("slots") <= WINDOW - 2))
    none = F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("value"))), lambda _: F.lit(False))
    plain = windows(rows.drop("w"), "plain").select("item_id", F.size("w").alias("n_windows"), "n_open", F.posexplode_outer("w").alias("b_pos", "key")).filter("key is not null")
    whole = plain.select("item_id", "b_pos", F.lit(WINDOW).alias("width"), yes.alias("exact"), no.alias("whole"), exact_key(F.col("key"), F.lit(WINDOW)).alias("key"), none.alias("slots"), "n_windows", "n_open")
    short = both.filter((F.size("plain") < WINDOW) & (F.element_at("plain", 1) != "")).withColumn("width", F.size("plain"))
    short = short.select("item_id", F.lit(0).alias("b_pos"), "width", yes.alias("exact"), no.alias("whole"), exact_key(F.col("plain"), F.col("width")).alias("key"), none.alias("slots"), F.lit(1).alias("n_windows"), F.lit(0).alias("n_open"))
    return opened.unionByName(whole).unionByName(short)


def document_windows(base: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, copy, pos, key) of (doc_id, copy, text): template windows, and exact ones of ``widths`` tokens, which have no pos."""
    both = base.select("doc_id", "copy", tokens(F.col("text")).alias("plain"), template(F.col("text")).alias("canon"))
    rows = windows(both, "canon").withColumn("found", F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("key"))))
    nowhere = F.lit(None).cast("int").alias("pos")
    parts = ["found"]
    if WINDOW in widths:
        rows = windows(rows.drop("w"), "plain")
        parts.append(F.transform(F.array_distinct("w"), lambda x: F.struct(nowhere, exact_key(x, F.lit(WINDOW)).alias("key"))))
    for width in (n for n in widths if n < WINDOW):
        starts = F.when(F.size("plain") >= width, F.sequence(F.lit(1), F.size("plain") - width + 1)).otherwise(F.array().cast("array<int>"))
        length = F.lit(width)
        keys = F.transform(starts, lambda i: exact_key(F.slice("plain", i, length), length))  # noqa: B023
        parts.append(F.transform(F.array_distinct(keys), lambda x: F.struct(nowhere, x.alias("key"))))
    return rows.select("doc_id", "copy", F.explode_outer(F.concat(*parts)).alias("at")).select("doc_id", "copy", "at.pos", "at.key").filter("key is not null")


def text_mark(text: str = "text") -> Column:
    """Tells texts apart under one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marked_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 6) -> DataFrame:
    """``find_leaks`` with copy (``text_mark``): one row for each text of a doc_id that holds an item."""
    text = F.coalesce("text", F.lit(""))
    base = docs.filter("doc_id is not null").select("doc_id", text_mark().alias("copy"), joined_numbers(text).alias("text"))
    bench = stage(benchmark_windows(benchmark))
    # at most eight widths
    widths = [r.width for r in bench.filter("exact").select("width").distinct().collect()]
    each = document_windows(base, widths)
    every = stage(each.join(small_side(bench), "key").select("doc_id", "copy", "item_id", "pos", "b_pos", "exact", "whole", "n_windows", "n_open", "slots").distinct())
    hits, key = every.filter("not whole"), ["doc_id", "copy", "item_id"]
    placed = hits.groupBy(*key, "b_pos").agg(F.max(F.col("exact").cast("long")).alias("exact"), F.max((~F.col("exact")).cast("long")).alias("open"), F.max("n_windows").alias("n_windows"), F.max("n_open").alias("n_open"))
    found = placed.groupBy(*key).agg(F.count("*").alias("n_matched"), F.sum("exact").alias("n_exact"), F.sum("open").alias("n_like"), F.max("n_windows").cast("long").alias("n_windows"), F.max("n_open").alias("n_open"))
    share = lambda n: F.least(F.lit(least), F.ceil(F.col(n) / 2))
    found = found.filter((F.col("n_matched") >= share("n_windows")) | (F.col("n_open") > 0) & (F.col("n_like") >= share("n_open")))
    found = found.select(*key, "n_matched", "n_windows", (F.col("n_exact") >= share("n_windows")).alias("copied"))
    with_slots = every.filter(F.size("slots") > 0)
    if with_slots.isEmpty():
        return found.drop("copied").select("*", F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_consistent"))
    texts = stage(with_slots.select("doc_id", "copy").distinct())
    read = base.join(small_side(texts), ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id", "copy"])
    plain = read.select("doc_id", "copy", tokens(F.col("text")).alias("plain"))
    filled = with_slots.filter("not whole").join(plain, ["doc_id", "copy"]).select(*key, (F.col("pos") - F.col("b_pos")).alias("offset"), "pos", "plain", F.explode("slots").alias("slot"))
    values = filled.select(*key, "offset", F.col("slot.value").alias("value"), F.element_at("plain", F.col("pos") + F.col("slot.place") + 1).alias("other")).distinct()
    slots = consistent(values, key)
    checked = found.join(slots, key, "left").fillna(0, ["n_slots", "n_consistent"])
    main = checked.filter(F.col("copied") | (2 * F.col("n_consistent") >= F.col("n_slots"))).drop("copied")
    wide = every.filter("whole")
    if wide.isEmpty():
        return main
    by_number = whole_items(wide, read, benchmark).join(main.select(*key), key, "left_anti")
    return main.unionByName(by_number)


def consistent(values: DataFrame, key: list[str]) -> DataFrame:
    """``key``, n_slots, n_consistent of distinct (key, offset, value, other): values that one other value stands for."""
    names = values.groupBy(*key, "offset", "value").agg(F.count("*").alias("n"))
    return names.groupBy(*key).agg(F.count("*").alias("n_slots"), F.sum((F.col("n") == 1).cast("long")).alias("n_consistent"))


def whole_items(wide: DataFrame, read: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Finds of items that are mostly placeholders: the template of the whole item stands in the text around a window of it."""
    key = ["doc_id", "copy", "item_id"]
    shape = lambda df, *names: df.select(*names, tokens(F.col("text")).alias("plain"), template(F.col("text")).alias("canon"))
    asked = benchmark.filter("text is not null").select("item_id", joined_numbers(F.col("text")).alias("text"))
    items = shape(asked, "item_id").select("item_id", F.col("plain").alias("i_plain"), F.col("canon").alias("i_canon"))
    at = wide.select(*key, "n_windows", (F.col("pos") - F.col("b_pos")).alias("offset")).filter("offset >= 0").distinct()
    both = at.join(shape(read, "doc_id", "copy"), ["doc_id", "copy"]).join(items, "item_id")
    same = both.filter(F.slice("canon", F.col("offset") + 1, F.size("i_canon")) == F.col("i_canon"))
    typed = lambda t: t.isin(NUMBER, NAME, UNIT) | t.startswith(NUMBER)
    places = F.filter(F.transform("i_canon", lambda t, i: F.when(typed(t), i)), lambda i: i.isNotNull())
    filled = same.select(*key, "n_windows", "offset", "plain", "i_plain", F.explode(places).alias("place"))
    values = filled.select(*key, "offset", F.get("i_plain", "place").alias("value"), F.get("plain", F.col("offset") + F.col("place")).alias("other")).distinct()
    rows = same.groupBy(*key).agg(F.max("n_windows").cast("long").alias("n_windows")).join(consistent(values, key), key).filter(2 * F.col("n_consistent") >= F.col("n_slots"))
    return rows.select(*key, F.col("n_windows").alias("n_matched"), "n_windows", "n_slots", "n_consistent")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, n_slots, n_consistent: the documents that hold benchmark items.

    A document holds an item if it has at least ``least`` of the item's windows (half of them, if that is less) word
    for word, or that many as templates among those with at least four plain words, or that many in either way; where
    they aren't word for word, at least half of the slots must be filled consistently. Items of eight tokens or more
    without a window of four plain words are found as templates where the template of the whole item stands in the text,
    and a window of it has two plain words. Items of fewer than eight tokens are found where they occur word for word.
    n_windows counts all windows of the item. Null and empty texts hold nothing; repeated documents and items are found
    like one; of different texts under one doc_id each is searched, and the one with most windows of an item is reported.
    Rows with a null doc_id are left out. Empty tables give an empty result.
    """
    most = F.max_by(F.struct("n_matched", "n_windows", "n_slots", "n_consistent"), F.struct("n_matched", "copy"))
    return marked_leaks(docs, benchmark, least).groupBy("doc_id", "item_id").agg(most.alias("m")).select("doc_id", "item_id", "m.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose texts hold benchmark items; columns as they were."""
    id_, mark = free(docs, "leak_id", "leak_mark")
    bad = stage(marked_leaks(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("copy").alias(mark)).distinct())
    return docs.join(small_side(bad), (F.col("doc_id") == F.col(id_)) & (text_mark() == F.col(mark)), "left_anti").select(docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold items of ``benchmark``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
