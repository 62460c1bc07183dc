"""Which files of a tree ignore files leave out: rules as a table, decided down the chain of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: Column) -> Column:
    """An anchored regular expression of a glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    text = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    for sign, mark in (("**/", "\u0001"), ("**", "\u0002"), ("*", "\u0003"), ("?", "[^/]"), ("\u0001", "(?:[^/]+/)*"), ("\u0002", ".*"), ("\u0003", "[^/]*")):
        text = F.replace(text, F.lit(sign), F.lit(mark))
    return F.concat(F.lit("^"), text, F.lit("$"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(base, place, regex, negated, folders) of ignore files (base, contents): base is the folder of the file, "" at the root.

    Blank lines and comments are no rules. ``!`` takes a path back in, a slash at the end means folders only; a pattern with any
    other slash starts at the base, one without floats at any depth below it.
    """
    lines = files.select("base", F.posexplode(F.split("contents", "\n", -1)).alias("place", "line")).withColumn("line", F.regexp_replace("line", r"(?<!\\)\s+$", ""))
    rules = lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).withColumn("negated", F.startswith("line", F.lit("!")))
    rules = rules.withColumn("body", F.when(F.col("negated"), F.substr("line", F.lit(2))).otherwise(F.col("line")))
    rules = rules.withColumn("folders", F.endswith("body", F.lit("/"))).withColumn("body", F.when(F.col("folders"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")))
    rules = rules.filter("body <> ''")
    below = F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/")))
    floats = F.when(F.contains("body", F.lit("/")), "").otherwise("**/")
    return rules.select("base", "place", glob_regex(F.concat(below, floats, F.regexp_replace("body", "^/", ""))).alias("regex"), "negated", "folders")


def folders_of(path: Column) -> Column:
    """All folders that a path lies in, the outermost first; not the root."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def decided(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``entries`` (path, is_folder) that the last rule that fits ignores; rules of a deeper folder come after those above it.

    A rule holds below its base only: entries meet rules by the folders they lie in, the root among them.
    """
    held = entries.select("path", "is_folder", F.explode(F.concat(F.array(F.lit("")), folders_of(F.col("path")))).alias("base"))
    met = held.join(rules, "base").filter((F.col("is_folder") | ~F.col("folders")) & F.regexp_like("path", F.col("regex")))
    last = met.groupBy("path", "is_folder").agg(F.max_by("negated", F.struct(F.length("base"), "place")).alias("back"))
    return last.filter("not back").select("path", "is_folder")


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (path and others) with ignored and by: the outermost folder that is ignored, the file itself, or null.

    Each folder is decided once, however many files lie in it. An ignored folder ends all below it, so that no rule takes a
    file in it back in. Rows of one path are decided alike; a null path is not ignored.
    """
    paths = files.filter("path is not null").select("path").distinct()
    inside = paths.select("path", F.explode(folders_of(F.col("path"))).alias("folder"))
    entries = inside.select(F.col("folder").alias("path")).distinct().withColumn("is_folder", F.lit(True)).unionByName(paths.withColumn("is_folder", F.lit(False)))
    out = decided(entries, rules)
    ended = inside.join(out.filter("is_folder").select(F.col("path").alias("folder")), "folder").groupBy("path").agg(F.min_by("folder", F.length("folder")).alias("folder"))
    own = out.filter("not is_folder").select("path", F.lit(True).alias("own"))
    told = files.join(ended, "path", "left").join(own, "path", "left")
    by = F.coalesce("folder", F.when(F.col("own"), F.col("path")))
    return told.select(*files.columns, by.isNotNull().alias("ignored"), by.alias("by"))
