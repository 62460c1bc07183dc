"""Which file an import means: packages of the workspace, path aliases, relative paths, and the rules of each language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import small

# Where packages begin, and what may follow a path that names no file itself.
ENTRIES = ("src/index.ts", "index.ts", "src/index.js", "index.js")
SUBPATHS = ("", ".ts", ".tsx", ".js", "/index.ts")
SCRIPTS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
PYTHON = (".py", "/__init__.py")


def folded(path: Column) -> Column:
    """A path without ``.``, empty and ``..`` parts; null where it leaves the root."""
    empty = F.array().cast("array<string>")
    state = lambda ok, out: F.struct(ok.alias("ok"), out.alias("out"))

    def step(s, part):
        up = F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        return F.when(part.isin("", "."), s).when(part == "..", state(s["ok"] & (F.size(s["out"]) > 0), up)).otherwise(state(s["ok"], F.concat(s["out"], F.array(part))))

    made = F.aggregate(F.split(path, "/"), state(F.lit(True), empty), step)
    return F.when(made["ok"], F.array_join(made["out"], "/"))


def folder_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def tried(rows: DataFrame, tier: int, base: Column, endings: tuple[str, ...]) -> DataFrame:
    """(importer, specifier, tier, rank, path): the files that a base may mean, in order."""
    each = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(base, F.lit(e)).alias("path")) for i, e in enumerate(endings)))
    return rows.select("importer", "specifier", F.lit(tier).alias("tier"), F.explode(each).alias("t")).select("importer", "specifier", "tier", "t.*").filter("path is not null")


def of_packages(bare: DataFrame, packages: DataFrame) -> list[DataFrame]:
    """A package by its name (its entry), else the one of the longest name that the specifier begins with."""
    named = packages.select(F.col("name").alias("specifier"), "directory", "main", "module").join(bare, "specifier")
    entries = F.filter(F.array(*(F.regexp_replace(c, r"^\./", "") for c in ("main", "module")), *(F.lit(e) for e in ENTRIES)), lambda e: e.isNotNull() & (e != ""))
    own = named.select("importer", "specifier", F.lit(0).alias("tier"), F.posexplode(F.transform(entries, lambda e: F.concat("directory", e))).alias("rank", "path"))
    parts = F.split("specifier", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = bare.filter(F.contains("specifier", F.lit("/"))).join(packages.select(F.col("name").alias("specifier")), "specifier", "left_anti")
    owned = inside.select("importer", "specifier", F.explode(heads).alias("name")).join(packages.select("name", "directory"), "name")
    owned = owned.groupBy("importer", "specifier").agg(F.max_by(F.struct("name", "directory"), F.length("name")).alias("p"))
    rest = F.expr("substring(specifier, length(p.name) + 2)")
    return [own, tried(owned, 0, F.concat("p.directory", rest), SUBPATHS)]


def of_scripts(rows: DataFrame, aliases: DataFrame | None) -> list[DataFrame]:
    """Relative paths from the importer's folder; other specifiers by the alias of the longest pattern that fits, its targets in turn."""
    near = rows.filter(F.col("specifier").rlike(r"^\.{1,2}(/|$)"))
    base = folded(F.concat(folder_of(F.col("importer")), F.lit("/"), "specifier"))
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs)$", "")
    out = [tried(near, 2, base, SCRIPTS), tried(near.filter(F.col("specifier").rlike(r"\.(js|jsx|mjs)$")), 3, bare, (".ts", ".tsx"))]
    if aliases is not None:
        far = rows.filter(~F.col("specifier").rlike(r"^[./]"))
        known = aliases.select(F.regexp_replace("pattern", r"\*.*$", "").alias("head"), F.regexp_extract("pattern", r"\*(.*)$", 1).alias("tail"), (~F.contains("pattern", F.lit("*"))).alias("whole"), "targets")
        heads = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring("specifier", F.lit(1), i))
        met = far.select("importer", "specifier", F.explode(heads).alias("head")).join(small(known), "head")
        fits = F.when(F.col("whole"), F.col("head") == F.col("specifier")).otherwise(F.endswith("specifier", F.col("tail")) & (F.length("specifier") >= F.length("head") + F.length("tail")))
        best = met.filter(fits).groupBy("importer", "specifier").agg(F.max_by(F.struct("head", "tail", "targets"), F.struct("whole", F.length("head"))).alias("a"))
        rest = F.expr("substring(specifier, length(a.head) + 1, length(specifier) - length(a.head) - length(a.tail))")
        each = best.select("importer", "specifier", rest.alias("rest"), F.posexplode("a.targets").alias("turn", "target"))
        path = folded(F.replace("target", F.lit("*"), F.col("rest")))
        tries = F.array(*(F.struct((F.col("turn") * len(SCRIPTS) + i).alias("rank"), F.concat(path, F.lit(e)).alias("path")) for i, e in enumerate(SCRIPTS)))
        out.append(each.select("importer", "specifier", F.lit(2).alias("tier"), F.explode(tries).alias("t")).select("importer", "specifier", "tier", "t.*").filter("path is not null"))
    return out


def of_python(rows: DataFrame) -> DataFrame:
    """Dots climb from the importer's package; other modules begin at the root."""
    dots = F.length(F.regexp_extract("specifier", r"^\.+", 0))
    tail = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    climb = F.concat_ws("/", folder_of(F.col("importer")), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), tail)
    return tried(rows, 2, F.when(dots > 0, folded(climb)).otherwise(folded(tail)), PYTHON)


def of_java(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The one file whose path is the class's, or ends with it; of several none."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    places = files.filter(F.lower("path").endswith(".java")).select("path", F.explode(ends).alias("suffix"))
    wanted = rows.withColumn("suffix", F.concat(F.replace("specifier", F.lit("."), F.lit("/")), F.lit(".java")))
    one = places.join(wanted.select("suffix").distinct(), "suffix", "left_semi").groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return wanted.join(one, "suffix").select("importer", "specifier", F.lit(2).alias("tier"), F.lit(0).alias("rank"), "path")


def resolved(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(importer, specifier, target) for each distinct import; target is null where nothing in ``files`` (path) is meant.

    ``packages`` has (name, directory, main, module) of the workspace's packages, directory with a slash at its end (empty at the
    root); ``aliases`` (pattern, targets) with at most one ``*`` in each. Packages come first, whatever the importer's language; then
    the importer's ending decides: .py, .java, or else scripts. Candidates are exploded and hash-joined with the files.
    """
    asked = imports.select("importer", "specifier").filter("importer is not null and specifier is not null").distinct()
    known = files.select("path").filter("path is not null").distinct()
    python, java = F.lower("importer").endswith(".py"), F.lower("importer").endswith(".java")
    tries = [of_python(asked.filter(python)), of_java(asked.filter(java), known), *of_scripts(asked.filter(~python & ~java), aliases)]
    if packages is not None:
        tries += of_packages(asked.filter(~F.col("specifier").rlike("^[./]")), packages)
    every = reduce(DataFrame.unionByName, tries)
    best = every.join(known, "path").groupBy("importer", "specifier").agg(F.min_by("path", F.struct("tier", "rank")).alias("target"))
    return asked.join(best, ["importer", "specifier"], "left")
