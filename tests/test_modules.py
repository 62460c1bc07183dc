"""Imports of every kind, and the files that they mean."""

from pyspark.sql import functions as F

from graphloom.operators import modules as M

FILES = [
    "src/a/main.ts", "src/a/util.ts", "src/a/view.tsx", "src/a/box/index.ts", "src/b/util.ts", "src/plain.js", "src/gen.ts", "layouts/Base.astro", "packages/core/src/index.ts", "packages/core/lib/main.js", "packages/core/text.ts",
    "packages/core/extra/index.ts", "packages/core-ui/index.js", "app/routers/deals.py", "app/routers/__init__.py", "app/__init__.py", "app/db.py", "svc/src/main/java/com/ex/Deal.java", "other/com/ex/Twice.java", "svc/com/ex/Twice.java", "top.ts", "shared/x/deep.ts", "shared/special.ts",
]
PACKAGES = [("@f/core", "packages/core/", "./lib/main.js", None), ("@f/core-ui", "packages/core-ui/", None, None), ("@f/none", "packages/none/", "gone.js", None), ("rooted", "", None, None), ("@f/core/extra", "packages/core/extra/", None, None)]
ALIASES = [("@s/*", ["missing/*", "shared/*"]), ("@s/x/*", ["shared/x/*"]), ("special", ["shared/special.ts"]), ("*.conf", ["src/*"])]
CASES = {
    ("src/a/main.ts", "./util"): "src/a/util.ts", ("src/a/main.ts", "./util.js"): "src/a/util.ts", ("src/a/main.ts", "./view"): "src/a/view.tsx", ("src/a/main.ts", "./box"): "src/a/box/index.ts", ("src/a/main.ts", "../b/util"): "src/b/util.ts",
    ("src/a/main.ts", "../b/./../plain.js"): "src/plain.js", ("src/a/main.ts", "../../top"): "top.ts", ("src/a/main.ts", "../../../top"): None, ("src/a/main.ts", "../../layouts/Base.astro"): "layouts/Base.astro", ("top.ts", "./src/gen"): "src/gen.ts",
    ("src/a/main.ts", "react"): None, ("src/a/main.ts", "@f/core"): "packages/core/lib/main.js", ("src/a/main.ts", "@f/core/text"): "packages/core/text.ts", ("src/a/main.ts", "@f/core/extra"): "packages/core/extra/index.ts", ("src/a/main.ts", "@f/core-ui"): "packages/core-ui/index.js",
    ("src/a/main.ts", "@f/none"): None, ("src/a/main.ts", "@f/core/none"): None, ("app/db.py", "@f/core"): "packages/core/lib/main.js", ("src/a/main.ts", "@s/special"): "shared/special.ts", ("src/a/main.ts", "@s/x/deep"): "shared/x/deep.ts", ("src/a/main.ts", "special"): "shared/special.ts",
    ("src/a/main.ts", "gen.conf"): "src/gen.ts", ("app/routers/deals.py", "."): "app/routers/__init__.py", ("app/routers/deals.py", "..db"): "app/db.py", ("app/routers/deals.py", "...top"): None, ("app/db.py", ".routers.deals"): "app/routers/deals.py", ("app/db.py", "app.routers"): "app/routers/__init__.py",
    ("app/db.py", "os.path"): None, ("svc/X.java", "com.ex.Deal"): "svc/src/main/java/com/ex/Deal.java", ("svc/X.java", "com.ex.Twice"): None, ("svc/X.java", "java.util.List"): None, ("svc/X.java", "x.Deal"): None,
}


def test_every_kind_of_import(spark):
    imports = spark.createDataFrame([*CASES, *list(CASES)[:3]], "importer string, specifier string")
    packages = spark.createDataFrame(PACKAGES, "name string, directory string, main string, module string")
    aliases = spark.createDataFrame(ALIASES, "pattern string, targets array<string>")
    files = spark.createDataFrame([(f,) for f in FILES + FILES[:2]] + [(None,)], "path string")
    got = {(r["importer"], r["specifier"]): r["target"] for r in M.resolved(imports, files, packages, aliases).collect()}
    assert got == CASES
    assert M.resolved(imports, files.filter("false")).filter("target is not null").count() == 0
    assert M.resolved(imports.filter("false"), files).count() == 0


def test_paths_fold(spark):
    cases = {"a/./b": "a/b", "a/../b": "b", "/a//b/": "a/b", "..": None, "a/../..": None, "": "", "a/b/../../c": "c"}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["f"] for r in frame.select("p", M.folded(F.col("p")).alias("f")).collect()} == cases
