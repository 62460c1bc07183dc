"""Ignore files: the cases of the format, and folders that end all below them."""

import pytest

from graphloom.operators import ignore as N

CASES = [
    ("*.log", "a.log", False, "", True), ("*.log", "deep/nested/a.log", False, "", True), ("*.log", "a.txt", False, "", False), ("/build", "build", True, "", True), ("/build", "apps/build", True, "", False),
    ("src/generated", "src/generated", True, "", True), ("src/generated", "apps/src/generated", True, "", False), ("dist/", "dist", True, "", True), ("dist/", "dist", False, "", False),
    ("*.log\n!keep.log", "keep.log", False, "", False), ("*.log\n!keep.log", "drop.log", False, "", True), ("*.log\n!keep.log\nkeep.log", "keep.log", False, "", True),
    ("*.log", "services/api/a.log", False, "services/api", True), ("*.log", "services/other/a.log", False, "services/api", False), ("/build", "services/api/build", True, "services/api", True),
    ("/build", "build", True, "services/api", False), ("a?c", "abc", False, "", True), ("a?c", "a/c", False, "", False), ("docs/**/x.md", "docs/x.md", False, "", True), ("docs/**/x.md", "docs/a/b/x.md", False, "", True),
    ("a+b.(c)", "a+b.(c)", False, "", True), ("\n# note\n\n", "note", False, "", False), ("!", "x", False, "", False), ("/", "x", True, "", False),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    """All cases at once, each in a tree of its own."""
    out = {}
    for i, (text, path, folder, base, _) in enumerate(CASES):
        rules = N.ignore_rules(spark.createDataFrame([(base, text)], "base string, contents string"))
        entries = spark.createDataFrame([(path, folder)], "path string, is_folder boolean")
        out[i] = N.decided(entries, rules).isEmpty()
    return out


def test_cases_of_the_format(verdicts):
    wrong = [CASES[i] for i, kept in verdicts.items() if kept == CASES[i][4]]
    assert not wrong


def test_blank_lines_and_comments_are_no_rules(spark):
    assert N.ignore_rules(spark.createDataFrame([("", "\n# a comment\n\n")], "base string, contents string")).count() == 0


def test_an_ignored_folder_ends_all_below_it(spark):
    rules = N.ignore_rules(spark.createDataFrame([("", "out/\n!out/keep.txt\n*.tmp\n!good.tmp"), ("lib", "!x.tmp\nsub"), ("out", "!*")], "base string, contents string"))
    paths = ["out/keep.txt", "out/deep/good.tmp", "a/out/x", "lib/x.tmp", "x.tmp", "good.tmp", "lib/sub/deep/y", "lib/y", "sub/y", None, "out"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    got = {r["path"]: r["by"] for r in N.ignored_files(files, rules).collect()}
    assert got == {
        "out/keep.txt": "out", "out/deep/good.tmp": "out", "a/out/x": "a/out", "lib/x.tmp": None, "x.tmp": "x.tmp", "good.tmp": None, "lib/sub/deep/y": "lib/sub", "lib/y": None, "sub/y": None, None: None, "out": None,
    }
    assert N.ignored_files(files.filter("false"), rules).count() == 0
    assert not any(r["ignored"] for r in N.ignored_files(files, rules.filter("false")).collect())
