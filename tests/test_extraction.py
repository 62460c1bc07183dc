"""Extraction of requirements from specification texts."""

import random
import re

import duckdb
import pytest

from graphloom import catalog_text  # noqa: F401 (it registers its queries)
from graphloom.catalog import ORACLE_SQL, QUERIES
from graphloom.operators import extraction as E
from graphloom.operators import texts as X
from graphloom.plans import wording as T

LISTED = """Some intro that says what this is about.

# Order export

## Requirements
- The `OrderExporter` must write CSV files
  with a header line
  - nested: quoted fields
- **Retries**: failed uploads should be retried
* FR-2: the api must reject empty orders

1. R3: `OrderStore` keeps rows
2) plain numbered item about DB_URL

```
- not an item
```
### Backend
+ [ ] task with `queueName`

Why we do it at all, in a paragraph
of two lines.

**Acceptance Criteria**
• The `Exporter` finishes under 200 ms

Out of scope
------------
- Importing orders
Explicitly unchanged:
- Deduplication behaviour of `SendJob`
- Nothing else

The lookup must remain unchanged in `Lookup`.

## Constraints
- Java 17 only
## Open questions
1. Who owns the bucket?
## Misc
- a loose bullet
AC-1) labelled even here
"""

PROSE = """# Export
The engine must stop assigning high confidence. Path resolution today anchors paths at the root.
Ranking changes apply to the export as well. It will write rows. Is it fast?

- Add a limit to the exporter
## Background
The system was slow. It must be fast because users wait.
## Non-goals
Things that must not be read.
# Rest
Nothing else should change. The send job must not change behaviour of `SendJob`.
"""


@pytest.fixture(scope="module")
def drafts(spark):
    specs = spark.createDataFrame([("listed", LISTED), ("prose", PROSE), ("none", None), ("empty", ""), ("again", "# Tasks\n- Do `X`\n- do `x`\n- Do `Y`")], "spec string, text string")
    made = E.extracted(specs).cache()
    return specs, made, [r.asDict() for r in made.collect()]


def of(drafts, spec, kind, *columns):
    rows = [r for r in drafts[2] if r["spec"] == spec and r["kind"] == kind]
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in sorted(rows, key=lambda r: (r["start"] is None, r["start"] or 0, r["statement"]))]


def test_lists_of_requirements(drafts):
    got = of(drafts, "listed", "requirement", "statement", "origin", "label", "heading", "intent")
    assert got == [
        ("The `OrderExporter` must write CSV files with a header line - nested: quoted fields", "bullet-item", None, "Requirements", "change"),
        ("Retries: failed uploads should be retried", "bullet-item", None, "Requirements", "change"),
        ("FR-2: the api must reject empty orders", "bullet-item", None, "Requirements", "change"),
        ("`OrderStore` keeps rows", "explicit-label", "R3", "Requirements", "change"),
        ("plain numbered item about DB_URL", "numbered-item", "2", "Requirements", "change"),
        ("task with `queueName`", "task-item", None, "Backend", "change"),
        ("The `Exporter` finishes under 200 ms", "acceptance-criterion", None, "Acceptance Criteria", "change"),
        ("Deduplication behaviour of `SendJob`", "bullet-item", None, "Explicitly unchanged", "preserve"),
        ("labelled even here", "explicit-label", "AC-1", "Misc", "change"),
        ("The lookup must remain unchanged in `Lookup`.", "prose-modal", None, "Explicitly unchanged", "preserve"),
    ]


def test_other_sections(drafts):
    assert of(drafts, "listed", "constraint", "statement") == ["Java 17 only"]
    assert set(of(drafts, "listed", "question", "statement")) == {"Who owns the bucket?", "Nothing else"}
    assert of(drafts, "listed", "non-goal", "statement", "heading") == [("Importing orders", "Out of scope")]
    assert of(drafts, "listed", "context", "statement", "heading") == [("Why we do it at all, in a paragraph of two lines.", "Backend")]


def test_ranges_cut_items_out_of_the_text(drafts):
    flat = lambda s: re.sub(r"\s+", " ", re.sub(r"^\*\*(.+?)\*\*:?\s*", r"\1: ", s)).strip()
    rows = [r for r in drafts[2] if r["spec"] == "listed" and r["start"] is not None]
    assert len(rows) >= 10
    for r in rows:
        assert flat(LISTED[r["start"] : r["end"]]) == r["statement"]


def test_prose_is_read_by_its_signs(drafts):
    got = {r["statement"]: (r["confidence"], r["intent"]) for r in drafts[2] if r["spec"] == "prose" and r["kind"] == "requirement"}
    assert got == {
        "The engine must stop assigning high confidence.": (0.8, "change"), "It will write rows.": (0.55, "change"), "Add a limit to the exporter": (0.65, "change"),
        "It must be fast because users wait.": (0.8, "change"), "The send job must not change behaviour of `SendJob`.": (0.8, "preserve"),
    }
    assert set(of(drafts, "prose", "question", "statement")) == {"Ranking changes apply to the export as well.", "Nothing else should change."}


def test_quality_and_repeats(drafts):
    specs, made, _ = drafts
    got = {r["spec"]: (r["strategy"], r["structured"], r["prose"], r["uncertain"], r["provisional"]) for r in E.quality(specs, made).collect()}
    assert got["listed"][:3] == ("structured", 10, 0) and got["prose"] == ("prose-modal", 0, 5, 1, False)
    assert got["none"] == got["empty"] == ("prose-fallback", 0, 0, 0, False)
    assert of(drafts, "again", "requirement", "statement") == ["Do `X`", "Do `Y`"]


def walked(text):
    """Headings and list items of a text, line by line."""
    lines, heads, found, skip, fence, item = text.split("\n"), [], [], False, False, None
    for i, line in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if skip:
            skip = False
            continue
        if (m := re.match(r"(#{1,6})\s+(.*\S)\s*$", line)) or (line.strip() and re.match(r"(=+|-{3,})\s*$", after) and not re.match(r"([-*+]\s|\d{1,3}[.)]\s)", line.strip())):
            heads.append((m[2], len(m[1])) if m else (line.strip(), 1 if after.startswith("=") else 2))
            skip, fence, item = not m, False, None
            continue
        if line.strip() == "```":
            fence = not fence
            continue
        if fence:
            continue
        if not line.strip():
            item = None
            continue
        indent = len(line) - len(line.lstrip())
        m = re.match(r"(?:[-*+]|\d{1,3}[.)])\s+(?=\S)", line.strip())
        if m and (item is None or indent <= item[0]):
            item = [indent, line.strip()[m.end() :]]
            found.append((len(heads), item))
        elif item is not None:
            item[1] += " " + line.strip()
    return heads, sorted((k, t[1]) for k, t in found if len(t[1]) >= 3)


def test_random_texts_like_a_walk_line_by_line(spark):
    rng = random.Random(7)
    pieces = ["# one title", "### deep title", "plain words", "more", "---", "===", "", "", "- item here", "  - inner item", "    * deep item", "1. first thing", "```", "   wrapped words", "12) twelfth", "-", "- "]
    texts = {f"t{i}": "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for i in range(120)}
    specs = spark.createDataFrame(list(texts.items()), "spec string, text string")
    body = E.sectioned(E.lines_of(specs))
    rows = E.scanned(body)
    got = {k: [] for k in texts}
    for r in E.items(rows).select("spec", "section", "text").collect():
        got[r["spec"]].append((r["section"], r["text"]))
    for k, text in texts.items():
        heads, items = walked(text)
        assert sorted(got[k]) == items, text
    titles = {(r["spec"], r["section"]): (r["heading"], r["level"]) for r in body.select("spec", "section", "heading", "level").distinct().collect()}
    for (spec, n), told in titles.items():
        assert told == (walked(texts[spec])[0][n - 1] if n else ("", 0)), texts[spec]


def test_roles_come_down_from_headings_above(spark):
    text = "# Requirements\n## One\na\n### Two\nb\n# Other\nc\n## Non-goals\nd\n#### Deep\ne\n## Plain\nf\n**Tasks**\ng\n# Scope:\nh"
    rows = E.sectioned(E.lines_of(spark.createDataFrame([("s", text)], "spec string, text string"))).collect()
    assert {r["line"]: r["role"] for r in rows} == {"a": "requirements", "b": "requirements", "c": "unknown", "d": "non-goals", "e": "non-goals", "f": "unknown", "g": "tasks", "h": "goals"}


def test_concepts_of_all_kinds(spark):
    text = "Use `Order Line`, UserService and notification.nda_request, DB_PASSWORD with order-sync, the billing api but not the service, in packages/domain, ci/check.py, and/or e.g. v1.2.3 http://a.b/c"
    row = spark.createDataFrame([(text,)], "t string").select(X.concepts(X.F.col("t")).alias("c")).first()
    assert row["c"] == ["Order Line", "UserService", "notification.nda_request", "check.py", "a.b", "DB_PASSWORD", "order-sync", "billing api", "packages/domain", "ci/check.py"]


@pytest.mark.parametrize("name", ["extracted_drafts", "extracted_ranges", "extraction_quality"])
def test_labels_of_long_numbers(spark, tmp_path, name):
    rows = [(k, f"Supplier#{k:09}", 1, 0.5) for k in (997, 998, 999, 1000, 1001, 1002, 59_999, 60_000, 360_001)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(str(r[c]) for c in want.columns) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_labels_of_long_numbers_are_asked_for(spark):
    specs = spark.createDataFrame([("s", "# About\nFR-1000: `store` could sort\n")], "spec string, text string")
    told = lambda df: [(r["kind"], r["label"]) for r in df.filter("label is not null").collect()]
    assert told(E.extracted(specs)) == [] and told(E.extracted(specs, T.LONG_LABEL)) == [("requirement", "FR-1000")]
