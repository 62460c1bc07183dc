"""Constraints out of the files that state them."""

import pytest

from graphloom.operators import constraints as K
from graphloom.operators import review as R

FILES = {
    "eslint.config.mjs": """export default [{ settings: { elements: [
  { type: 'domain', pattern: 'packages/domain' }, { type: 'application', pattern: 'packages/application/*' },
  { type: "shell", pattern: "apps/shell" }] } }, { rules: { default: 'disallow', rules: [
  { from: 'application', allow: ['domain'] },
  { from: 'shell', allow: ['application', 'domain'] }] } },
  { files: ['packages/**/*.ts'],
    rules: { 'no-restricted-imports': ['error', { paths: [{ name: 'vscode', message: 'x' }] }] } }]""",
    "ci/scripts/check-peer-http.py": 'import re\nALLOWLIST = ["billing", "auth"]\nCOMPUTED = [x.y, "no"]\nROOT = Path("services/api/")\nP = re.compile(r"https?://peer")\nif bad:\n    sys.exit(1)\n',
    "tools/ci/verify_imports.sh": "glob('apps')\necho new RegExp('import .* from')\n",
    "check-odd.py": "print('hello')\n",
    "packages/app/src/check-things.ts": "const p = /import .*/.test(x)",
    "tests/check-it.py": "re.compile('http')",
    ".github/workflows/ci.yml": "jobs:\n  - run: python ci/scripts/check-peer-http.py --strict\n  - run: python ci/scripts/check-peer-http.py --strict\n  - run: pnpm lint\n  - run: make build\n",
    "docs/adr/0007-local.md": "# ADR-0007: Keep it local\n\nStatus: Accepted\n\nCode in packages/engine and apps/cli (packages/engine again).\n",
    "docs/adr/0008-draft.md": "# ADR-0008: Draft\n\nStatus: Proposed\n\npackages/engine\n",
    "docs/adr/0009-loose.md": "# Loose\n\n## Status\n\nAccepted\n\nNames no path.\n",
    "README.md": "# ADR",
    "null": None,
}


@pytest.fixture(scope="module")
def rows(spark):
    made = K.extracted_constraints(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()
    return made, {(r["path"], r["name"]): r for r in made.collect()}


def test_rules_of_each_shape(rows):
    _, got = rows
    told = list((p, n, r["kind"], r["severity"], r["relation"], tuple(r["scope"]), tuple(r["targets"]), r["subject"], tuple(r["exempt"]), r["line"]) for (p, n), r in got.items())
    lint = "eslint.config.mjs"
    want = list([
        (lint, "application may only depend on domain", "boundary-restriction", "blocking", "ONLY_ALLOWED_TO", ("packages/application/*",), ("packages/domain/**",), None, (), 4),
        (lint, "shell may only depend on application, domain", "boundary-restriction", "blocking", "ONLY_ALLOWED_TO", ("apps/shell/**",), ("packages/application/*", "packages/domain/**"), None, (), 5),
        (lint, "domain may only depend on nothing", "boundary-restriction", "blocking", "ONLY_ALLOWED_TO", ("packages/domain/**",), (), None, (), 1),
        (lint, "packages/**/*.ts must not import vscode", "forbidden-dependency", "blocking", "FORBIDS", ("packages/**/*.ts",), (), "vscode", (), 6),
        ("ci/scripts/check-peer-http.py", "check-peer-http.py: forbidden-runtime-call", "forbidden-runtime-call", "blocking", "FORBIDS", ("services/api/**",), (), "https?://peer", ("billing", "auth"), 5),
        ("tools/ci/verify_imports.sh", "verify_imports.sh: forbidden-dependency", "forbidden-dependency", "warning", "RESTRICTS_DEPENDENCY", ("apps/**",), (), "import .* from", (), 2),
        ("check-odd.py", "check-odd.py", "opaque-check", "warning", "MUST_PASS", ("**",), (), None, (), None),
        (".github/workflows/ci.yml", "CI requires: ci/scripts/check-peer-http.py", "must-pass-check", "blocking", "MUST_PASS", ("**",), (), "python ci/scripts/check-peer-http.py --strict", (), 2),
        (".github/workflows/ci.yml", "CI requires: pnpm lint", "must-pass-check", "blocking", "MUST_PASS", ("**",), (), "pnpm lint", (), 4),
        ("docs/adr/0007-local.md", "Accepted decision: Keep it local", "architecture-guidance", "advisory", "GOVERNS", ("apps/cli/**", "packages/engine/**"), (), None, (), 1),
    ])
    assert sorted(told, key=str) == sorted(want, key=str)


def test_they_feed_the_constraint_check(spark, rows):
    made, _ = rows
    rules, spared = K.checkable(K.merged_constraints(made))
    proposed = spark.createDataFrame([
        ("r1", "http", "services/api/x.py", "orders", None, 90), ("r2", "http", "services/api/y.py", "billing", None, 90), ("r3", "http", "services/web/z.py", "web", None, 90),
        ("r4", "import", "packages/domain/a.ts", "a", "packages/engine/b.ts", 85), ("r5", "import", "apps/shell/c.ts", "c", "packages/domain/d.ts", 85), ("r6", "import", "apps/new/e.ts", "e", None, 90),
    ], "requirement string, mechanism string, source_path string, source_ref string, target_path string, confidence int")
    got = {(r["requirement"], r["constraint"], r["severity"]) for r in R.constraint_findings(proposed, rules, spared).collect()}
    assert ("r1", "check-peer-http.py: forbidden-runtime-call", "blocking") in got
    assert not any(r == "r2" and "peer-http" in c for r, c, _ in got) and not any(r == "r3" for r, _, _ in got)
    assert ("r6", "verify_imports.sh: forbidden-dependency", "warning") in got


def test_the_source_of_most_authority_is_kept(spark):
    row = lambda path, extraction, exempt, scope: (path, "x", "n-" + path, "forbidden-dependency", "blocking", extraction, "FORBIDS", scope, [], "http", exempt, 1)
    schema = "path string, recognizer string, name string, kind string, severity string, extraction string, relation string, scope array<string>, targets array<string>, subject string, exempt array<string>, line int"
    frame = spark.createDataFrame([row("b", "recognized", ["u"], ["p/**", "a/**"]), row("c", "declared", ["v", "u"], ["a/**", "p/**"]), row("d", "opaque", [], ["q/**"])], schema)
    empty = spark.createDataFrame([], "path string, content string")
    every = K.extracted_constraints(empty, frame)
    got = {r["name"]: (r["extraction"], r["severity"], r["sources"], r["exempt"]) for r in K.merged_constraints(every).collect()}
    assert got == {"n-c": ("declared", "blocking", 2, ["u", "v"]), "n-d": ("opaque", "warning", 1, [])}
    assert K.extracted_constraints(empty).count() == 0
