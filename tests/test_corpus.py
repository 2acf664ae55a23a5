"""Many projects at once give what each gives alone."""

from pathlib import Path

import pytest

from tests.helpers import make, project
from treelens.plans import corpus
from treelens.plans import project as p
from treelens.sources import tree

TREES = {
    "alpha": {
        "pyproject.toml": project("alpha", ["requests>=2", "PyYAML", "unused-one"], '[dependency-groups]\ndev = ["pytest", "requests"]\n[tool.treelens.ignore]\nTL001 = ["src/alpha/old/**"]\nTL006 = ["src/alpha/*:skip_*"]\n[tool.treelens.severity]\nTL007 = "error"\nTL009 = "off"'),
        "treelens.toml": 'mode = "app"', "src/alpha/__init__.py": "from .sub import one, two", "src/alpha/__main__.py": "import requests\nimport yaml\nfrom alpha import lib\nimport numpy\nimport nowhere_at_all\nfrom alpha.sub import one",
        "src/alpha/lib.py": "def used(): pass\ndef skip_me(): pass\ndef dead(): pass\n", "src/alpha/sub.py": "def one(): pass\ndef two(): pass", "src/alpha/old/x.py": "", "src/alpha/lost.py": "import os", "src/alpha/quiet.py": "# treelens: file-ignore[TL001]\n",
        "tests/test_a.py": "import pytest\nimport alpha.lib as l\nl.used()", "tox.ini": "[testenv]\ncommands = black src\n", "src/alpha/broken.py": "def (", "src/alpha/stub.pyi": "x: int",
    },
    "beta": {
        "pyproject.toml": project("beta", ["attrs"]), "beta/__init__.py": "", "beta/core.py": "import attr\nimport scipy\n", "beta/hidden.py": "", "tests/test_b.py": "import beta.core",
        "requirements-dev.txt": "black\n-r more.txt\n", "more.txt": "mypy", "uv.lock": '[[package]]\nname = "attrs"\ndependencies = [{name = "scipy"}]\n[[package]]\nname = "scipy"\n',
    },
    "gamma": {
        "pyproject.toml": '[tool.uv.workspace]\nmembers = ["packages/*"]\n', "packages/one/pyproject.toml": project("one", ["click"]), "packages/one/src/one/__init__.py": "import click, rich\nimport two", "packages/two/pyproject.toml": project("two"),
        "packages/two/src/two/__init__.py": "import one", "main.py": "import packages.one.src.one\nimport sharedlib", ".gitignore": "gen/\n", "gen/g.py": "", "scripts/run.py": "import one",
    },
    "same": {"pyproject.toml": project("alpha", ["requests"]), "src/alpha/__init__.py": "", "src/alpha/lib.py": "import requests", "src/alpha/__main__.py": "import alpha.other", "src/alpha/other.py": ""},
    "bad": {"pyproject.toml": '[tool.treelens]\nnonsense = 1\n', "a.py": "import os"},
    "none": {"readme.md": "nothing"},
}
SHOWN = [c for c in p.ISSUE if c != "summary"]


@pytest.fixture(scope="module")
def trees(tmp_path_factory) -> Path:
    root = tmp_path_factory.mktemp("trees")
    for name, files in TREES.items():
        make(root / name, files)
        (root / name / "treelens.toml").exists() or name == "bad" or (root / name / ".treelens.toml").write_text("")
    return root


@pytest.mark.parametrize("strict", [False, True])
def test_equal_to_single_runs(spark, trees, strict):
    many = corpus.analyze(spark, tree.scan(spark, str(trees)), strict=strict)
    rows: dict = {}
    for r in many.issues.collect():
        rows.setdefault(r.project, []).append(tuple(r[c] for c in SHOWN))
    fixes: dict = {}
    for r in many.fixes.collect():
        fixes.setdefault(r.project, []).append(tuple(r)[1:])
    for name in ("alpha", "beta", "gamma", "same"):
        alone = p.analyze(spark, trees / name, strict=strict)
        assert sorted(map(str, rows.get(name, []))) == sorted(str(tuple(r[c] for c in SHOWN)) for r in alone.issues.collect()), name
        assert sorted(map(str, fixes.get(name, []))) == sorted(str(tuple(r)) for r in alone.fixes.collect()), name
        if not strict:
            assert {(r.node, r.depth, r.pred) for r in many.reached.where(f"project = '{name}'").collect()} == {tuple(r) for r in alone.reached.collect()}, name
    assert "bad" not in rows and many.facts.where("project = 'bad'").select("fact").collect() == [("error",)]
    assert len({c for r in rows.values() for (c, *_) in r}) >= 8
    assert many.counters["errors"] == 1 and many.counters["skipped"] == 1 and many.counters["parsed"] == many.parsed.count()


def test_cache_parses_only_what_changed(spark, trees, tmp_path):
    at = str(tmp_path / "cache")
    files = tree.scan(spark, str(trees))
    first = corpus.analyze(spark, files, cache=at)
    n = first.counters["parsed"]
    # two equal files of one path, length and time are parsed once
    assert first.counters["fresh"] <= n and first.counters["cached"] == n - first.counters["fresh"]
    again = corpus.analyze(spark, tree.scan(spark, str(trees)), cache=at)
    assert again.counters["fresh"] == 0 and again.counters["cached"] == n and again.counters["errors"] == 1
    assert sorted(map(str, first.issues.collect())) == sorted(map(str, again.issues.collect()))
    (trees / "beta/beta/hidden.py").write_text("import json")
    changed = corpus.analyze(spark, tree.scan(spark, str(trees)), cache=at)
    (trees / "beta/beta/hidden.py").write_text("")
    assert changed.counters["fresh"] == 1 and changed.counters["parsed"] == n
