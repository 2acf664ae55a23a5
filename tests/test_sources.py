import io
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.helpers import make, project
from treelens.sources import config as c
from treelens.sources import dims, plugins, pyast, tree, wheels
from treelens.sources import requirements as r


def names(m, kind=None):
    return [d.name for d in m.dependencies if kind in (None, d.kind)]


def test_root_is_the_nearest_marker(tmp_path):
    make(tmp_path, {"requirements.txt": "", "setup.py": "", "sub/pyproject.toml": "", "sub/deep/x.py": ""})
    assert c.find_root(tmp_path) == (tmp_path.resolve(), "setup.py")
    assert c.find_root(tmp_path / "sub/deep")[1] == "pyproject.toml"


def test_config_layers_and_errors(tmp_path):
    make(tmp_path, {".treelens.toml": 'mode = "app"\nexclude = ["x/**"]\n[plugins]\nflask = true', "treelens.toml": 'mode = "library"\n[dependencies]\ndev_groups = ["q"]', "pyproject.toml": '[tool.treelens]\nproduction = true\n[tool.treelens.severity]\nTL001 = "off"'})
    config, used = c.load(tmp_path)
    assert used == [".treelens.toml", "treelens.toml", "pyproject.toml"]
    assert (config.mode, config.production, config.exclude, config.severity) == ("library", True, ("x/**",), {"TL001": "off"})
    assert config.plugins["flask"] and config.plugins["pytest"] and config.dependencies["dev_groups"] == ["q"] and config.dependencies["type_groups"]
    assert config.excluded().count(".venv/**") == 1 and c.merge(config, {}) == config
    for bad in ({"nope": 1}, {"mode": "x"}, {"entry": ["/abs.py"]}, {"entry": ["a:b:c"]}, {"exclude": "x"}, {"severity": {"TL999": "off"}}, {"severity": {"TL001": "loud"}}, {"plugins": {"zope": True}}, {"target_version": "py39"}, {"workspaces": {"a": {}}}, {"project": ["../x"]}, {"dependencies": {"x": []}}):
        with pytest.raises(c.ConfigError):
            c.check(bad)


def test_pyproject_tables(tmp_path):
    make(tmp_path, {"pyproject.toml": """
[project]
name = "Acme"
requires-python = ">=3.10"
dependencies = ["Requests[socks]>=2; python_version<'4'", "a @ https://x/y.whl", "??", 3]
[project.optional-dependencies]
dev = ["Black"]
[project.scripts]
run = "acme.main:go"
[project.entry-points."x.y"]
p = "acme.plug"
[dependency-groups]
test = ["pytest", {include-group = "x"}]
[tool.poetry.dependencies]
python = "^3"
Django = {version = "4", extras = ["bcrypt"]}
[tool.poetry.group.docs.dependencies]
sphinx = "*"
[tool.pdm.dev-dependencies]
lint = ["ruff"]
[tool.hatch.envs.default]
dependencies = ["coverage"]
"""})
    m = r.extract(tmp_path)
    assert names(m, "runtime") == ["requests", "a", "django"] and names(m, "optional") == ["black"]
    assert [(d.name, d.label) for d in m.dependencies if d.kind == "group"] == [("pytest", "test"), ("sphinx", "docs"), ("ruff", "lint"), ("coverage", "dev")]
    first = m.dependencies[0]
    assert (first.extras, first.marker, first.specifier) == (("socks",), "python_version<'4'", ">=2")
    assert ("run", "acme.main:go", "console", "pyproject.toml") in m.entry_points and ("p", "acme.plug", "x.y", "pyproject.toml") in m.entry_points
    assert len(m.warnings) == 1 and r.target_minor(None, m.metadata["requires-python"]) == 10
    make(tmp_path, {"pyproject.toml": '[project]\ndynamic = ["dependencies"]\ndependencies = ["x"]'})
    assert names(r.extract(tmp_path)) == []
    make(tmp_path, {"pyproject.toml": "[broken"})
    with pytest.raises(ValueError):
        r.extract(tmp_path)


def test_setup_files(tmp_path):
    make(tmp_path, {"setup.cfg": "[metadata]\nname = acme\n[options]\ninstall_requires =\n    requests\n    # no\n    six>=1\n[options.extras_require]\nfast = ujson\n", "setup.py": "from setuptools import setup\nreqs = []\nsetup(name='other', install_requires=['attrs', x], extras_require={'t': ['pytest']})\nimport os; os.abort()"})
    m = r.extract(tmp_path)
    assert names(m, "runtime") == ["requests", "six", "attrs"] and names(m, "setup_extra") == ["ujson", "pytest"]
    assert any("partially" in w for w in m.warnings) and any("acme" in w for w in m.warnings)


def test_requirement_files(tmp_path):
    make(tmp_path, {"requirements.txt": "﻿Flask==1 # why\n-r more/requirements-docs.txt\n-c cons.txt\n-e git+https://x/y#egg=Egg\n-e .\n--hash=x\n\n# c\nhttps://a/b.whl\nbad==\\\n", "more/requirements-docs.txt": "sphinx\n", "cons.txt": "pin==1\n", "requirements-dev.txt": "black\r\n"})
    m = r.extract(tmp_path)
    assert names(m, "runtime") == ["flask", "egg", "", "", "bad"] and [d.name for d in m.constraints] == ["pin"]
    assert [(d.name, d.label) for d in m.dependencies if d.kind == "group"] == [("sphinx", "docs"), ("black", "dev")]
    make(tmp_path, {"setup.cfg": "[options]\ninstall_requires = x\n"})
    assert ("flask", "group") in [(d.name, d.kind) for d in r.extract(tmp_path).dependencies]
    make(tmp_path, {"requirements.txt": "-r a.txt", "a.txt": "-r requirements.txt"})
    with pytest.raises(ValueError, match="include each other"):
        r.extract(tmp_path)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_specifications_never_crash(text):
    found = r.parse_spec(text)
    assert found is None or found.opaque or found.name == r.normalize(found.name)


def test_lock_file(tmp_path):
    make(tmp_path, {"uv.lock": '[[package]]\nname = "A_b"\ndependencies = [{name = "X.y"}]\n[[package]]\nname = "a-b"\ndependencies = [{name = "z"}]\n'})
    assert r.extract(tmp_path).lock == [("a-b", "z")]


def test_layouts_and_walk(tmp_path):
    assert tree.infer_layout(make(tmp_path / "a", {"src/acme/__init__.py": ""}), None).kind == "src"
    flat = make(tmp_path / "b", {"one/__init__.py": "", "two/__init__.py": "", "tests/__init__.py": ""})
    assert tree.infer_layout(flat, "Two").packages == ["two"] and tree.infer_layout(flat, None).warnings
    assert tree.infer_layout(make(tmp_path / "d", {"x.py": ""}), None).kind == "unknown"
    root = make(tmp_path / "c", {"a.py": "", "b.PYI": "", "n.ipynb": "", "x.txt": "", ".venv/v.py": "", "build/x.py": "", "p/__pycache__/q.py": "", "gen/g.py": "", ".gitignore": "gen/\n", "tests/t.py": "", "sub/build/ok.py": ""})
    config = c.Config()
    assert tree.walk(root, config) == ["a.py", "b.PYI", "n.ipynb", "sub/build/ok.py", "tests/t.py"]
    assert "gen/g.py" in tree.walk(root, c.merge(config, {"respect_gitignore": False}))
    production = tree.walk(root, c.merge(config, {"production": True}))
    assert set(production) < set(tree.walk(root, config)) and "tests/t.py" not in production
    assert tree.walk(root, config, ["*.py"]) == ["a.py", "sub/build/ok.py", "tests/t.py"]


def test_scan_of_many_trees(spark, tmp_path):
    files = {"one/src/__init__.py": "", "one/src/a.py": "import x", "two/tests/b.py": "", "two/.gitignore": "gen/", "two/readme.md": ""}
    make(tmp_path, files)
    rows = tree.scan(spark, str(tmp_path)).collect()
    # empty files, and those whose names begin with _ or a dot, are there too
    assert {f"{x.project}/{x.path}": bytes(x.content).decode() for x in rows} == files and all(x.length == len(x.content) and x.modified > 10**15 for x in rows)


def test_trees_in_archives(spark, tmp_path):
    inside = {"acme-1.0/src/__init__.py": b"", "acme-1.0/setup.py": b"x = 1"}
    with tarfile.open(tmp_path / "acme-1.0.tar.gz", "w:gz") as t:
        for name, data in inside.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "flat.whl", "w") as z:
        z.writestr("a.py", "1")
        z.writestr("b/_c.py", "2")
    whole = (tmp_path / "acme-1.0.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no.zip").write_bytes(b"PK no archive")
    rows = {(x.project, x.path): bytes(x.content) for x in tree.unpacked(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in rows.items() if k[0] in ("acme-1.0", "flat")} == {("acme-1.0", "src/__init__.py"): b"", ("acme-1.0", "setup.py"): b"x = 1", ("flat", "a.py"): b"1", ("flat", "b/_c.py"): b"2"}


SOURCE = '''"""Doc."""
# treelens: file-ignore[TL006]
import os, a.b as ab
from typing import TYPE_CHECKING as TC
from . import sibling
from .sub import thing as t, _hidden
from ..beyond import x
from m import *
import importlib, sys
if TC:
    from only import types
try:
    import fast
except ImportError:
    import slow
if sys.platform == "win32":
    import winreg  # treelens: ignore[TL010]
else:
    import posix
__all__ = ["f", "_g"]
V: int = 1
A, B = 1, 2
importlib.import_module("dyn.mod")
importlib.import_module(name)
@app.route("/x")
def f():
    import inner
    return ab.call(os.path.join("a"))
def _g(): pass
class K: pass
match V:
    case 1:
        W = 2
'''


def test_parsing():
    m = pyast.parse("src/acme/pkg/mod.py", SOURCE.encode())
    found = {(i["module"], i["name"]): i for i in m["imports"]}
    assert m["module"] == "acme.pkg.mod"
    assert ("a.b", None) in found and found[("a.b", None)]["alias"] == "ab"
    assert ("acme.pkg.sibling", None) in found and ("acme.pkg.sub", "thing") in found and ("acme.beyond", "x") in found
    assert not any(k[0] == "m" for k in found) and ("inner", None) in found
    assert found[("only", "types")]["context"] == "type" and found[("fast", None)]["optional"] and not found[("slow", None)]["optional"]
    assert found[("winreg", None)]["platform_guarded"] and not found[("posix", None)]["platform_guarded"]
    assert m["dynamic_imports"] == [{"module": "dyn.mod", "line": 23}] and m["has_opaque_dynamic_import"]
    public = {x["name"]: x for x in m["symbols"]}
    assert set(public) == {"V", "A", "B", "f", "_g", "K", "W"} and public["_g"]["is_public"] and public["f"]["decorators"] == ["app.route"]
    assert {(a["receiver"], a["name"]) for a in m["attribute_accesses"]} >= {("ab", "call"), ("os.path", "join"), ("os", "path")}
    assert [(d["file_level"], d["codes"], d["line"]) for d in m["ignores"]] == [(False, ["TL010"], 17)] or m["ignores"][0]["file_level"] is False


def test_odd_sources():
    assert pyast.parse("a.py", b"def (:\n# treelens: ignore[TL001]")["diagnostics"][0]["severity"] == "error"
    for text in (b"", None, b"\xff\x00", "﻿import a\r\n".encode(), b"x = " + b"(" * 5000):
        assert pyast.parse("a.py", text)["path"] == "a.py"
    assert [i["module"] for i in pyast.parse("a.py", "﻿import a\r\n".encode())["imports"]] == ["a"]
    note = '{"cells": [{"cell_type": "code", "source": ["import a\\n", "import b"]}, {"cell_type": "markdown", "source": "import c"}, {"cell_type": "code", "source": "import d"}]}'
    assert [i["module"] for i in pyast.parse("n.ipynb", note.encode())["imports"]] == ["a", "b", "d"]
    assert pyast.parse("n.ipynb", b"no json")["diagnostics"][0]["severity"] == "warning"
    only = "# treelens: file-ignore[TL001]\nx = 1  # treelens: file-ignore[TL002]\n"
    assert [d["codes"] for d in pyast.directives(only)] == [["TL001"]]


def test_environment_and_dims(tmp_path):
    info = ".venv/lib/python3.11/site-packages/"
    make(tmp_path, {info + "Py_X-1.dist-info/METADATA": "Name: Py_X\nVersion: 1\n\nName: no", info + "Py_X-1.dist-info/top_level.txt": "xmod\n_private\n", info + "Py_X-1.dist-info/entry_points.txt": "[console_scripts]\nxrun = x:y\n[other]\nz = q", info + "rec-1.dist-info/METADATA": "Name: rec\n", info + "rec-1.dist-info/RECORD": "recmod/__init__.py,,\nsingle.py,,\nrec-1.dist-info/METADATA,,\n", info + "imp-1.dist-info/METADATA": "Name: imp\nImport-Name: impmod.sub\n"})
    imports, binaries = dims.installed(tmp_path)
    assert imports == [("impmod", "imp"), ("recmod", "rec"), ("single", "rec"), ("xmod", "py-x")] and binaries == [("xrun", "py-x")]
    assert "tomllib" in dims.stdlib(11) and "tomllib" not in dims.stdlib(10) and "distutils" in dims.stdlib(11) and "distutils" not in dims.stdlib(12) and "os" in dims.stdlib(13)
    assert ("yaml", "pyyaml") in dims.bundled()


def test_wheels(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x-1-py3-none-any.whl", "w") as z:
        z.writestr("xmod/__init__.py", "")
        z.writestr("single.py", "")
        z.writestr("X_y-1.dist-info/METADATA", "Name: X_y\nVersion: 1\n\n")
    (tmp_path / "bad.whl").write_bytes(b"no zip")
    rows = sorted((x.distribution, x.import_root) for x in wheels.harvest(spark, str(tmp_path)).collect())
    assert rows == [("x-y", "single"), ("x-y", "xmod")]


def hints(root, enabled=(), files=None):
    config = c.merge(c.Config(), {"plugins": {p: True for p in enabled}})
    return plugins.collect(root, config, r.extract(root), tree.walk(root, config))


def test_plugins(tmp_path):
    root = make(tmp_path, {
        "pyproject.toml": project(more='[project.scripts]\nweb = "uvicorn acme.web:app"\nwork = "celery -A acme.tasks worker"\n[tool.pytest.ini_options]\ntestpaths = ["checks"]\n[tool.mypy]\n'),
        "checks/test_a.py": "", "conftest.py": 'pytest_plugins = ["acme.fixtures"]', "manage.py": 'os.environ.setdefault("DJANGO_SETTINGS_MODULE", "site.settings")',
        "site/settings.py": 'INSTALLED_APPS = ["shop", "x.apps.XAppConfig"]\nROOT_URLCONF = "site.urls"\nWSGI_APPLICATION = "site.wsgi.application"\nASGI_APPLICATION = "site.asgi:app"', "site/urls.py": "",
        "main.py": "", ".flaskenv": "FLASK_APP=acme.flaskapp:app", "src/acme/views.py": '@bp.route("/")\ndef x(): pass', "src/acme/jobs.py": "@shared_task\ndef x(): pass",
        ".github/workflows/ci.yml": "jobs:\n  a:\n    steps:\n      - run: |\n          ruff check .\n          python -m build\n      - run: pytest -q\n", "tox.ini": "[testenv]\ndeps =\n    hypothesis>=1\ncommands = flake8 x\n", ".pre-commit-config.yaml": "repos:\n- hooks:\n  - id: black\n",
        "docs/conf.py": 'extensions = ["sphinx.ext.x", "myst_parser"]', "mkdocs.yml": "theme:\n  name: material\nplugins:\n  - search\n  - redirects:\n      x: y\n", "alembic.ini": "", "alembic/env.py": "", "scripts/go.sh": "twine upload\n# black\n",
    })
    h = hints(root, plugins.ALL)
    assert {(p, m) for p, m, _ in h.modules} >= {("pytest", "acme.fixtures"), ("django", "site.settings"), ("django", "shop"), ("django", "x"), ("django", "site.urls"), ("flask", "acme.views"), ("celery", "acme.jobs"), ("celery", "acme.tasks"), ("sphinx", "myst_parser")}
    assert {(p, m, s) for p, m, s, _ in h.symbols} >= {("fastapi", "acme.web", "app"), ("django", "site.asgi", "app"), ("flask", "acme.flaskapp", "app")} and not any(s == "application" for _, _, s, _ in h.symbols)
    assert {(p, x) for p, x, *_ in h.entries} >= {("pytest", "checks/test_a.py"), ("pytest", "conftest.py"), ("django", "manage.py"), ("django", "site/urls.py"), ("fastapi", "main.py"), ("sphinx", "docs/conf.py"), ("alembic", "alembic/env.py")}
    assert {b for _, b, _, _ in h.binaries} >= {"pytest", "uvicorn", "celery", "tox", "pre-commit", "ruff", "build", "sphinx-build", "mkdocs", "alembic", "mypy", "black", "flake8", "twine"}
    assert {"hypothesis", "mkdocs-material", "mkdocs-redirects"} <= set(h.distributions) and h.globs == ["**/migrations/**/*.py"]
    nothing = hints(make(tmp_path / "none", {"pyproject.toml": project(), "src/acme/__init__.py": ""}))
    assert not (nothing.entries or nothing.modules or nothing.binaries)


def test_run_commands():
    text = "a:\n  - run: one\n  - name: x\n    run: >-\n      two\n\n      three\n  - uses: y\n  - run: 'four'\n"
    assert plugins.run_commands(text) == [(2, "one"), (5, "two"), (7, "three"), (9, "four")]


def test_workspace_members(tmp_path):
    root = make(tmp_path, {"pyproject.toml": '[tool.uv.workspace]\nmembers = ["libs/*"]\n[tool.treelens.workspaces.svc]\npath = "libs/b"\n[tool.treelens.workspaces.own]\npath = "apps/own"', "libs/a/pyproject.toml": "", "libs/b/pyproject.toml": "", "libs/.venv/pyproject.toml": "", "other/pyproject.toml": ""})
    m = r.extract(root)
    config, _ = c.load(root, m.pyproject)
    assert [(x.id, x.path, x.source) for x in c.members(root, config, m.pyproject)] == [("own", "apps/own", "treelens"), ("a", "libs/a", "uv"), ("svc", "libs/b", "treelens")]
