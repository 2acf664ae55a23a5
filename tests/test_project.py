import json

import pytest

from tests.helpers import make, project
from treelens import cli
from treelens.plans import project as p
from treelens.sinks import fixes, reports


def codes(report, code=None):
    rows = report.issues.where("disposition is null").collect()
    return {(r.code, r.name or r.module or r.path): r for r in rows if code in (None, r.code)}


def run(spark, root, **how):
    return p.analyze(spark, root, **how)


def test_chain_dynamic_and_unused_files(spark, tmp_path):
    root = make(tmp_path, {
        "pyproject.toml": project(), "src/acme/__init__.py": "", "src/acme/__main__.py": "from acme import a\nimport acme.b", "src/acme/b.py": "import importlib\nimportlib.import_module('acme.plug')\nfrom . import c",
        "src/acme/c.py": "import acme.b", "src/acme/plug.py": "", "src/acme/legacy.py": "importlib.import_module(x)", "src/acme/a.py": "", "tests/test_x.py": "import acme.t", "src/acme/t.py": "",
    })
    make(root, {"treelens.toml": 'mode = "app"'})
    r = run(spark, root)
    assert r.mode == "app"
    found = codes(r, "TL001")
    # importing a name of a package reaches the package only
    assert {k[1] for k in found} == {"src/acme/legacy.py", "src/acme/a.py"}
    assert found[("TL001", "src/acme/legacy.py")].confidence == "likely" and found[("TL001", "src/acme/a.py")].severity == "error"
    depth = {x.node: x.depth for x in r.reached.collect()}
    assert depth["src/acme/__main__.py"] == 0 and depth["src/acme/b.py"] == 1 and depth["src/acme/plug.py"] == 2 == depth["src/acme/c.py"]
    assert p.trace(r, "src/acme/plug.py") == ["src/acme/plug.py is reached", "  src/acme/plug.py", "  <- src/acme/b.py", "  <- src/acme/__main__.py"]
    assert p.trace(r, "src/acme/a.py")[0] == "src/acme/a.py is not reached"
    production = run(spark, root, production=True)
    assert ("TL001", "src/acme/t.py") in codes(production)


def test_entries_shrink_what_is_reached(spark, tmp_path):
    files = {"src/acme/__init__.py": "", "src/acme/one.py": "def go(): pass", "src/acme/two.py": ""}
    root = make(tmp_path, files | {"pyproject.toml": project(more='[project.scripts]\na = "acme.one:go"\nb = "acme.two"')})
    both = {x.node for x in run(spark, root).reached.collect()}
    make(root, {"pyproject.toml": project(more='[project.scripts]\na = "acme.one:go"')})
    one = {x.node for x in run(spark, root).reached.collect()}
    assert one < both and both - one == {"src/acme/two.py"}


def test_library_mode(spark, tmp_path):
    root = make(tmp_path, {"pyproject.toml": project(), "src/acme/__init__.py": "from acme import x", "src/acme/x.py": "", "tests/test_x.py": "import acme", "tests/util.py": ""})
    r = run(spark, root, confidence="maybe")
    found = codes(r, "TL001")
    assert r.mode == "library" and {k[1] for k in found} == {"src/acme/x.py"} and {x.confidence for x in found.values()} == {"maybe"}


def test_symbols(spark, tmp_path):
    root = make(tmp_path, {
        "pyproject.toml": project(), "treelens.toml": 'mode = "app"', "src/acme/__init__.py": "from .sub import foo\nfrom .sub import bar as kept", "src/acme/sub.py": "def foo(): pass\ndef bar(): pass",
        "src/acme/__main__.py": "from acme.utils import helper\nimport acme.utils as u\nimport acme\nu.by_attr()\nacme.kept()\nfrom acme.sub import foo, bar\nimport notarealpkg\nimport acme.fix",
        "src/acme/utils.py": "__all__ = ['listed']\ndef helper(): pass\ndef by_attr(): pass\ndef dead(): pass\ndef listed(): pass\ndef _own(): pass", "src/acme/fix.py": "@pytest.fixture\ndef fix(): pass",
    })
    r = run(spark, root, confidence="maybe")
    found = codes(r)
    assert {k[1] for k in found if k[0] == "TL006"} == {"dead", "listed"}
    assert found[("TL006", "listed")].confidence == "certain" and found[("TL006", "dead")].confidence == "likely" and found[("TL006", "dead")].severity == "warning"
    assert {k[1] for k in found if k[0] == "TL007"} == {"foo"}
    assert {k[1] for k in found if k[0] == "TL010"} == {"notarealpkg"}


DEPS = {
    "src/acme/__init__.py": "",
    "src/acme/__main__.py": "import requests, urllib3, multipart, pytest\nimport os, acme.own\ntry:\n    import brotli\nexcept ImportError: pass\nimport sys\nif sys.platform == 'win32':\n    import tzdata\nimport yaml",
    "src/acme/own.py": "", "tests/test_a.py": "import boto3", "treelens.toml": 'mode = "app"\nconfidence = "maybe"\n[plugins]\npre_commit = true', ".pre-commit-config.yaml": "repos: []",
    "uv.lock": '[[package]]\nname = "requests"\ndependencies = [{name = "urllib3"}]\n',
    "pyproject.toml": project(deps=["requests", "python-multipart", "unused-one", "acme", "brotli", "pywin32; sys_platform=='win32'", "mypy"], more='[tool.mypy]\n[dependency-groups]\ndev = ["pytest", "requests", "idle-dev"]'),
}


def test_dependencies(spark, tmp_path):
    root = make(tmp_path, DEPS)
    found = codes(run(spark, root))
    of = lambda c: {k[1] for k in found if k[0] == c}
    assert of("TL002") == {"unused-one"} and found[("TL002", "unused-one")].severity == "error" and found[("TL002", "unused-one")].confidence == "certain"
    assert of("TL003") == {"yaml", "tzdata"} and found[("TL003", "yaml")].severity == "error" and found[("TL003", "yaml")].summary.split()[0] == "pyyaml"
    guarded = found[("TL003", "tzdata")]
    assert (guarded.severity, guarded.confidence) == ("info", "likely") and "platform-guarded" in guarded.message
    assert of("TL004") == {"urllib3"} and of("TL005") == {"pytest"} and of("TL008") == {"pre-commit"} and of("TL009") == {"requests"}
    assert "runtime" in found[("TL009", "requests")].message and "dev" in found[("TL009", "requests")].message
    strict = codes(run(spark, root, strict=True))
    assert {k[1] for k in strict if k[0] == "TL002"} == {"unused-one", "pywin32", "idle-dev"} and strict[("TL002", "pywin32")].confidence == "likely"
    assert ("TL003", "boto3") in strict and ("TL003", "boto3") not in found


def test_workspaces(spark, tmp_path):
    root = make(tmp_path, {"pyproject.toml": project(deps=["requests"], more='[tool.uv.workspace]\nmembers = ["libs/*"]'), "libs/api/pyproject.toml": project("api", deps=["six"], more='[dependency-groups]\ndev = ["pytest"]'), "libs/api/__main__.py": "import requests\nimport pytest\nimport six", "treelens.toml": 'mode = "app"'})
    assert not [k for k in codes(run(spark, root)) if k[0] == "TL003"]
    strict = codes(run(spark, root, strict=True))
    assert "workspace member api" in strict[("TL003", "requests")].message and ("TL005", "pytest") in strict


def test_ignores_and_baseline(spark, tmp_path):
    root = make(tmp_path, {"pyproject.toml": project(deps=["one", "two"]), "treelens.toml": 'mode = "app"\n[ignore]\nTL002 = ["o*"]\n[severity]\nTL010 = "off"', "src/acme/__init__.py": "", "src/acme/__main__.py": "import yaml  # treelens: ignore[TL003]\nimport zzz", "src/acme/gone.py": "# treelens: file-ignore[TL001]\n", "src/acme/left.py": ""})
    r = run(spark, root)
    assert set(codes(r)) == {("TL002", "two"), ("TL001", "src/acme/left.py")}
    assert {(x.code, x.disposition) for x in r.issues.where("disposition is not null").collect()} == {("TL002", "config"), ("TL003", "inline"), ("TL001", "file")}
    base = ["--baseline", "known.json"]
    assert cli.main([str(root), *base, "--update-baseline", "--reporter", "compact"], spark) == 0
    saved = json.loads((root / "known.json").read_text())
    assert {i["fingerprint"] for i in saved["issues"]} == {"TL002:two", "TL001:src/acme/left.py"} and saved["generated_at"].startswith("unix:")
    make(root, {"src/acme/new.py": ""})
    assert cli.main([str(root), *base], spark) == 1
    assert cli.main([str(root), "--baseline", "../out.json", "--update-baseline"], spark) == 2


def test_reports(spark, tmp_path, capsys):
    root = make(tmp_path, DEPS)
    r = run(spark, root, exclude=["TL006"])
    found, c = reports.rows(r.issues), reports.Context("acme", [], r.mode)
    for name, write in reports.REPORTERS.items():
        out = write(found, c)
        assert "unused-one" in out, name
        if name == "json":
            data = json.loads(out)
            assert data["summary"]["total"] == len(data["issues"]) == sum(data["summary"]["by_code"].values())
            keys = [(i["code"]) for i in data["issues"]]
            assert keys == sorted(keys) and data["issues"][0]["fingerprint"].startswith(data["issues"][0]["code"] + ":")
        if name == "sarif":
            data = json.loads(out)["runs"][0]
            assert len(data["tool"]["driver"]["rules"]) == 10 and data["results"][0]["partialFingerprints"]
        if name == "github":
            assert "::error " in out and "::notice " in out and "title=TL002 unused-one" in out
    assert cli.main([str(root), "--no-exit-code", "--include", "TL002", "--explain", "TL002:unused-one", "--trace", "src/acme/own.py"], spark) == 0
    err = capsys.readouterr().err
    assert "unused-one is declared in" in err and "src/acme/own.py is reached" in err
    assert cli.main([str(root), "--probe"], spark) == 0 and json.loads(capsys.readouterr().out)["kinds"] == {"python": 4}
    for bad in (["--dry-run"], ["--update-baseline"], ["--init", "--probe"], ["--init", "--strict"]):
        assert cli.main([str(root), *bad], spark) == 2


def test_escapes():
    r = {"code": "TL003", "severity": "info", "confidence": "likely", "kind": "import", "path": "a,b.py", "module": "m", "name": None, "line": 3, "message": "50%\n|x", "manifest_file": None, "manifest_label": None, "target": "t", "fingerprint": "TL003:t", "member": None}
    c = reports.Context()
    assert reports.github([r], c) == "::notice file=a%2Cb.py,line=3,title=TL003 m::50%25%0A|x\n"
    assert "\\|x" in reports.markdown([r], c) and "_No issues found._" in reports.markdown([], c) and "no issues" in reports.compact([], c)


def test_fixes(spark, tmp_path, capsys):
    root = make(tmp_path, DEPS | {"src/acme/dead.py": ""})
    before = (root / "pyproject.toml").read_text()
    cli.main([str(root), "--fix", "--dry-run"], spark)
    assert (root / "pyproject.toml").read_text() == before
    cli.main([str(root), "--fix", "--add-missing", "--allow-remove-files"], spark)
    after = (root / "pyproject.toml").read_text()
    assert "unused-one" not in after and "pyyaml" in after and not (root / "src/acme/dead.py").exists()
    import tomllib

    data = tomllib.loads(after)
    assert "pytest" in data["project"]["dependencies"] and data["dependency-groups"]["dev"] == ["idle-dev"]
    left = {k for k in codes(run(spark, root)) if k[0] in ("TL001", "TL002", "TL005", "TL009")}
    assert left == set()


def test_edits_keep_the_rest():
    text = '[project]\ndependencies = [\n    "a>=1",  # why\n    "b[x]",\n    "c"\n]\n[tool.x]\ndependencies = ["b"]\n'
    new, item = fixes.drop_from_array(text, "project", "dependencies", "b")
    assert item == '"b[x]"' and new == text.replace('    "b[x]",\n', "")
    assert fixes.drop_from_array(text, "project", "dependencies", "zz") == (text, None)
    one = '[project]\ndependencies = ["a", "b", "c"]\n'
    assert fixes.drop_from_array(one, "project", "dependencies", "b")[0] == '[project]\ndependencies = ["a", "c"]\n'
    assert fixes.drop_from_array(one, "project", "dependencies", "c")[0] == '[project]\ndependencies = ["a", "b"]\n'
    assert fixes.add_to_array('[project]\ndependencies = []\n', "project", "dependencies", '"z"') == '[project]\ndependencies = ["z"]\n'
    assert fixes.drop_line("a==1\nB_x>2 # c\n-r o.txt\n", "b-x") == "a==1\n-r o.txt\n"
    poetry = '[tool.poetry.dependencies]\npython = "^3"\nDjango = "4"\n[x]\ny = 1\n'
    assert fixes.edited(poetry, "pyproject.toml", "tool.poetry.dependencies", "django")[0] == '[tool.poetry.dependencies]\npython = "^3"\n[x]\ny = 1\n'


def test_init(tmp_path):
    make(tmp_path, {"pyproject.toml": project()})
    fixes.init(tmp_path)
    from treelens.sources import config

    assert config.load(tmp_path)[1] == ["pyproject.toml"]
    with pytest.raises(ValueError):
        fixes.init(tmp_path)
