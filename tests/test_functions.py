import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelens.functions import globs
from treelens.functions import scalars as s
from treelens.sources.pyast import file_module, relative
from treelens.sources.requirements import normalize
from treelens.sources.tree import context


def values(spark, f, rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(f).collect()]


def test_names(spark):
    names = ["A__b..C", "-x-", "Zope.Interface", "É_x", ""]
    got = values(spark, s.normalize_name(F.col("x")), names)
    assert got == ["a-b-c", "-x-", "zope-interface", "É-x", ""] == [normalize(n) for n in names]
    assert values(spark, s.import_root(F.col("x")), ["a.b.c", "a", ""]) == ["a", "a", ""]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_normalising_twice_changes_nothing(name):
    once = normalize(name)
    assert normalize(once) == once and "_" not in once and not re.search("[A-Z]|--", once)


def test_modules_of_files(spark):
    paths = ["src/acme/__init__.py", "src/acme/a.py", "acme/b.py", "other/c.py", "src/x.ipynb", "setup.py", "src/__init__.py"]
    f = lambda layout, packages=(): values(spark, s.index_module(F.col("x"), layout, list(packages)), paths)
    assert f("src") == ["acme", "acme.a", None, None, None, None, None]
    assert f("flat", ["acme"]) == [None, None, "acme.b", None, None, None, None]
    assert f("unknown", ["acme"]) == ["acme", "acme.a", "acme.b", None, None, None, None]
    got = values(spark, s.parser_module(F.col("x"), "src"), paths)
    assert got[:4] == ["acme", "acme.a", "acme.b", "other.c"] == [file_module(p, "src") for p in paths[:4]]


def test_relative_imports(spark):
    rows = [("a.b.c", False, 1, "x", "y"), ("a.b.c", False, 2, None, "y"), ("a.b", True, 1, None, "y"), ("a", False, 1, "x", None), ("a.b.c", False, 9, "x", None), ("a.b.c", False, 1, None, None), ("", False, 1, "x", None)]
    cols = [F.col(c) for c in ("m", "i", "l", "s", "n")]
    got = values(spark, s.relative_module(*cols), rows, "m string, i boolean, l int, s string, n string")
    assert got == ["a.b.x", "a.y", "a.b.y", None, None, "a.b", None] == [relative(*r) for r in rows]


def test_contexts(spark):
    paths = ["tests/x.py", "src/tests/x.py", "a/conftest.py", "a/Test_x.PY", "a/x_test.py", "docs/conf.py", "scripts/a.py", "noxfile.py", "a/noxfile.py", "test_x.txt"]
    expected = ["test", "runtime", "test", "test", "test", "docs", "dev", "dev", "runtime", "runtime"]
    assert values(spark, s.file_context(F.col("x")), paths) == expected == [context(p) for p in paths]


def test_specs(spark):
    got = values(spark, s.entry_spec(F.col("x")), ["a.py", "a.py:f", ":f", "a.py:", "a:b:c"])
    assert [g and tuple(g) for g in got] == [("a.py", None), ("a.py", "f"), None, None, None]
    got = values(spark, s.module_symbol(F.col("x")), ["m:s", "m:s:t", ":s", "m:", "m"])
    assert [g and tuple(g) for g in got] == [("m", "s"), ("m", "s:t"), None, None, None]
    got = values(spark, s.manifest_target(F.col("x")), ["uvicorn a.b:app --x", "a.b:main", "a.b"])
    assert [tuple(g) for g in got] == [("a.b", "app"), ("a.b", "main"), ("a.b", None)]
    assert values(spark, s.app_module(F.col("x")), ["shop.apps.ShopAppConfig", "shop"]) == ["shop", "shop"]
    assert values(spark, s.target_minor(F.col("x")), ["py311", "py39", "py3100", "311"]) == [11, None, None, None]
    assert values(spark, s.normalize_path(F.col("x")), [".\\a\\b", "././a"]) == ["a/b", "a"]


def test_commands_and_directives(spark):
    got = values(spark, s.run_modules(s.command_tokens(F.col("x"))), ["(python3.11 -m pytest) && python -m", "python x -m y", ""])
    assert got == [["pytest"], [], []]
    got = values(spark, s.directives(F.col("x")), ["# treelens: ignore[TL001,TL010]", "#treelens:file-ignore[TL002]", "# treelens: ignore[TL1]", "# treelens: ignore[TL001, TL002]"])
    assert [g and (g.file_level, g.codes) for g in got] == [(False, ["TL001", "TL010"]), (True, ["TL002"]), None, None]


def test_targets_and_keys(spark):
    rows = [("file", "a.py", None, None, 3, None), ("symbol", "a.py", "m", "f", 3, "api"), ("symbol", None, "m", "f", 3, None), ("import", "a.py", "yaml", None, 12, None), ("binary", None, None, "ruff", None, None)]
    schema = "k string, p string, m string, n string, l int, w string"
    c = {x: F.col(x) for x in "kpmnlw"}
    assert values(spark, s.stable_target(c["k"], c["p"], c["m"], c["n"], c["w"]), rows, schema) == ["a.py", "api:a.py:f", "m:f", "a.py:yaml", "ruff"]
    assert values(spark, s.sort_key(c["k"], c["p"], c["m"], c["n"], c["l"]), rows, schema) == ["a.py", "m:f", "m:f", "a.py:12:yaml", "ruff"]


def test_globs(spark):
    cases = [("src/*.py", "src/a/b.py", True), ("src/**/x.py", "src/x.py", True), ("**/x.py", "x.py", True), ("a/**", "a/b/c", True), ("a/**", "a", False), ("{a,b}/?.py", "b/c.py", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False), ("**/__pycache__/**", "p/__pycache__/x.pyc", True), ("\\*", "*", True)]
    for glob, path, ok in cases:
        assert globs.match(path, [glob]) == ok, (glob, path)
        assert values(spark, s.matches(F.col("x"), [glob]), [path]) == [ok], (glob, path)
    assert not globs.match("a/b.py", []) and re.match(globs.any_glob(["a*.py"], crosses=False), "a/b.py") is None


def test_gitignore():
    g = globs.Gitignore()
    g.add("*.log\n/build\nout/\n!keep.log\n# no\n\\#x\n")
    g.add("local.py\n", "sub")
    for path, is_dir, ok in [("a.log", False, True), ("d/a.log", False, True), ("keep.log", False, False), ("build/x.py", False, True), ("d/build", True, False), ("out", False, False), ("out/x.py", False, True), ("sub/local.py", False, True), ("local.py", False, False), ("#x", False, True)]:
        assert g.ignored(path, is_dir) == ok, path
