"""An analysis that asks for some rules computes these only, with the same rows; facts do not depend on how rows are dealt."""

import json

import pytest

from tests.test_corpus import TREES, trees  # noqa: F401
from treelens.plans import corpus
from treelens.sources import facts, tree
from treelens.sources.folder import Folder


@pytest.mark.parametrize("size", ["2", "10000"])
def test_facts_are_those_of_each_project(spark, size):
    rows = [(name, path, text.encode()) for name, files in TREES.items() for path, text in files.items()]
    rows += [(None, "a.py", b""), ("none", None, b"")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = facts.of_projects(spark.createDataFrame(rows, "project string, path string, content binary"))
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        got: dict = {}
        for r in found.orderBy("project", "seq").collect():
            got.setdefault(r.project, []).append((r.fact, json.loads(r.value)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, files in TREES.items():
        if name != "bad":
            assert got[name] == list(facts.facts(Folder({p: t.encode() for p, t in files.items()}))), name
    assert [f for f, _ in got["bad"]] == ["error"]


def test_only_what_is_asked_for(spark, trees, monkeypatch):  # noqa: F811
    files = tree.scan(spark, str(trees)).cache()
    rows = lambda out, code: sorted(map(str, out.issues.where(f"code = '{code}'").collect()))
    every = corpus.analyze(spark, files, strict=True)
    asked = corpus.analyze(spark, files, strict=True, include=["TL003"])
    assert rows(asked, "TL003") == rows(every, "TL003") and asked.issues.where("code <> 'TL003'").isEmpty()

    def never(*_, **__):
        raise AssertionError("imports are not asked for")

    monkeypatch.setattr(corpus.resolve, "resolve", never)
    asked = corpus.analyze(spark, files, strict=True, include=["TL001"])
    assert rows(asked, "TL001") == rows(every, "TL001") != [] and asked.issues.where("code <> 'TL001'").isEmpty()
