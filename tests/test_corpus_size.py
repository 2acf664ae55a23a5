"""What keeps an analysis of very many projects short: files are made once, graphs are searched in one shuffle, rules look at what is reached."""

import random

import pytest

from tests.test_corpus import TREES
from treelens.operators import closure
from treelens.plans import corpus

FILES = [(name, path, text.encode()) for name, files in TREES.items() for path, text in files.items()]
SCHEMA = "project string, path string, content binary"


def test_no_rounds_for_small_projects(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("rounds of joins for small graphs")

    monkeypatch.setattr(closure, "distances", never)
    out = corpus.analyze(spark, spark.createDataFrame(FILES, SCHEMA), strict=True, include=["TL003"])
    assert {(r.project, r.module) for r in out.issues.collect()} >= {("alpha", "numpy")}
    assert {r.node for r in out.reached.where("project = 'same'").collect()} == {"src/alpha/__main__.py", "src/alpha/other.py"}


def test_files_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    files = spark.createDataFrame(FILES, SCHEMA).mapInArrow(count, SCHEMA)
    out = corpus.analyze(spark, files, include=["TL001"])
    assert ("alpha", "src/alpha/lost.py") in {(r.project, r.path) for r in out.issues.collect()}
    assert made.value == len(FILES)


@pytest.mark.parametrize("most", [0, 20, 10_000])
def test_search_within_projects(spark, most):
    draw = random.Random(3)
    edges = [(f"p{p}", f"n{draw.randrange(p + 3)}", f"n{draw.randrange(p + 3)}", draw.choice([None, 1, 2])) for p in range(30) for _ in range(p + 1)]
    edges += [("p1", None, "n1", 1), (None, "n0", "n1", 1), *[("chain", f"n{i}", f"n{i + 1}", 1) for i in range(40)]]
    seeds = [(f"p{p}", "n0") for p in range(0, 30, 2)] + [("p3", None), ("alone", "a"), ("chain", "n0"), ("chain", "n0")]
    edges = spark.createDataFrame(edges, "project string, src string, dst string, line int")
    seeds = spark.createDataFrame(seeds, "project string, node string")
    got = closure.within(edges, seeds, most)
    node = lambda c: closure.nodes(["project", c])
    known = edges.where("project is not null and src is not null and dst is not null")
    want = closure.reach(known.select(node("src").alias("src"), node("dst").alias("dst"), "line"), seeds.where("node is not null").select(node("node").alias("node")), [edges["line"]])
    rows = sorted((f"{r.project}{closure.PART}{r.node}", r.depth, r.pred and f"{r.project}{closure.PART}{r.pred}") for r in got.collect())
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 60


def test_imports_of_what_is_reached(spark, monkeypatch):
    spread, seen = corpus.resolve.spread, []

    def told(sites, *more):
        seen.append(sites.select("project", "path").distinct())
        return spread(sites, *more)

    monkeypatch.setattr(corpus.resolve, "spread", told)
    out = corpus.analyze(spark, spark.createDataFrame(FILES, SCHEMA))
    live = {(r.project, r.node) for r in out.reached.collect()}
    assert len(seen) == 1 and {tuple(r) for r in seen[0].collect()} <= live
    assert ("alpha", "src/alpha/lost.py") not in live and not out.issues.isEmpty()
