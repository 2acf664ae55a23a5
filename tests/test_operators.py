import random

from pyspark.sql import functions as F

from treelens.operators import closure, dependencies, emit, ordinal, resolve
from treelens.sources.cache import key, split_cached
from treelens.streaming import incremental


def breadth_first(edges, seeds):
    depth, front = {s: 0 for s in seeds}, list(seeds)
    while front:
        front = [b for a in front for x, b in edges if x == a and b not in depth]
        front = list(dict.fromkeys(front))
        at = max(depth.values()) + 1
        depth.update(dict.fromkeys(front, at))
    return depth


def test_closure_equals_a_plain_search(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(5, 5), (None, 1), (1, None)]
    e = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(0,), (1,), (0,), (None,)], "node long")
    reached = closure.reach(e, seeds)
    rows = reached.collect()
    truth = breadth_first([x for x in edges if None not in x], [0, 1])
    assert {r.node: r.depth for r in rows} == truth and len(rows) == len(truth)
    assert all(r.pred is None if r.depth == 0 else (r.pred, r.node) in edges and truth[r.pred] == r.depth - 1 for r in rows)
    ways: dict = {}
    for r in closure.paths(reached, reached.select("node")).collect():
        ways.setdefault(r.target, {})[r.step] = r.at
    for node, way in ways.items():
        assert sorted(way) == list(range(truth[node] + 1)) and way[0] == node and all((way[i + 1], way[i]) in edges for i in range(truth[node]))
    assert set(ways) == set(truth)
    again = closure.reach(e, spark.createDataFrame([(k,) for k in truth], "node long"))
    assert {r.node for r in again.collect()} == set(truth)
    assert closure.reach(e.limit(0), seeds).count() == 2 and closure.reach(e, seeds.limit(0)).count() == 0


def test_long_chains_take_few_rounds(spark):
    # a chain of 100, one leaf at each node of it, and cycles of chains off it and on it
    chain = [(i, i + 1) for i in range(100)] + [(i, 1000 + i) for i in range(100)] + [(100, 40)] + [(500, 501), (501, 502), (502, 500), (502, 503)]
    e = spark.createDataFrame(chain, "src long, dst long")
    reached = closure.reach(e, spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.depth for r in reached.collect()} == breadth_first(chain, [0]) and reached.rounds < 20
    plain = closure.reach(e.where("dst < 101 and src < 100"), spark.createDataFrame([(0,)], "node long"))
    assert plain.rounds < 15 and plain.count() == 101
    assert closure.reach(e, spark.createDataFrame([(0,)], "node long"), most=3).count() == 7


def test_ordinals_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c"]), i) for i in range(300)]
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    for parts in (1, 6):
        out = ordinal.ordinals(spark.createDataFrame(rows, "k string, i long").repartition(parts), ["k", "i"])
        assert {r.i: r.ordinal for r in out.collect()} == want
    assert ordinal.ordinals(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_values_carry_forward_over_ranges(spark):
    rng = random.Random(4)
    rows = [("big", i, f"s{i}" if rng.random() < 0.01 else None) for i in range(2000)] + [(k, i, "x" if i == 3 else None) for k in "abz" for i in range(6)] + [("none", 1, None)]
    want, now = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[:2]):
        now[k] = v or now.get(k)
        want[k, i] = now[k]
    for parts in ("1", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = ordinal.carry_forward(spark.createDataFrame(rows, "k string, i int, v string"), ["i"], "v", "section", "k")
            assert {(r.k, r.i): r.section for r in out.collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ladder_tiers_exclude_each_other(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    names = ["os", "Acme", "api", "many", "yaml", "PIL", "my_pkg", "nowhere", "both"]
    pair = "import_root string, distribution string"
    got = resolve.resolve_roots(f([(n,) for n in names], "import_root string"), f([("os",)], "name string"), f([("ACME",)], "name string"), f([("api", "api")], "name string, member string"), f([("many", "b"), ("many", "a"), ("both", "venv")], pair), f([("yaml", "custom-yaml"), ("both", "user")], pair), f([("PIL", "pillow"), ("yaml", "pyyaml")], pair))
    rows = {r.import_root: (r.origin, r.distribution, r.confidence) for r in got.collect()}
    assert rows == {"os": ("stdlib", None, "certain"), "Acme": ("first_party", None, "certain"), "api": ("first_party", None, "certain"), "many": ("third_party", "a", "maybe"), "yaml": ("third_party", "custom-yaml", "likely"), "PIL": ("third_party", "pillow", "certain"), "my_pkg": ("third_party", "my-pkg", "maybe"), "nowhere": ("unknown", None, "maybe"), "both": ("third_party", "venv", "certain")}


def test_owner_is_the_longest_prefix(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("ab/x.py",), ("z.py",)], "path string")
    members = spark.createDataFrame([("a", "one"), ("a/b", "two"), ("z.py", "file")], "path string, id string")
    assert {r.path: r.member for r in resolve.owners(files, members).collect()} == {"a/b/c.py": "two", "a/x.py": "one", "ab/x.py": None, "z.py": "file"}


def test_stubs_follow_what_they_describe(spark):
    d = "distribution string, kind string, label string, marker string, opaque boolean"
    declared = spark.createDataFrame([(n, "runtime", None, None, False) for n in ("types-requests", "requests", "types-six", "foo-stubs")], d)
    used = spark.createDataFrame([("requests",)], "distribution string")
    assert {r.distribution for r in dependencies.unused(declared, used).collect()} == {"types-six", "foo-stubs"}


def candidate(**k):
    base = {"code": "TL001", "kind": "file", "path": "a.py", "module": None, "name": None, "line": None, "severity": "error", "confidence": "certain", "message": "", "member": None, "seq": 0}
    return tuple((base | k).values())


def test_emission_order(spark):
    rows = [candidate(), candidate(path="b.py", line=3), candidate(code="TL003", kind="import", path="c.py", module="m", line=5), candidate(code="TL010", kind="import", path="c.py", module="n", line=5, confidence="maybe"), candidate(code="TL006", kind="symbol", path="p/q.py", module="p.q", name="f")]
    df = spark.createDataFrame(rows, emit.CANDIDATE)
    none = spark.createDataFrame([], "path string, line int, file_level boolean, codes array<string>, seq int")
    told = spark.createDataFrame([("b.py", 9, False, ["TL001"], 0), ("c.py", 5, False, ["TL003"], 1), ("c.py", 1, True, ["TL003"], 0)], none.schema)
    out = {(r.code, r.path): r.disposition for r in emit.emit(df, told, {"TL001": "warning"}, {"TL006": ["p/*:f"]}, "likely").collect()}
    assert out == {("TL001", "a.py"): None, ("TL001", "b.py"): None, ("TL003", "c.py"): "file", ("TL006", "p/q.py"): "config"}
    assert emit.emit(df, none, {"TL001": "off"}, {}, "certain", strict=True).count() == 3
    assert [r.failed for r in emit.fails(emit.emit(df, none)).collect()] == [True]
    low = emit.emit(df, none, dict.fromkeys(("TL001", "TL003", "TL006", "TL010"), "info"))
    assert not emit.fails(low).first().failed and not emit.fails(low.limit(0)).first().failed
    assert {r.code: r.n for r in emit.summary(emit.emit(df, none, exclude=["TL001"])).collect()} == {"TL003": 1, "TL010": 1, "TL006": 1, None: 3}


def test_parse_cache(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"1")], "path string, content binary").withColumn("content_hash", key(F.col("content"), "src", "py311"))
    cache = files.where("path = 'a'").select("content_hash").withColumn("parsed", F.lit(1))
    hits, misses = split_cached(files, cache)
    assert {r.path for r in hits.collect()} == {"a", "c"} and {r.path for r in misses.collect()} == {"b"}


def test_stream_of_changed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("import one")
    where = (str(tmp_path / "table"), str(tmp_path / "cp"))
    incremental.keep_parsed(incremental.changed(spark, str(tmp_path / "in")), *where).awaitTermination(120)
    (tmp_path / "in/b.py").write_text("import two")
    incremental.keep_parsed(incremental.changed(spark, str(tmp_path / "in")), *where).awaitTermination(120)
    rows = incremental.latest(spark, where[0]).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.imports[0].module) for r in rows) == [("a.py", "one"), ("b.py", "two")]


def test_stream_of_two_contents_and_a_repeated_batch(spark, tmp_path):
    rows = [("a.py", "runtime", b"import one", 1), ("a.py", "runtime", b"import two", 2), ("a.py", "runtime", b"import two", 2), ("b.py", "runtime", b"import one", 1)]
    (tmp_path / "in").mkdir()
    schema = "path string, context string, content binary, modified long"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    for k in range(2):
        # a checkpoint that was lost: the batch is run again
        incremental.keep_parsed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / f"cp{k}")).awaitTermination(120)
        assert sorted((r.path, r.imports[0].module) for r in spark.read.parquet(table).collect()) == [("a.py", "one"), ("a.py", "two"), ("b.py", "one")]
    assert sorted((r.path, r.imports[0].module) for r in incremental.latest(spark, table).collect()) == [("a.py", "two"), ("b.py", "one")]


def test_fix_plan_reasons(spark):
    found = [
        ("TL001", "likely", None, "a.py", None, ""), ("TL002", "certain", "gone", None, None, ""), ("TL002", "likely", "x", None, None, ""), ("TL002", "certain", "x", None, None, ""),
        ("TL005", "certain", "x", None, None, ""), ("TL005", "certain", "devonly", None, None, ""), ("TL009", "certain", "devonly", None, None, ""), ("TL009", "certain", "x", None, None, ""), ("TL006", "certain", "f", "a.py", None, ""),
        ("TL003", "certain", None, "a.py", None, "numpy is imported"), ("TL003", "likely", None, "b.py", None, "numpy is imported"), ("TL003", "likely", None, "b.py", None, "maybe-it is imported"),
        ("TL003", "certain", None, "m/a.py", "m", "numpy is imported"), ("TL003", "certain", None, "n/a.py", "n", "numpy is imported"), ("TL003", "certain", None, "c.py", None, ""),
    ]
    f = spark.createDataFrame(found, "code string, confidence string, name string, path string, member string, summary string")
    d = spark.createDataFrame([("x", "runtime", "p", "project.dependencies", 0), ("x", "group", "p", "dev", 1), ("devonly", "group", "p", "dev", 2)], "distribution string, kind string, file string, label string, seq long")
    targets = spark.createDataFrame([(None, "pyproject.toml", True), ("m", "m/pyproject.toml", False)], "member string, file string, supported boolean")
    rows = [(r.code, r.name, r.action, r.file, r.label, r.reason) for r in emit.fix_plan(f, d, targets=targets).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [
        ("TL001", None, None, None, None, "file_removal_denied"), ("TL002", "gone", None, None, None, "missing_origin"), ("TL002", "x", None, None, None, "not_fixable"), ("TL002", "x", "remove_dependency", "p", "dev", None),
        ("TL005", "x", None, None, None, "ambiguous"), ("TL005", "devonly", "move_to_runtime", "p", "dev", None), ("TL009", "devonly", None, None, None, "ambiguous"), ("TL009", "x", "remove_duplicate", "p", "dev", None),
        ("TL003", "numpy", "add_missing", "pyproject.toml", "project.dependencies", None), ("TL003", "maybe-it", None, None, None, "not_fixable"), ("TL003", "numpy", None, None, None, "unsupported_target"),
        ("TL003", "numpy", None, None, None, "unsupported_target"), ("TL003", None, None, None, None, "missing_origin"),
    ]))
    sure = emit.fix_plan(f.where("code = 'TL001'"), d, remove_files=True).collect()
    assert [(r.action, r.reason) for r in sure] == [(None, "not_fixable")]
    assert emit.fix_plan(f.where("code = 'TL003'"), d).count() == 0 and emit.fix_plan(f.limit(0), d, targets=targets).count() == 0
