"""All queries over the relational tables, by name, with their SQL (oracles.py)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions import scalars as s
from treelens.operators import closure, dependencies, emit, resolve, symbols
from treelens.operators.ordinal import carry_forward, ordinals
from treelens.plans import adapters as a
from treelens.plans import corpus
from treelens.plans.oracles import ORACLES  # noqa: F401
from treelens.session import cut, shared_dir
from treelens.sources import facts, pyast
from treelens.sources.cache import split_cached

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _text(c) -> F.Column:
    return c.cast("string")


def _count(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def _reached(spark, d) -> DataFrame:
    return cut(closure.reach(a.edges(spark, d), a.seeds(spark, d)))


# reachability


@query
def unreachable_files(spark: SparkSession, d: str) -> DataFrame:
    reached = _reached(spark, d).select(a.path_of(F.col("node")).alias("node"))
    none = reached.select(F.col("node").alias("path")).limit(0)
    return symbols.unused_files(a.files(spark, d), reached, none).select("path", "confidence", "severity")


@query
def reach_closure(spark, d):
    return _reached(spark, d).select("node")


@query
def reach_depth(spark, d):
    return _reached(spark, d).select("node", "depth")


@query
def trace_path(spark, d):
    e = a.edges(spark, d)
    r = cut(closure.reach(e, a.seeds(spark, d)))
    real = r.join(e.select(F.col("src").alias("pred"), F.col("dst").alias("node"), F.lit(True).alias("real")), ["pred", "node"], "left")
    ways = closure.along(real, F.col("pred").isNull() | F.coalesce("real", F.lit(False)))
    return r.join(ways, "node").select("node", "depth", "steps", F.col("every").alias("follows_edges"))


@query
def incoming_imports(spark, d):
    rows = closure.importers(a.edges(spark, d), _reached(spark, d), F.lit(True))
    return rows.groupBy("dst").agg(F.count("*").alias("importers"), F.count_if("reachable").alias("reachable"))


@query
def used_modules(spark, d):
    rows = a.imports(spark, d).join(_reached(spark, d).select(F.col("node").alias("key")), "key", "left_semi")
    return rows.groupBy("part").agg(F.count("*").alias("imports"))


@query
def lock_closure(spark, d):
    return dependencies.lock_closure(a.declared(spark, d), a.lock(spark, d))


# resolution


def _roots(spark, d) -> tuple[DataFrame, ...]:
    k = F.col("l_partkey") % 500
    sites = a.table(spark, d, "lineitem").select(k.alias("k"), F.concat(F.when(k % 2 == 0, "root").otherwise("root_"), _text(k)).alias("import_root"), "l_orderkey", "l_linenumber")
    roots = sites.select("k", "import_root").distinct()
    n = F.col("k")
    name = F.col("import_root").alias("name")
    pick = lambda where, *dists: roots.where(where).select("import_root", F.explode(F.array(*dists)).alias("distribution"))
    std, own = roots.where(n % 13 == 0).select(name), roots.where(n % 13 == 1).select(name)
    members = roots.where(n % 13 == 2).select(name, F.lit("m").alias("member"))
    installed = pick(n % 7 == 0, F.lit("venv-b")).union(pick((n % 7 == 0) & (n % 2 == 0), F.lit("venv-a")))
    user = roots.where((n % 7).isin(0, 1)).select("import_root", F.concat(F.lit("user-"), _text(n)).alias("distribution"))
    bundled = pick((n % 7).isin(1, 2), F.lit("bundled-y")).union(pick((n % 7).isin(1, 2) & (n % 3 == 0), F.lit("bundled-x")))
    return sites, std, own, members, installed, user, bundled


@query
def resolve_ladder(spark, d):
    sites, *dims = _roots(spark, d)
    counted = sites.groupBy("import_root").agg(F.count("*").alias("sites"))
    return resolve.resolve_roots(sites, *dims).join(counted, "import_root").select("import_root", "origin", "distribution", "confidence", "tier", "sites")


@query
def ambiguous_roots(spark, d):
    return resolve.ambiguous(_roots(spark, d)[4])


@query
def longest_prefix_owner(spark, d):
    n = F.col("n_nationkey")
    at = F.when(n % 3 == 0, F.concat(F.lit("src/pkg"), _text(n))).when(n % 3 == 1, "src").otherwise(F.concat(F.lit("src/pkg"), _text(n), F.lit("/sub")))
    members = a.table(spark, d, "nation").select(at.alias("path"), F.concat(F.lit("n"), _text(n)).alias("id"))
    return resolve.owners(a.files(spark, d).select("path"), members)


@query
def module_index(spark, d):
    o = F.col("o_custkey")
    path = F.concat(F.lit("src/pkg"), _text(o % 50), F.lit("/m_"), _text(o), F.when(F.col("o_orderkey") % 2 == 0, ".py").otherwise("/__init__.py"))
    return resolve.module_index(a.table(spark, d, "orders").select(path.alias("path")), "src", [])


@query
def module_paths(spark, d):
    k = F.col("o_orderkey") % 3
    path = F.concat(F.when(k == 0, "src/").when(k == 1, "").otherwise("libs/x/src/"), F.lit("m_"), _text(F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, ".py").otherwise("/__init__.py"))
    targets = a.table(spark, d, "customer").select(F.concat(F.lit("m_"), _text(F.col("c_custkey"))).alias("module"))
    return resolve.module_paths(targets, a.table(spark, d, "orders").select(path.alias("path")).distinct(), "src")


@query
def origin_merge(spark, d):
    k = F.col("l_suppkey") % 10
    rows = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("module"),F.when(k == 0, "stdlib").when(k < 6, "third_party").otherwise("unknown").alias("origin"), F.col("l_linenumber").alias("seq"))
    return resolve.merge_origins(rows)


@query
def binary_overlay(spark, d):
    rows = a.table(spark, d, "part").select(F.concat(F.lit("bin"), _text(F.col("p_partkey") % 100)).alias("binary"), F.col("p_brand").alias("distribution"), (F.col("p_size") % 3).alias("layer"), F.col("p_partkey").alias("seq"))
    return resolve.overlay(rows)


# dependencies


def _some_used(spark, d) -> DataFrame:
    return a.used(spark, d).where(~F.col("distribution").isin("brand-9", "brand-18", "brand-21"))


@query
def unused_dep(spark, d):
    return dependencies.unused(a.declared(spark, d), _some_used(spark, d)).select("distribution", "marker").distinct()


@query
def unused_dep_strict(spark, d):
    return dependencies.unused(a.declared(spark, d), _some_used(spark, d), strict=True).select("distribution", "kind", "label", "confidence").distinct()


def _closure(spark, d):
    declared = a.declared(spark, d)
    return a.used(spark, d), declared, dependencies.lock_closure(declared, a.lock(spark, d))


@query
def missing_dep(spark, d):
    return _count(dependencies.missing(*_closure(spark, d)), "distribution", "severity")


@query
def transitive_dep(spark, d):
    return _count(dependencies.transitive(*_closure(spark, d)), "distribution", "severity")


@query
def misplaced_dep(spark, d):
    declared = a.declared(spark, d).where("label <> 'small' and kind <> 'runtime'")
    return dependencies.misplaced(a.used(spark, d), declared).select("distribution", "severity")


@query
def unlisted_binary(spark, d):
    # every token of a text calls a tool, by its length
    tokens = a.table(spark, d, "documents").select("doc_id", F.explode(s.command_tokens(F.col("text"))).alias("token"))
    binaries = tokens.select(F.concat(F.lit("tool-"), _text(F.length("token") % 60)).alias("binary"), F.col("doc_id").alias("file"), F.lit(1).alias("line"))
    n = F.col("n_nationkey")
    known = a.table(spark, d, "nation").select(F.concat(F.lit("tool-"), _text(n)).alias("binary"), F.concat(F.lit("brand-"), _text(n + 1)).alias("distribution"))
    return dependencies.unlisted(binaries, known, a.declared(spark, d)).select("binary", "distribution", F.col("file").alias("first_doc"))


@query
def duplicate_dep(spark, d):
    return dependencies.duplicates(a.declared(spark, d)).select("distribution", F.array_join("contexts", ",").alias("contexts"))


# symbols


def _m(x):
    """Two parts are a module, so that modules grow with the data."""
    return F.concat(F.lit("m"), _text(F.shiftright(x, 1)))


def _refs(spark, d) -> DataFrame:
    rows = a.table(spark, d, "lineitem")
    imports = rows.select(_text(F.col("l_orderkey")).alias("path"), _m(F.col("l_orderkey")).alias("importer"), _m(F.col("l_partkey")).alias("module"), F.concat(F.lit("f"), _text(F.col("l_suppkey") % 50 + 1)).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(True).alias("reachable"))
    # half of the names are reached through an attribute of the imported module
    odd = F.col("l_orderkey") % 2 == 1
    through = rows.where(odd).select(_text(F.col("l_orderkey")).alias("path"), F.concat(_m(F.col("l_partkey")), F.lit("_"), _text(F.col("l_linenumber"))).alias("receiver"), F.concat(F.lit("f"), _text(F.col("l_suppkey") % 50 + 1)).alias("name"))
    whole = rows.where(odd).select(_text(F.col("l_orderkey")).alias("path"), _m(F.col("l_orderkey")).alias("importer"), _m(F.col("l_partkey")).alias("module"), F.lit(None).cast("string").alias("name"), F.concat(_m(F.col("l_partkey")), F.lit("_"), _text(F.col("l_linenumber"))).alias("alias"), F.lit(True).alias("reachable"))
    return symbols.references(imports.where(F.col("path").cast("long") % 2 == 0).union(whole), through)


@query
def unused_export(spark, d):
    p = a.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("seq"), _m(F.col("p_partkey")).alias("module"), F.concat(F.lit("f"), _text(F.col("p_size"))).alias("name"), (F.col("p_size") % 4 == 0).alias("exported"), (F.col("p_size") % 7 == 0).alias("decorated"), F.lit(True).alias("is_public"), F.lit(False).alias("in_type_checking"), (F.shiftright("p_partkey", 1) % 3 != 0).alias("reachable"))
    external = spark.createDataFrame([("m7", f"f{i}") for i in range(1, 51)], "module string, name string")
    return symbols.unused_exports(rows, _refs(spark, d), external).select("module", "name", "confidence", "severity")


@query
def unused_reexport(spark, d):
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "_").otherwise(""), F.lit("f"), _text(F.col("p_size")))
    rows = a.table(spark, d, "part").select(_m(F.col("p_partkey")).alias("package"), name.alias("name"), (F.col("p_size") % 4 == 0).alias("exported")).distinct()
    return symbols.unused_reexports(rows, _refs(spark, d)).select("package", "name", "confidence")


@query
def unresolved_import(spark, d):
    sites, *dims = _roots(spark, d)
    known = resolve.resolve_roots(sites, *dims).select("import_root", "origin")
    rows = sites.join(known, "import_root").select(a.path_of(F.col("l_orderkey")).alias("path"), F.col("l_linenumber").alias("line"), "import_root", "origin")
    return symbols.unresolved(rows, _reached(spark, d).select(a.path_of(F.col("node")).alias("node"))).select("path", "line", "import_root")


# emission


def _emitted(spark, d) -> DataFrame:
    levels = {"TL004": "info", "TL007": "off"}
    patterns = {"TL001": ["src/pkg1*/m_*5.py"], "TL002": ["name_11"], "TL006": ["src/pkg2*:name_[0-9]5"], "TL010": ["mod9", "mod29"]}
    return emit.emit(a.candidates(spark, d), a.directives(spark, d), levels, patterns, "likely")


@query
def severity_override(spark, d):
    return _count(emit.override_severity(a.candidates(spark, d), {"TL004": "info", "TL007": "off"}), "code", "severity")


@query
def ignore_filter(spark, d):
    return _count(_emitted(spark, d), "code", F.coalesce("disposition", F.lit("reported")).alias("disposition"))


@query
def confidence_floor(spark, d):
    return _count(emit.confident(a.candidates(spark, d), "likely"), "code", "confidence")


@query
def include_exclude(spark, d):
    return _count(emit.chosen(a.candidates(spark, d), ["TL001", "TL003", "TL008"], ["TL003"]), "code")


@query
def fingerprints(spark, d):
    return _count(emit.with_identity(a.candidates(spark, d)), "fingerprint")


@query
def sort_keys(spark, d):
    return _count(emit.with_identity(a.candidates(spark, d)), "sort_key")


@query
def baseline_diff(spark, d):
    known = emit.with_identity(a.candidates(spark, d).where(F.regexp_extract(F.coalesce("path", F.lit("m_0.py")), r"m_([0-9]+)\.py", 1).cast("long") % 3 == 0))
    # subjects without a file come from the orders themselves
    i = a.table(spark, d, "lineitem").where("l_orderkey % 3 = 0")
    keys = i.select((F.col("l_partkey") % 10 + 1).alias("c"), (F.col("l_partkey") % 60).alias("p"), F.when(F.col("l_orderkey") % 11 == 0, F.concat(F.lit("member"), _text(F.col("l_orderkey") % 3), F.lit(":"))).otherwise("").alias("m")).where("c in (2, 5, 8, 9)").distinct()
    other = keys.select(F.concat(F.lit("TL"), F.lpad(_text(F.col("c")), 3, "0"), F.lit(":"), "m", F.lit("name_"), _text(F.col("p"))).alias("fingerprint"))
    baseline = known.where("path is not null").select("fingerprint").union(other)
    rows = emit.against_baseline(_emitted(spark, d), baseline)
    return _count(rows, F.coalesce("disposition", F.lit("reported")).alias("disposition"))


@query
def summary_by_rule(spark, d):
    return emit.summary(_emitted(spark, d))


@query
def exit_status(spark, d):
    rows = cut(_emitted(spark, d).select("severity", "confidence", "disposition"))
    return emit.fails(rows).crossJoin(emit.fails(rows, strict=True).withColumnRenamed("failed", "failed_strict"))  # one row each


@query
def fix_plan(spark, d):
    n = F.col("n_nationkey")
    code = F.element_at(F.array(*map(F.lit, ("TL001", "TL002", "TL005", "TL009"))), n % 4 + 1)
    found = a.table(spark, d, "nation").select(code.alias("code"), F.concat(F.lit("brand-"), _text(n + 1)).alias("name"), F.lit(None).cast("string").alias("path"), F.when(F.col("n_regionkey") == 2, "likely").otherwise("certain").alias("confidence"))
    declared = a.declared(spark, d).withColumns({"file": F.lit("pyproject.toml"), "seq": F.col("label")})
    return emit.fix_plan(found, declared).select("code", "name", "action", "label", "reason")


@query
def entry_merge(spark, d):
    context = F.when(F.col("l_linestatus") == "O", "dev").when(F.col("l_returnflag") == "R", "runtime").otherwise("test")
    rows = a.table(spark, d, "lineitem").select(a.path_of(F.col("l_orderkey")).alias("path"),F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("s"), _text(F.col("l_partkey")))).alias("symbol"), context.alias("context"), F.concat("l_returnflag", "l_linestatus").alias("origin"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"))
    return emit.merge_entries(rows).select("path", "symbol", "context", F.size("origins").cast("long").alias("origins"))


# scalars


@query
def normalize_names(spark, d):
    raw = F.replace(F.replace("p_brand", F.lit("#"), F.lit("_.")), F.lit(" "), F.lit("-"))
    return _count(a.table(spark, d, "part"), s.normalize_name(raw).alias("name"))


@query
def import_roots(spark, d):
    return _count(a.table(spark, d, "pages"), s.import_root(F.split("url", "://")[1]).alias("root"))


@query
def path_context(spark, d):
    folder = F.element_at(F.array(*map(F.lit, ("tests/", "src/", "docs/", "scripts/", "pkg/tests/", ""))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("a.py", "test_b.py", "c_test.py", "conftest.py", "noxfile.py", "testx.py", "main.py"))), (F.col("o_custkey") % 7 + 1).cast("int"))
    return _count(a.table(spark, d, "orders"), s.file_context(F.concat(folder, name)).alias("context"))


@query
def relative_imports(spark, d):
    parts = F.slice(F.array(F.lit("a"), F.concat(F.lit("b"), _text(F.col("l_partkey") % 9)), F.lit("c"), F.lit("d")), F.lit(1), (F.col("l_orderkey") % 4 + 1).cast("int"))
    k = F.col("l_suppkey") % 3
    module = s.relative_module(F.array_join(parts, "."), F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 3 + 1, F.when(k == 0, "x"), F.when(k == 1, "y"))
    return _count(a.table(spark, d, "lineitem"), module.alias("module"))


@query
def config_tokens(spark, d):
    rows = a.table(spark, d, "documents").select(F.explode(s.command_tokens(F.col("text"))).alias("token"))
    return _count(rows, "token")


@query
def workflow_binaries(spark, d):
    line = F.concat(F.lit("run: "), F.when(F.col("event_id") % 3 == 0, "python3 -m mod").otherwise("python3 -c mod"), _text(F.col("event_id") % 40), F.lit(" --flag"))
    rows = a.table(spark, d, "events").select(F.explode(s.run_modules(s.command_tokens(line))).alias("module"))
    return _count(rows, "module")


@query
def ini_sections(spark, d):
    # lines of a document below their last heading; a text is cut anywhere, so no document is gathered
    lines = a.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike("^[A-ZÀ-Ü][a-z]+ "), F.substring_index("line", " ", 1))
    rows = carry_forward(lines.select("doc_id", "pos", head.alias("head")), ["pos"], "head", "section", "doc_id")
    return _count(rows, "doc_id", F.coalesce("section", F.lit("")).alias("section"))


@query
def ignore_directives(spark, d):
    # the data hold no directives, so each line of a text has one put behind it
    n = F.col("doc_id") + F.col("pos")
    code = F.concat(F.lit("TL00"), _text(n % 9 + 1))
    said = F.when(n % 5 == 0, F.concat(F.lit("  # ignore["), code, F.lit("]"))).otherwise(F.concat(F.lit("  #  treelens: "), F.when(n % 2 == 0, "file-").otherwise(""), F.lit("ignore["), code, F.when(n % 3 == 0, ",TL010").otherwise(""), F.lit("] why")))
    lines = a.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.select(s.directives(F.concat("line", said)).alias("x")).where("x is not null").select("x.file_level", F.explode("x.codes").alias("code"))
    return _count(rows, "file_level", "code")


@query
def glob_filter(spark, d):
    p = F.col("path")
    globs = {"crossing": ["src/*1.py"], "braces": ["src/pkg{7,8}/**"], "classes": ["**/m_[0-4]?.py"]}
    return a.files(spark, d).agg(*[F.count_if(s.matches(p, g)).alias(k) for k, g in globs.items()])


# reports


@query
def probe_counts(spark, d):
    return a.files(spark, d).groupingSets([["context"], ["opaque"]], "context", "opaque").agg(F.count("*").alias("n"))


@query
def false_positive_rate(spark, d):
    rows = a.table(spark, d, "lineitem").select(F.concat(F.lit("TL"), F.lpad(_text(F.col("l_partkey") % 10 + 1), 3, "0")).alias("code"), (F.col("l_partkey") % 3 == 2).alias("fp"))
    n, fp = F.count("*"), F.count_if("fp")
    return rows.groupBy("code").agg(n.alias("labelled"), fp.alias("false_positives"), F.floor(fp * 1000 / n).cast("long").alias("permille"))


@query
def parse_cache(spark, d):
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    cache = docs.where("path % 3 = 0").select("content_hash").distinct().withColumn("parsed", F.lit(1))
    hits, misses = split_cached(docs, cache)
    rows = hits.select(F.lit("hit").alias("state"), "content_hash").union(misses.select(F.lit("miss").alias("state"), "content_hash"))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("contents"))


# many projects


@query
def corpus_findings(spark, d):
    out = corpus.analyze(spark, a.trees(spark, d))
    return _count(out.issues.where("disposition is null"), "code", "severity", "confidence")


@query
def corpus_unused_files(spark, d):
    out = corpus.analyze(spark, a.trees(spark, d), include=["TL001"])
    return out.issues.select("project", "path", "severity")


@query
def corpus_strict_missing(spark, d):
    out = corpus.analyze(spark, a.trees(spark, d), strict=True, include=["TL003"])
    return out.issues.select("project", "path", "module", "line", "message")


@query
def corpus_reach(spark, d):
    return corpus.graph(spark, a.trees(spark, d)).reached.select("project", "node", "depth", "pred")


@query
def corpus_facts(spark, d):
    return _count(facts.of_projects(a.trees(spark, d)), "project", "fact")


@query
def corpus_declared(spark, d):
    found = facts.of_projects(a.trees(spark, d))
    return facts.relation(found, "declared", facts.DECLARED).select("project", "distribution", "kind", "file", F.col("where").alias("place"))


def _parsed(spark, d, cache=None):
    trees = a.trees(spark, d).where("path <> 'pyproject.toml'")
    kind = F.when(F.col("path").endswith(".pyi"), "stub").otherwise("python")
    files = trees.withColumns({"kind": kind, "context": s.file_context(F.col("path")), "layout": F.lit("src"), "length": F.octet_length("content").cast("long"), "modified": F.lit(0).cast("long")})
    return corpus.parse(spark, files, cache)


@query
def corpus_imports(spark, d):
    parsed, _ = _parsed(spark, d)
    return _count(pyast.relation(parsed, "imports"), "module", "line", "context")


@query
def corpus_symbols(spark, d):
    parsed, _ = _parsed(spark, d)
    return pyast.relation(parsed, "symbols").select("project", F.col("importer").alias("module"), "name", "line")


@query
def parse_counters(spark, d):
    _, n = _parsed(spark, d)
    return spark.createDataFrame([(n["parsed"], n["errors"], n["skipped"])], "parsed long, errors long, skipped long")


@query
def parse_cache_runs(spark, d):
    at = f"{shared_dir(spark).rstrip('/')}/treelens-cache-{uuid.uuid4().hex}"
    runs = [(i, n["parsed"], n["fresh"], n["cached"]) for i, (_, n) in enumerate(_parsed(spark, d, at) for _ in range(2))]
    return spark.createDataFrame(runs, "run int, parsed long, fresh long, cached long")


@query
def issue_ordinals(spark, d):
    # what tells line items apart, in the order of reports
    rows = a.table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = ordinals(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ordinal")


@query
def pattern_ignores(spark, d):
    # a pattern for each nation, most of them for folders that hold nothing
    n = F.col("n_nationkey")
    where = a.table(spark, d, "nation").select(
        F.concat(F.lit("TL"), F.lpad(_text(n % 10 + 1), 3, "0")).alias("code"),
        F.concat(F.lit("src/pkg"), _text(n * 2)).alias("folder"),
        F.concat(F.lit("^src/pkg"), _text(n * 2), F.lit("/.*"), _text(n % 4), F.lit("\\.py$")).alias("regex"),
        F.lit(None).cast("string").alias("name_regex"),
    )
    rows = emit.ignored_by_pattern(a.candidates(spark, d).where("kind in ('file', 'import')"), where)
    return _count(rows, "code", "by_pattern")
