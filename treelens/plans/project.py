"""The whole analysis of one project: from a folder to findings.

Listing and manifests are read on the driver (they are a project's own small
files); sources are parsed by tasks; everything after that is joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions import scalars as s
from treelens.operators import closure, dependencies, emit, resolve, symbols
from treelens.operators.ordinal import ordinals
from treelens.sources import config as conf
from treelens.sources import dims, plugins, pyast, requirements, tree

#: Names of files that are entries wherever they lie, at the root or at the top of a package (fixed values).
ANYWHERE = ("__main__.py", "conftest.py")
AT_TOP = ("main.py", "app.py", "manage.py", "asgi.py", "wsgi.py", "noxfile.py")
APP_NAMES = ("manage.py", "asgi.py", "wsgi.py", "app.py")
#: Order among findings, the same however rows are dealt out.
ORDER = ["code", "kind", "path", "line", "module", "name", "member", "message"]
ISSUE = ["code", "severity", "confidence", "kind", "path", "module", "name", "line", "message", "member", "target", "fingerprint", "sort_key", "summary", "manifest_file", "manifest_label", "disposition"]


def keep(df: DataFrame) -> DataFrame:
    """Used several times; short lineage, so what an executor held is made again if it is lost."""
    return df.persist()


@dataclass
class Inputs:
    root: Path
    marker: str
    config: conf.Config
    used: list[str]
    manifest: requirements.Manifest
    layout: tree.Layout
    paths: list[str]
    hints: plugins.Hints
    members: list[conf.Member]
    member_manifests: dict[str, requirements.Manifest]
    warnings: list[str] = field(default_factory=list)


def gather(start: Path, production: bool | None = None, confidence: str | None = None) -> Inputs:
    """What a project is, before any of its sources is parsed."""
    return gather_at(*conf.find_root(start), production, confidence)


def gather_at(root, marker: str, production: bool | None = None, confidence: str | None = None) -> Inputs:
    """The same for a known root: a path, or a Folder of rows."""
    manifest = requirements.extract(root)
    config, used = conf.load(root, manifest.pyproject)
    config = conf.overridden(config, production, confidence)
    layout = tree.infer_layout(root, manifest.metadata.get("name"))
    paths = tree.walk(root, config, list(config.project) or None)
    members = conf.members(root, config, manifest.pyproject)
    own = {m.id: requirements.extract(root / m.path) for m in members if (root / m.path).is_dir()}
    warnings = [*manifest.warnings, *layout.warnings, *tree.check_entries(root, config)]
    return Inputs(root, marker, config, used, manifest, layout, paths, plugins.collect(root, config, manifest, paths), members, own, warnings)


def mode(x: Inputs) -> str:
    """app or library: as configured, else app in a workspace or where something is started, else library for a named package."""
    if x.config.mode != "auto":
        return x.config.mode
    if len(x.members) > 1:
        return "app"
    names = {p.rsplit("/", 1)[-1] for p, *_ in candidates(x, auto_only=True)}
    if any(g in ("console", "gui") for _, _, g, _ in x.manifest.entry_points) or names & set(APP_NAMES):
        return "app"
    return "library" if x.manifest.metadata.get("name") and x.layout.packages else "app"


def candidates(x: Inputs, auto_only: bool = False) -> list[tuple[str, str | None, str, str]]:
    """path, symbol, context and origin of what may be an entry, in order."""
    out = []
    if not auto_only:
        out += [(*conf.entry_spec(e), tree.context(conf.entry_spec(e)[0]), "config") for e in x.config.entry if conf.entry_spec(e)[0] in x.paths]
    out += [(p, sym, c, f"plugin:{name}") for name, p, sym, c in x.hints.entries if p in x.paths]
    tops = {"", *(f"{'src/' if x.layout.kind == 'src' else ''}{p}" for p in x.layout.packages)}
    for p in x.paths:
        folder, _, base = p.rpartition("/")
        script = p.startswith("scripts/") and p.endswith(".py")
        if base in ANYWHERE or (base in AT_TOP and folder in tops) or p in ("docs/conf.py", "alembic/env.py") or script:
            out.append((p, None, tree.context(p), "auto"))
    return out


def workspace_names(x: Inputs) -> list[tuple[str, str]]:
    """(name, member) of all names by which members are imported: ids, last parts of their paths, of the lock tool's globs and of configured paths."""
    def last(path: str) -> str:
        return re.split(r"[/\\]", path.removesuffix("/*").rstrip("*"))[-1]

    globs = ((((x.manifest.pyproject or {}).get("tool") or {}).get("uv") or {}).get("workspace") or {}).get("members", [])
    out = [(n, m.id) for m in x.members for n in (m.id, last(m.path))]
    out += [(last(g), last(g)) for g in globs if isinstance(g, str)] + [(last(t["path"]), name) for name, t in x.config.workspaces.items()]
    return list({n: (n, m) for n, m in reversed(out) if n}.values())


def _target(text: str) -> tuple[str, str | None]:
    if m := re.search(r"\buvicorn\s+([\w.]+):(\w+)", text):
        return m[1], m[2]
    left, _, right = text.partition(":")
    return left.strip(), right.split("[")[0].strip() or None


@dataclass
class Report:
    inputs: Inputs
    mode: str
    issues: DataFrame
    reached: DataFrame
    entries: DataFrame
    edges: DataFrame
    files: DataFrame
    parsed: DataFrame
    fixes: DataFrame
    declared: DataFrame


def analyze(spark: SparkSession, start: str | Path, production: bool | None = None, strict: bool = False, confidence: str | None = None, include: list[str] = (), exclude: list[str] = ()) -> Report:
    """All rules over the project at or above ``start``."""
    x = gather(Path(start), production, confidence)
    how, kind = mode(x), x.layout.kind
    library = how == "library"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = tree.load(spark, x.root, x.config, list(x.config.project) or None)
    parsed = keep(pyast.parsed(files, kind))
    names = files.select("path", "kind", "context").join(parsed.select("path", F.col("has_opaque_dynamic_import").alias("opaque")), "path", "left").withColumn("opaque", F.coalesce("opaque", F.lit(False)))
    names = keep(names)

    # what imports what
    index = resolve.module_index(names, kind, x.layout.packages)
    edges = pyast.edges(parsed).join(index.withColumnRenamed("path", "dst"), "module").select(F.col("path").alias("src"), "dst", "module", "line")
    edges = keep(edges)

    # entries
    seen = [(p, sym, c, o, i) for i, (p, sym, c, o) in enumerate(candidates(x))]
    points = [(*_target(t), f"{g}:{n}", len(seen) + i) for i, (n, t, g, _) in enumerate(x.manifest.entry_points)]
    points += [(m, sym, f"plugin:{p}", len(seen) + len(points) + i) for i, (p, m, sym, _) in enumerate(x.hints.symbols)]
    targets = frame(points, "module string, symbol string, origin string, seq int")
    found = targets.join(resolve.module_paths(targets, names, kind), "module").where("path is not null")
    roots = frame(seen, "path string, symbol string, context string, origin string, seq int").unionByName(found.select("path", "symbol", F.lit("runtime").alias("context"), "origin", "seq"))
    if x.config.production:
        roots = roots.where("context = 'runtime'")
    entries = keep(emit.merge_entries(roots))
    hinted = frame([(m,) for _, m, _ in x.hints.modules], "module string")
    seeds = entries.select(F.col("path").alias("node")).union(hinted.join(index, "module").select("path"))
    reached = keep(closure.reach(edges, seeds, [F.col("line")]))
    framework = names.where(s.matches(F.col("path"), x.hints.globs)).select("path")
    live = reached.select("node").union(framework).distinct()

    # where imports come from
    imports = pyast.relation(parsed, "imports")
    dynamic = pyast.relation(parsed, "dynamic_imports").select("path", "importer", "module", "line")
    sites = imports.select("path", "importer", "module", "line", "context", "optional", "platform_guarded").unionByName(dynamic.withColumns({"context": F.lit("runtime"), "optional": F.lit(False), "platform_guarded": F.lit(False)}))
    minor = requirements.target_minor(x.config.target_version, x.manifest.metadata.get("requires-python"))
    installed, commands = dims.installed(x.root)
    own_names = [*x.layout.packages, *([x.manifest.metadata["name"]] if "name" in x.manifest.metadata else [])]
    member_names = workspace_names(x)
    pairs = "import_root string, distribution string"
    resolved = resolve.resolve(
        sites,
        frame([(n,) for n in sorted(dims.stdlib(minor))], "name string"),
        frame([(n,) for n in own_names], "name string"),
        frame(member_names, "name string, member string"),
        frame(installed, pairs),
        frame([(i, requirements.normalize(d)) for d, roots_ in x.config.package_module_map.items() for i in roots_], pairs),
        frame(dims.bundled(), pairs),
    ).join(names.select("path", F.col("context").alias("file_context")), "path")
    owned = resolve.owners(names.select("path"), frame([(m.path, m.id) for m in x.members], "path string, id string"))
    resolved = keep(resolved.drop("member").join(owned, "path"))

    # rules
    rows = [_unused_files(names, live, framework, library, x), *_dependency_rules(spark, x, resolved, live, commands, strict)]
    rows += _symbol_rules(spark, x, parsed, imports, live, entries, resolved, library)
    everything = rows[0]
    for r in rows[1:]:
        everything = everything.unionByName(r)
    everything = keep(ordinals(everything.drop("seq"), ORDER, "seq"))
    directives = pyast.relation(parsed, "ignores")
    issues = emit.emit(everything, directives, x.config.severity, x.config.ignore, x.config.confidence, strict, include, exclude)
    issues = keep(issues.select(*ISSUE))
    declared = declared_table(spark, x)
    fixes = emit.fix_plan(issues.where("disposition is null"), declared.withColumnRenamed("where", "at"))
    return Report(x, how, issues, reached, entries, edges, names, parsed, fixes, declared)


def _candidates(rows: DataFrame, code: str, kind: str, message, **cols) -> DataFrame:
    """Rows as candidates; columns that a rule does not have are null."""
    none = F.lit(None)
    at = {c: cols.get(c, none) for c in ("path", "module", "name", "line", "member", "manifest_file", "manifest_label")}
    return rows.select(
        F.lit(code).alias("code"), F.lit(kind).alias("kind"), *[v.cast("int" if c == "line" else "string").alias(c) for c, v in at.items()], "severity", "confidence",
        message.alias("message"), cols.get("summary", message).alias("summary"), F.lit(0).alias("seq"),
    )


def _unused_files(names, live, framework, library, x) -> DataFrame:
    rows = symbols.unused_files(names, live, framework, library, x.config.production)
    return _candidates(rows, "TL001", "file", F.concat(F.lit("file is not reachable from any entry: "), "path"), path=F.col("path"))


DECLARED = "distribution string, kind string, label string, marker string, opaque boolean, from_setup_py boolean, file string, where string, seq int, member string"


def fix_targets(x: Inputs) -> list[tuple]:
    """member, file and supported of the manifests that missing distributions may be added to."""
    own = [(m.id, f"{m.path}/pyproject.toml", requirements.can_add(x.member_manifests[m.id])) for m in x.members if m.id in x.member_manifests]
    return [(None, "pyproject.toml", requirements.can_add(x.manifest)), *own]


def declared_table(spark: SparkSession, x: Inputs) -> DataFrame:
    """Everything declared."""
    return spark.createDataFrame([(*d[:8], i, d[8]) for i, d in enumerate(declared_rows(x))], DECLARED)


def declared_rows(x: Inputs) -> list[tuple]:
    """distribution, kind, label, marker, opaque, from_setup_py, file, where and member; groups that are configured as run-time ones count as such."""
    runtime = set(x.config.dependencies["runtime_groups"])
    rows = []
    for member, m in [(None, x.manifest), *x.member_manifests.items()]:
        for d in m.dependencies:
            kind = "runtime" if d.kind == "group" and d.label in runtime else d.kind
            rows.append((d.name, kind, d.label, d.marker, d.opaque, d.file == "setup.py", d.file, d.where, member))
    return rows


def _dependency_rules(spark, x, resolved, live, commands, strict) -> list[DataFrame]:
    declared = declared_table(spark, x)
    here = resolved.join(live.withColumnRenamed("node", "path"), "path", "left_semi").where("origin = 'third_party'")
    context = F.when(F.col("context") == "type", "type").when(F.col("file_context") != "runtime", F.col("file_context")).otherwise(F.col("context"))
    used = keep(here.select("distribution", context.alias("context"), "optional", "platform_guarded", F.col("path").alias("file"), "line", "module", "import_root", "member"))
    binaries = spark.createDataFrame([(b, f, n) for _, b, f, n in x.hints.binaries], "binary string, file string, line int")
    layers = [(b, d, 0, i) for i, (b, d) in enumerate(sorted(dims.BINARIES.items()))] + [(b, requirements.normalize(d), 1, i) for i, (b, d) in enumerate(sorted(x.config.binary_map.items()))] + [(b, d, 2, i) for i, (b, d) in enumerate(commands)]
    providers = resolve.overlay(spark.createDataFrame(layers, "binary string, distribution string, layer int, seq int"))
    by_command = binaries.join(providers, "binary", "left").select(F.coalesce("distribution", "binary").alias("distribution"))
    hinted = spark.createDataFrame([(requirements.normalize(m.split(".")[0]),) for _, m, _ in x.hints.modules] + [(d,) for d in x.hints.distributions] + [(requirements.normalize(x.manifest.metadata.get("name", "")),)], "distribution string")
    # every import counts as a use, whatever its context
    seen = names_of(resolved.where("origin = 'third_party'").select("distribution"), by_command, hinted, *([resolved.where("origin = 'first_party'").select(s.normalize_name(F.col("import_root")).alias("distribution"))]))
    closure_ = dependencies.lock_closure(declared, spark.createDataFrame(x.manifest.lock, "src string, dst string"))
    d = F.col("distribution")
    out = []
    top = declared.where("member is null")
    rows = dependencies.unused(declared, seen, strict, x.config.production)
    out.append(_candidates(rows, "TL002", "distribution", F.concat(F.lit("declared but not used: "), d), name=d, manifest_file=F.col("file"), manifest_label=F.col("where"), member=F.col("member"), summary=F.concat(d, F.lit(" is declared in "), "file", F.lit(" and never used"))))
    lock_note = F.lit("") if x.manifest.lock else F.lit(" (no lockfile)")
    why = F.when(F.col("optional"), " (optional import)").when(F.col("platform_guarded"), " (platform-guarded)").otherwise("")
    local = F.lit(None).cast("string")
    missing = dependencies.missing(used, declared, closure_, strict).withColumn("_m", local)
    if strict and x.members:
        # strictly, a member must declare what it uses itself
        for m in x.members:
            mine = declared.where(F.col("member") == m.id)
            more = dependencies.undeclared(used.where(F.col("member") == m.id), mine, True).join(names_of(missing), "distribution", "left_anti")
            missing = missing.unionByName(more.withColumn("_m", F.lit(m.id)))
    text = F.concat(F.lit("imported but not declared: "), d, why, lock_note, F.when(F.col("_m").isNotNull(), F.concat(F.lit(" in workspace member "), "_m")).otherwise(""))
    out.append(_candidates(missing, "TL003", "import", text, path=F.col("file"), module=F.col("import_root"), line=F.col("line"), member=F.col("_m"), summary=F.concat(d, F.lit(" is imported but not declared"))))
    rows = dependencies.transitive(used, declared, closure_, strict)
    out.append(_candidates(rows, "TL004", "import", F.concat(F.lit("only there through another dependency: "), d), path=F.col("file"), module=F.col("import_root"), line=F.col("line"), summary=F.concat(d, F.lit(" is a transitive dependency"))))
    rows = dependencies.misplaced(used, top if not (strict and x.members) else declared)
    out.append(_candidates(rows, "TL005", "distribution", F.concat(F.lit("used at run time but declared for development: "), d), name=d))
    rows = dependencies.unlisted(binaries, providers, declared)
    rows = rows.where(d != requirements.normalize(x.manifest.metadata.get("name", "")))
    out.append(_candidates(rows, "TL008", "binary", F.concat(F.lit("command "), "binary", F.lit(" is used, but "), d, F.lit(" is not declared")), name=F.col("binary"), manifest_file=F.col("file"), line=F.col("line")))
    rows = dependencies.duplicates(top)
    out.append(_candidates(rows, "TL009", "distribution", F.concat(F.lit("declared more than once: "), d, F.lit(" in "), F.array_join("contexts", ", ")), name=d))
    return out


def names_of(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("distribution")
    for f in frames[1:]:
        out = out.union(f.select("distribution"))
    return out.distinct()


def _symbol_rules(spark, x, parsed, imports, live, entries, resolved, library) -> list[DataFrame]:
    kind = x.layout.kind
    module = s.index_module(F.col("path"), kind, x.layout.packages)
    flag = live.select(F.col("node").alias("path"), F.lit(True).alias("reachable"))
    mods = parsed.select("path", module.alias("module"), "exports").join(flag, "path", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    mods = keep(mods.where("module is not null"))
    syms = pyast.relation(parsed, "symbols").drop("importer").join(mods, "path")
    syms = syms.withColumns({"decorated": F.size("decorators") > 0, "exported": F.coalesce(F.array_contains("exports", F.col("name")), F.lit(False))})
    made = imports.drop("importer").join(mods.select("path", F.col("module").alias("importer"), "reachable"), "path")
    refs = keep(symbols.references(made, pyast.relation(parsed, "attribute_accesses")))
    outside = entries.where("symbol is not null").join(mods.select("path", "module"), "path").select("module", F.col("symbol").alias("name"))
    outside = outside.union(spark.createDataFrame([(m, n) for _, m, n, _ in x.hints.symbols], "module string, name string"))
    rows = symbols.unused_exports(syms, refs, outside, library)
    out = [_candidates(rows, "TL006", "symbol", F.concat(F.lit("never used outside its module: "), "module", F.lit(":"), "name"), path=F.col("path"), module=F.col("module"), name=F.col("name"), line=F.col("line"))]
    again = made.where("reachable and relative_level > 0 and name is not null and path like '%\\_\\_init\\_\\_.py'").join(mods.select("path", "exports"), "path")
    again = again.select("path", F.col("importer").alias("package"), F.coalesce("alias", "name").alias("name"), "line", F.coalesce(F.array_contains("exports", F.coalesce("alias", "name")), F.lit(False)).alias("exported"))
    rows = symbols.unused_reexports(again, refs, library)
    out.append(_candidates(rows, "TL007", "symbol", F.concat(F.lit("re-exported but never used: "), "package", F.lit(":"), "name"), path=F.col("path"), module=F.col("package"), name=F.col("name"), line=F.col("line")))
    rows = symbols.unresolved(resolved, live)
    out.append(_candidates(rows, "TL010", "import", F.concat(F.lit("cannot be resolved: "), "import_root"), path=F.col("path"), module=F.col("import_root"), line=F.col("line")))
    return out


def probe(spark: SparkSession, start: str | Path, production: bool | None = None) -> dict:
    """Counts of files by kind and context, before anything is parsed."""
    x = gather(Path(start), production)
    files = tree.load(spark, x.root, x.config, list(x.config.project) or None)
    rows = files.groupingSets([["kind"], ["context"]], "kind", "context").agg(F.count("*").alias("n")).collect()
    return {"root": str(x.root), "marker": x.marker, "layout": x.layout.kind, "packages": x.layout.packages, "files": len(x.paths), "kinds": {r.kind: r.n for r in rows if r.kind}, "contexts": {r.context: r.n for r in rows if r.context}, "dependencies": len(x.manifest.dependencies), "warnings": x.warnings}


def trace(report: Report, path: str) -> list[str]:
    """The way to a reached file, or why it is not: its importers and whether they are reached."""
    path = path.replace("\\", "/").removeprefix("./")
    # in order of steps, which are as many as the depth of the file
    rows = closure.paths(report.reached, report.reached.select("node").where(F.col("node") == path)).orderBy("step").collect()
    if rows:
        return [f"{path} is reached", *[f"  {'<- ' if i else ''}{r.at}" for i, r in enumerate(rows)]]
    into = closure.importers(report.edges, report.reached, F.col("dst") == path).orderBy("src", "line").collect()
    out = [f"{path} is not reached" if report.files.where(F.col("path") == path).count() else f"{path} is no file of the project"]
    return out + [f"  imported by {r.src}:{r.line} ({'reached' if r.reachable else 'not reached'})" for r in into]


def explain(report: Report, selector: str) -> list[str]:
    """Summary and details of the first finding of a code (CODE:subject)."""
    code, _, subject = selector.partition(":")
    about = F.lit(False)
    for c in ("target", "name", "path", "module"):
        about = about | F.coalesce(F.col(c) == subject, F.lit(False))
    rows = report.issues.where((F.col("code") == code) & about)
    row = rows.orderBy("sort_key").limit(1).collect()
    if not row:
        return [f"no finding {selector}"]
    r = row[0]
    return [r.summary, f"  {r.message}", f"  severity {r.severity}, confidence {r.confidence}, {r.disposition or 'reported'}"]
