"""What each of many projects is, found by tasks: one group is the file names and configuration files of one project.

Sources are not in it; they are parsed file by file. Every fact is a row
(project, fact, seq, value as JSON), so that all rules are joins on the project.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.globs import any_glob, literal_folder
from treelens.session import tasks, uncollected
from treelens.sources import dims, plugins, requirements, tree
from treelens.sources.folder import Folder
from treelens.sources.pyast import file_module

#: Files whose content says what a project is, by path (fixed values), and sources that tool plugins read.
CONFIGURATION = (
    r"(^|/)(pyproject\.toml|setup\.cfg|setup\.py|uv\.lock|\.gitignore|\.?treelens\.toml|tox\.ini|pytest\.ini|alembic\.ini|mkdocs\.ya?ml|\.pre-commit-config\.yaml|\.flaskenv|\.env"
    r"|conftest\.py|manage\.py|settings\.py|[^/]*\.(txt|in)|[^/]*\.dist-info/[A-Za-z_]+|py\.typed)$|^(scripts|bin)/[^/]+$|^docs/conf\.py$|^\.github/workflows/[^/]*\.ya?ml$"
)
#: Sources whose text the plugins for decorated functions look into.
DECORATED = r"(?m)^\s*@\w[\w.]*(\.(route|get|post|put|delete|patch)\(|shared_task|\.task\b)|^\s*@shared_task\b"
SCHEMA = "project string, fact string, seq int, value string"
#: Facts, about, that a task gives out at a time.
BATCH = 10000
#: First parts of a project's own modules are told with each file up to so many.
ROOTS = 20

#: The fields of each fact; those of a file that are its project's spare a join.
PROJECT = "library boolean, production boolean, layout string, minor int, floor string, name string, has_lock boolean, has_members boolean, can_add boolean"
FILE = "path string, kind string, context string, layout string, module string, library boolean, production boolean, minor int, roots array<string>"
ENTRY = "path string, symbol string, context string, origin string"
POINT = "module string, symbol string, origin string, layout string"
DECLARED = "distribution string, kind string, label string, marker string, opaque boolean, from_setup_py boolean, file string, `where` string, member string"
PATTERN = "code string, folder string, regex string, name_regex string"


def importable(path: str, layout: str, packages: list[str]) -> str | None:
    """Module by which a file can be imported, as functions.scalars.index_module says."""
    below = path[4:] if path.startswith("src/") else None
    flat = path if path.split("/", 1)[0].removesuffix(".py") in packages else None
    kept = below if layout == "src" else flat if layout == "flat" else below if below is not None else flat
    return file_module(kept, "") or None if kept is not None and path.endswith(".py") else None


def facts(root: Folder, production: bool | None = None, confidence: str | None = None) -> Iterator[tuple[str, dict]]:
    """(fact, fields) of one project. Raises ValueError where its configuration cannot be used."""
    from treelens.plans import project as plan

    x = plan.gather_at(root, "", production, confidence)
    how = plan.mode(x)
    kind, c, m = x.layout.kind, x.config, x.manifest
    own = m.metadata.get("name")
    minor = requirements.target_minor(c.target_version, m.metadata.get("requires-python"))
    yield "project", {"library": how == "library", "production": c.production, "layout": kind, "minor": minor, "floor": c.confidence, "name": requirements.normalize(own or ""), "has_lock": bool(m.lock), "has_members": bool(x.members), "can_add": requirements.can_add(m)}
    for w in x.warnings:
        yield "warning", {"message": w}
    modules = [importable(p, kind, x.layout.packages) for p in x.paths]
    roots = sorted({m.split(".", 1)[0] for m in modules if m})
    roots = roots if len(roots) <= ROOTS else None
    for p, module in zip(x.paths, modules):
        yield "file", {"path": p, "kind": tree.KINDS[p[p.rindex(".") :].lower()], "context": tree.context(p), "layout": kind, "module": module, "roots": roots, "library": how == "library", "production": c.production, "minor": minor}
    for path, symbol, context, origin in plan.candidates(x):
        if context == "runtime" or not c.production:
            yield "entry", {"path": path, "symbol": symbol, "context": context, "origin": origin}
    for name, target, group, _ in m.entry_points:
        module, symbol = plan._target(target)
        yield "point", {"module": module, "symbol": symbol, "origin": f"{group}:{name}", "layout": kind}
    for plugin, module, symbol, _ in x.hints.symbols:
        yield "point", {"module": module, "symbol": symbol, "origin": f"plugin:{plugin}", "layout": kind}
        yield "hint_symbol", {"module": module, "name": symbol}
    for _, module, _ in x.hints.modules:
        yield "hint_module", {"module": module}
    for distribution in (*x.hints.distributions, *(requirements.normalize(h.split(".")[0]) for _, h, _ in x.hints.modules), requirements.normalize(own or "")):
        yield "hinted", {"distribution": distribution}
    for _, binary, file, line in x.hints.binaries:
        yield "binary", {"binary": binary, "file": file, "line": line}
    if x.hints.globs:
        loaded = re.compile(any_glob(x.hints.globs), re.S)
        for p in x.paths:
            if loaded.match(p):
                yield "framework", {"path": p}
    for d in plan.declared_rows(x):
        yield "declared", dict(zip([f.split()[0].strip("`") for f in DECLARED.split(", ")], d))
    for src, dst in m.lock:
        yield "lock", {"src": src, "dst": dst}
    installed, commands = dims.installed(root)
    for i, d in installed:
        yield "installed", {"import_root": i, "distribution": d}
    for d, roots in c.package_module_map.items():
        for i in roots:
            yield "user", {"import_root": i, "distribution": requirements.normalize(d)}
    for binary, d in sorted(c.binary_map.items()):
        yield "command", {"binary": binary, "distribution": requirements.normalize(d), "layer": 1}
    for binary, d in commands:
        yield "command", {"binary": binary, "distribution": d, "layer": 2}
    for name in [*x.layout.packages, *([own] if own is not None else [])]:
        yield "own", {"name": name}
    can_add = {member: can for member, _, can in plan.fix_targets(x)}
    for member in x.members:
        yield "member", {"path": member.path, "id": member.id, "can_add": can_add.get(member.id, False)}
    for name, member in plan.workspace_names(x):
        yield "member_name", {"name": name, "member": member}
    for code, level in c.severity.items():
        yield "severity", {"code": code, "level": level}
    for code, globs in c.ignore.items():
        for g in globs:
            where, colon, name = g.rpartition(":")
            if not colon:
                yield "ignore", {"code": code, "folder": literal_folder(g), "regex": any_glob([g]), "name_regex": None}
            elif code in ("TL006", "TL007"):
                yield "ignore", {"code": code, "folder": literal_folder(where), "regex": any_glob([where]), "name_regex": any_glob([name])}


def of_projects(files: DataFrame, production: bool | None = None, confidence: str | None = None) -> DataFrame:
    """The facts of every project of ``files`` (project, path, content); a single ``error`` where a configuration cannot be used.

    A task has its projects one after the other, as a group for each would cost more than what is done in it.
    """
    import pyarrow as pa

    def told(project: str, held: dict[str, bytes | None]) -> list[tuple]:
        with uncollected():
            try:
                found = list(facts(Folder(held), production, confidence))
            except ValueError as e:
                found = [("error", {"message": str(e)})]
            return [(project, fact, i, json.dumps(value)) for i, (fact, value) in enumerate(found)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["project", "fact", "seq", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, held, out = None, {}, []
        for x in batches:
            for at, path, content in zip(*(c.to_pylist() for c in x.columns)):
                if held and at != project:
                    out += told(project, held)
                    held = {}
                    if len(out) >= BATCH:
                        yield batch(out)
                        out = []
                project = at
                held[path] = bytes(content) if content is not None else None
        if held:
            out += told(project, held)
        if out:
            yield batch(out)

    wanted = F.col("path").rlike(CONFIGURATION) | (F.col("path").endswith(".py") & F.decode("content", "UTF-8").rlike(DECORATED))
    names = files.select("project", "path", F.when(wanted, F.col("content")).alias("content"))
    dealt = names.where("project is not null and path is not null").repartition(tasks(files.sparkSession), "project").sortWithinPartitions("project", "path")
    return dealt.mapInArrow(run, SCHEMA)


def relation(found: DataFrame, fact: str, fields: str) -> DataFrame:
    """The rows of one fact: project, seq and its fields."""
    return found.where(F.col("fact") == fact).select("project", "seq", F.from_json("value", fields).alias("v")).select("project", "seq", "v.*")


__all__ = ["facts", "importable", "of_projects", "relation"]
