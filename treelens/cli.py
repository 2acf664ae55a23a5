"""Command line: ``python -m treelens.cli PATH``. Exit status 0, 1 (findings), 2 (configuration), 3 (anything else)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from treelens.functions.scalars import CONFIDENCE
from treelens.operators import emit
from treelens.plans import project
from treelens.sinks import baseline, fixes, reports
from treelens.sources.config import ConfigError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treelens", description="Finds unused files, dependencies and names in a Python project.")
    p.add_argument("path", nargs="?", default=".", help="folder to analyse")
    p.add_argument("--project-root", help="where the search for the project's root begins")
    for name, text in {
        "production": "run-time files only", "strict": "strict policies", "no-exit-code": "always exit with 0", "fix": "apply safe fixes", "dry-run": "show fixes only (with --fix)",
        "allow-remove-files": "fixes may remove files", "add-missing": "fixes may declare what is missing", "update-baseline": "write the findings to the baseline",
        "no-cache": "parse everything anew", "probe": "count files only", "init": "append a starter configuration",
    }.items():
        p.add_argument(f"--{name}", action="store_true", help=text)
    codes = lambda s: s.split(",")
    p.add_argument("--include", type=codes, default=[], help="only these rules (comma-separated)")
    p.add_argument("--exclude", type=codes, default=[], help="not these rules")
    p.add_argument("--reporter", choices=sorted(reports.REPORTERS), default="default")
    p.add_argument("--confidence", choices=sorted(CONFIDENCE))
    p.add_argument("--explain", metavar="CODE:SUBJECT")
    p.add_argument("--trace", metavar="PATH")
    p.add_argument("--baseline", type=Path)
    p.add_argument("-V", "--version", action="version", version=reports.VERSION)
    return p


def conflict(a: argparse.Namespace) -> str | None:
    """What is wrong with a combination of flags."""
    for name in ("dry_run", "allow_remove_files", "add_missing"):
        if getattr(a, name) and not a.fix:
            return f"--{name.replace('_', '-')} needs --fix"
    if a.update_baseline and not a.baseline:
        return "--update-baseline needs --baseline"
    if a.init and a.probe:
        return "--init and --probe exclude each other"
    other = (a.fix, a.production, a.strict, a.no_exit_code, a.include, a.exclude, a.reporter != "default", a.confidence, a.baseline, a.no_cache, a.explain, a.trace)
    return "--init stands alone" if a.init and any(other) else None


def session() -> SparkSession:
    return SparkSession.builder.appName("treelens").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    say = lambda lines: print(*lines, sep="\n", file=sys.stderr)
    if wrong := conflict(a):
        say([wrong])
        return 2
    start = Path(a.project_root or a.path)
    try:
        if a.init:
            say([f"written: {fixes.init(start)}"])
            return 0
        spark = spark or session()
        if a.probe:
            print(json.dumps(project.probe(spark, start, a.production), indent=2))
            return 0
        r = project.analyze(spark, start, a.production, a.strict, a.confidence, a.include, a.exclude)
        issues, failed, held = r.issues, emit.fails(r.issues, a.strict).first().failed, 0
        if a.baseline and a.update_baseline:
            say([f"baseline: {baseline.write(issues, r.inputs.root, a.baseline)} findings"])
        if a.baseline:
            issues = emit.against_baseline(issues, baseline.read(spark, baseline.inside(r.inputs.root, a.baseline)))
            held = issues.where("disposition = 'baseline'").count()
        found = reports.rows(issues)
        failed = failed and bool(found)
        if a.fix:
            say(fixes.apply(plan(r, a), r.inputs.root, a.dry_run))
        say(r.inputs.warnings)
        if a.explain:
            say(project.explain(r, a.explain))
        if a.trace:
            say(project.trace(r, a.trace))
        c = reports.Context(r.inputs.manifest.metadata.get("name"), r.inputs.used, r.mode, r.inputs.config.production, held)
        print(reports.REPORTERS[a.reporter](found, c))
        return int(failed and not a.no_exit_code)
    except (ConfigError, ValueError) as e:
        say([str(e)])
        return 2
    except OSError as e:
        say([str(e)])
        return 3


def plan(r: project.Report, a: argparse.Namespace) -> list[dict]:
    """The fix plan on the driver: the findings of one project, with the places of their declarations."""
    d = r.declared.withColumnsRenamed({"label": "group", "where": "label"})
    targets = r.issues.sparkSession.createDataFrame(project.fix_targets(r.inputs), "member string, file string, supported boolean") if a.add_missing else None
    found = emit.fix_plan(r.issues.where("disposition is null"), d, a.allow_remove_files, targets=targets)
    rows = [x.asDict() | {"where": x.label} for x in found.orderBy("code", "name", "path", "file").collect()]
    return rows


if __name__ == "__main__":
    sys.exit(main())
