"""Findings as text: for people, for scripts, for code hosts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

VERSION = "0.1.0"
#: Titles and explanations of the rules.
RULES = {
    "TL001": ("unused file", "No entry of the project reaches the file."),
    "TL002": ("unused dependency", "A declared dependency is neither imported nor run nor named by any configuration."),
    "TL003": ("missing dependency", "A distribution is imported that the project does not declare."),
    "TL004": ("transitive dependency", "A distribution is imported that is there only because another dependency needs it."),
    "TL005": ("misplaced dependency", "A dependency is declared for another context than that of its use."),
    "TL006": ("unused export", "A public name is used nowhere outside its module."),
    "TL007": ("unused re-export", "A package offers a name of one of its modules, and nobody takes it from there."),
    "TL008": ("unlisted binary", "A command is run whose distribution is not declared."),
    "TL009": ("duplicate dependency", "A distribution is declared in several contexts."),
    "TL010": ("unresolved import", "An import is neither of the project nor of anything known."),
}
DEFAULT_LEVEL = {"TL006": "warning", "TL007": "warning", "TL005": "warning", "TL008": "warning", "TL009": "warning", "TL010": "warning"}


@dataclass
class Context:
    project: str | None = None
    config: list[str] = field(default_factory=list)
    mode: str = "app"
    production: bool = False
    suppressed: int = 0


def rows(issues) -> list[dict]:
    """Reported findings in order: by rule, subject and the order they were found in."""
    found = [r.asDict() for r in issues.where("disposition is null").collect()]
    return sorted(found, key=lambda r: (r["code"], r["sort_key"] or ""))


def subject(r: dict) -> str:
    if r["kind"] == "file":
        return r["path"]
    if r["kind"] in ("distribution", "binary"):
        return r["name"]
    return f"{r['module']}:{r['name']}" if r["kind"] == "symbol" else r["module"]


def location(r: dict) -> str:
    file = r["path"] or r["manifest_file"] or "-"
    return f"{file}:{r['line']}" if r["line"] and file != "-" else file


def default(found: list[dict], c: Context) -> str:
    out = [f"treelens {VERSION}", "", f"Project: {c.project or '(unknown)'}", f"Config : {', '.join(c.config) or 'defaults'}", f"Mode   : {c.mode}, production={str(c.production).lower()}", ""]
    for code, (title, _) in RULES.items():
        mine = [r for r in found if r["code"] == code]
        if mine:
            out.append(f"{code} {title} ({len(mine)})")
            out += [f"  {r['severity']:<7} {subject(r)}  {location(r)}  {r['message']} [{r['confidence']}]" for r in mine]
            out.append("")
    more = f" ({c.suppressed} baseline-suppressed)" if c.suppressed else ""
    return "\n".join([*out, f"Summary: {len(found)} issues{more}", ""])


def compact(found: list[dict], c: Context) -> str:
    out = [f"{r['code']} {r['severity']} {r['confidence']} {subject(r)} {location(r)}" for r in found] or [f"treelens {VERSION}: no issues ({c.mode})"]
    return "\n".join(out + [f"baseline suppressed {c.suppressed}"] * bool(c.suppressed) + [""])


def as_json(found: list[dict], c: Context) -> str:
    by: dict[str, int] = {}
    for r in found:
        by[r["code"]] = by.get(r["code"], 0) + 1
    issues = [
        {"code": r["code"], "severity": r["severity"], "confidence": r["confidence"], "subject": subject(r), "kind": r["kind"], "target": r["target"], "fingerprint": r["fingerprint"], "file": r["path"], "line": r["line"], "module": r["module"], "name": r["name"], "manifest": r["manifest_file"] and {"file": r["manifest_file"], "label": r["manifest_label"]}, "workspace_member": r["member"], "message": r["message"]}
        for r in found
    ]
    return json.dumps({"schema_version": "1", "version": VERSION, "project": c.project or "(unknown)", "mode": c.mode, "production": c.production, "issues": issues, "summary": {"total": len(found), "by_code": by}, "suppressed": {"baseline": c.suppressed}}, indent=2, ensure_ascii=False)


def markdown(found: list[dict], c: Context) -> str:
    out = [f"# treelens report: {c.project or '(unknown)'}", "", f"- Version: `{VERSION}`", f"- Mode: `{c.mode}` (production={str(c.production).lower()})", f"- Issues: **{len(found)}**"]
    out += [f"- Baseline suppressed: **{c.suppressed}**"] * bool(c.suppressed) + [""]
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ")
    for code, (title, _) in RULES.items():
        mine = [r for r in found if r["code"] == code]
        if mine:
            out += [f"## {code} {title} ({len(mine)})", "", "| Code | Subject | Location | Message |", "| --- | --- | --- | --- |"]
            out += [f"| {code} | `{cell(subject(r))}` | `{cell(location(r))}` | {cell(r['message'])} |" for r in mine] + [""]
    return "\n".join(out + ["_No issues found._"] * (not found) + [""])


def github(found: list[dict], c: Context) -> str:
    plain = lambda s: s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    prop = lambda s: plain(s).replace(":", "%3A").replace(",", "%2C")
    out = []
    for r in found:
        level = {"error": "error", "warning": "warning"}.get(r["severity"], "notice")
        file = r["path"] or r["manifest_file"]
        at = ([f"file={prop(file)}"] if file else []) + ([f"line={r['line']}"] if r["line"] else [])
        out.append(f"::{level} {','.join([*at, f'title={r["code"]} {prop(subject(r))}'])}::{plain(r['message'])}")
    return "\n".join(out + [f"treelens: baseline suppressed {c.suppressed} issues"] * bool(c.suppressed) + [""])


def sarif(found: list[dict], c: Context) -> str:
    level = lambda s: {"error": "error", "warning": "warning"}.get(s, "note")
    rules = [{"id": k, "shortDescription": {"text": t}, "fullDescription": {"text": h}, "defaultConfiguration": {"level": level(DEFAULT_LEVEL.get(k, "error"))}} for k, (t, h) in RULES.items()]
    results = []
    for r in found:
        one = {"ruleId": r["code"], "level": level(r["severity"]), "message": {"text": r["message"]}, "partialFingerprints": {"treelens/v1": r["fingerprint"]}}
        if file := r["path"] or r["manifest_file"]:
            place: dict = {"artifactLocation": {"uri": file}}
            if r["line"]:
                place["region"] = {"startLine": r["line"]}
            one["locations"] = [{"physicalLocation": place}]
        results.append(one)
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "treelens", "semanticVersion": VERSION, "rules": rules}}, "results": results}]}, indent=2, ensure_ascii=False)


REPORTERS = {"default": default, "compact": compact, "json": as_json, "markdown": markdown, "github": github, "sarif": sarif}
