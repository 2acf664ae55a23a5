"""Edits of manifests that a fix plan asks for; each file is written once, whole, and stays inside the project."""

from __future__ import annotations

import re
from pathlib import Path

from treelens.sinks.baseline import inside, replace_file
from treelens.sources.requirements import normalize, parse_spec, strip_comment


def _named(item: str, name: str) -> bool:
    found = parse_spec(item)
    return found is not None and found.name == name


def drop_from_array(text: str, table: str, key: str, name: str) -> tuple[str, str | None]:
    """A TOML text without the item of an array that declares ``name``, and that item; comments and layout stay."""
    head = re.search(rf"^\[{re.escape(table)}\][ \t]*(?:#.*)?$", text, re.M)
    if not head:
        return text, None
    end = re.compile(r"^\[", re.M).search(text, head.end())
    end = end.start() if end else len(text)
    start = re.compile(rf"^[ \t]*(?:{re.escape(key)}|\"{re.escape(key)}\")[ \t]*=[ \t]*\[", re.M).search(text, head.end(), end)
    if not start:
        return text, None
    for m in re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')|#[^\n]*|(\])", re.M).finditer(text, start.end()):
        if m[2]:
            break
        if m[1] and _named(m[1][1:-1], name):
            a, b = m.start(), m.end()
            after = re.compile(r"[ \t]*,?").match(text, b).end()
            line = text.rfind("\n", 0, a) + 1
            if not text[line:a].strip() and text[after : after + 1] == "\n":
                a, after = line, after + 1  # a line of its own
            elif text[after - 1 : after] == ",":
                after = re.compile(r"[ \t]*").match(text, after).end()
            else:
                a = re.compile(r",?[ \t]*$").search(text, start.end(), a).start()
            return text[:a] + text[after:], m[1]
    return text, None


def add_to_array(text: str, table: str, key: str, item: str) -> str | None:
    """A TOML text with one item more at the end of an array; None if the array is not there."""
    head = re.search(rf"^\[{re.escape(table)}\][ \t]*(?:#.*)?$", text, re.M)
    start = head and re.compile(rf"^[ \t]*{re.escape(key)}[ \t]*=[ \t]*\[", re.M).search(text, head.end())
    if not start:
        return None
    for m in re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|#[^\n]*|(\])").finditer(text, start.end()):
        if m[1]:
            body = text[start.end() : m.start()]
            bare = re.sub(r"#[^\n]*", "", body).rstrip()
            comma = "" if not bare.strip() or bare.endswith(",") else ","
            cut = start.end() + len(body.rstrip())
            new = f"{comma}\n    {item},\n" if "\n" in body else f"{comma}{' ' if bare.strip() else ''}{item}"
            return text[:cut] + new + text[m.start() :]
    return None


def drop_line(text: str, name: str) -> str:
    """A requirements text without the lines that declare ``name``."""
    keep = [x for x in text.splitlines(keepends=True) if not _named(re.split(r"\s--", strip_comment(x))[0], name)]
    return "".join(keep)


def split_where(where: str) -> tuple[str, str] | None:
    """Table and key of a place in pyproject.toml; None where dependencies are no array."""
    for prefix in ("project.optional-dependencies.", "dependency-groups.", "tool.pdm.dev-dependencies.", "tool.pdm.optional-dependencies."):
        if where.startswith(prefix):
            return prefix[:-1], where[len(prefix) :]
    if where == "project.dependencies":
        return "project", "dependencies"
    return (where.rpartition(".")[0], "dependencies") if where.startswith("tool.hatch.envs.") else None


def edited(text: str, file: str, where: str, name: str) -> tuple[str, str | None]:
    """A manifest without a declaration, and what it was."""
    if file == "pyproject.toml":
        at = split_where(where)
        if at:
            return drop_from_array(text, *at, name)
        m = re.search(rf"^\[{re.escape(where)}\][^\n]*\n(?:(?!\[).*\n)*?([ \t]*[\"']?([\w.-]+)[\"']?[ \t]*=[^\n]*\n)", text, re.M)
        if m:
            for line in re.compile(r"^[ \t]*[\"']?([\w.-]+)[\"']?[ \t]*=[^\n]*\n?", re.M).finditer(text, m.start()):
                if normalize(line[1]) == name:
                    return text[: line.start()] + text[line.end() :], line[0]
        return text, None
    new = drop_line(text, name)
    return new, name if new != text else None


def apply(plan: list[dict], root: Path, dry_run: bool = False) -> list[str]:
    """What was done, or would be, for each row of a fix plan (action, name, file, label, path)."""
    texts: dict[str, str] = {}
    out, gone = [], []
    for r in plan:
        action, name = r["action"], r["name"]
        if not action:
            out.append(f"skipped {r['code']} {name or r['path']}: {r['reason']}")
            continue
        if action == "remove_file":
            gone.append(inside(root, Path(r["path"])))
            out.append(f"remove {r['path']}")
            continue
        file = r["file"]
        text = texts.get(file) or inside(root, Path(file)).read_text("utf-8")
        if action == "add_missing":
            new = add_to_array(text, "project", "dependencies", f'"{name}"')
            item = new
        else:
            new, item = edited(text, file, r["where"], name)
            if item and action == "move_to_runtime":
                new = add_to_array(new, "project", "dependencies", item)
        if not item or new is None:
            out.append(f"skipped {r['code']} {name}: unsupported_target")
            continue
        texts[file] = new
        out.append(f"{action} {name} in {file}")
    if not dry_run:
        for file, text in texts.items():
            replace_file(inside(root, Path(file)), text)
        for path in gone:
            path.unlink(missing_ok=True)
    return out


STARTER = """
[tool.treelens]
# entry = ["src/app/main.py"]
# mode = "auto"            # auto, app or library
confidence = "likely"    # certain, likely or maybe

[tool.treelens.ignore]
# TL001 = ["src/legacy/**"]
"""


def init(root: Path) -> str:
    """A starter configuration at the end of pyproject.toml; refused where there is one."""
    path = root / "pyproject.toml"
    text = path.read_text("utf-8") if path.is_file() else ""
    if re.search(r"^\[tool\.treelens[\].]", text, re.M) or (root / "treelens.toml").exists() or (root / ".treelens.toml").exists():
        raise ValueError("there is a configuration already")
    replace_file(path, text + ("\n" if text and not text.endswith("\n") else "") + STARTER.lstrip("\n" if not text else ""))
    return str(path)
