"""Dependency specifications, requirement files, and what setup scripts say, all read as text."""

from __future__ import annotations

import ast
import configparser
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

NAME = re.compile(r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(.*)$", re.S)


def normalize(name: str) -> str:
    return re.sub(r"[-_.]+", "-", "".join(c.lower() if c.isascii() else c for c in name))


@dataclass(frozen=True)
class Declared:
    """A declared dependency and where it stands."""

    name: str
    kind: str = "runtime"
    label: str | None = None
    extras: tuple[str, ...] = ()
    marker: str | None = None
    specifier: str | None = None
    file: str = ""
    line: int | None = None
    where: str = ""
    opaque: bool = False


@dataclass
class Manifest:
    dependencies: list[Declared] = field(default_factory=list)
    constraints: list[Declared] = field(default_factory=list)
    entry_points: list[tuple[str, str, str, str]] = field(default_factory=list)  # name, target, group, file
    lock: list[tuple[str, str]] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    pyproject: dict | None = None


def parse_spec(text: str) -> Declared | None:
    """A specification; None if it is none. URLs without a name are opaque."""
    spec, _, marker = text.strip().partition(";")
    m = NAME.match(spec.strip())
    rest = m[3].strip() if m else ""
    if m and (not rest or rest[0] in "<>=!~(@,"):
        extras = tuple(e.strip() for e in (m[2] or "").split(",") if e.strip())
        return Declared(normalize(m[1]), extras=extras, marker=marker.strip() or None, specifier=rest.strip("()").strip() or None, opaque=False)
    if egg := re.search(r"#egg=([A-Za-z0-9._-]+)", text):
        return Declared(normalize(egg[1]))
    if "://" in text or re.match(r"^(\.{0,2}/|[A-Za-z]:\\|file:)", text.strip()) or text.strip().endswith((".whl", ".zip", ".tar.gz")):
        return Declared("", opaque=True)
    return None


def _add(m: Manifest, items, file: str, where: str, kind: str = "runtime", label: str | None = None) -> None:
    for item in items if isinstance(items, list) else []:
        if not isinstance(item, str):
            continue
        found = parse_spec(item)
        if found is None:
            m.warnings.append(f"{file}: {item!r} is no dependency")
        else:
            m.dependencies.append(replace(found, kind=kind, label=label, file=file, where=where))


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def pyproject(path: Path, m: Manifest) -> None:
    """PEP 621 and 735 tables, and those of Poetry, PDM and Hatch. Raises ValueError for broken TOML."""
    file = path.name
    try:
        data = tomllib.loads(path.read_text("utf-8-sig"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"{file}: {e}") from None
    m.pyproject = data
    project = _table(data.get("project"))
    m.metadata |= {k: project[k] for k in ("name", "version", "requires-python", "dynamic") if k in project}
    if "dependencies" not in project.get("dynamic", []):
        _add(m, project.get("dependencies"), file, "project.dependencies")
    for extra, items in _table(project.get("optional-dependencies")).items():
        _add(m, items, file, f"project.optional-dependencies.{extra}", "optional", extra)
    for group, items in _table(data.get("dependency-groups")).items():
        _add(m, items, file, f"dependency-groups.{group}", "group", group)
    points = {"console": project.get("scripts"), "gui": project.get("gui-scripts")} | _table(project.get("entry-points"))
    for group, table in points.items():
        m.entry_points += [(k, v, group, file) for k, v in _table(table).items() if isinstance(v, str)]
    tool = _table(data.get("tool"))
    poetry = _table(tool.get("poetry"))
    groups = [("runtime", None, "tool.poetry.dependencies", poetry.get("dependencies")), ("group", "dev", "tool.poetry.dev-dependencies", poetry.get("dev-dependencies"))]
    groups += [("group", g, f"tool.poetry.group.{g}.dependencies", _table(t).get("dependencies")) for g, t in _table(poetry.get("group")).items()]
    for kind, label, where, table in groups:
        for name, value in _table(table).items():
            if name.lower() != "python":
                extras = tuple(_table(value).get("extras", ()))
                m.dependencies.append(Declared(normalize(name), kind, label, extras, file=file, where=where))
    for k in ("name", "version"):
        if k in poetry:
            m.metadata.setdefault(k, poetry[k])
    m.entry_points += [(k, v, "console", file) for k, v in _table(poetry.get("scripts")).items() if isinstance(v, str)]
    for group, items in _table(_table(tool.get("pdm")).get("dev-dependencies")).items():
        _add(m, items, file, f"tool.pdm.dev-dependencies.{group}", "group", group)
    for group, items in _table(_table(tool.get("pdm")).get("optional-dependencies")).items():
        _add(m, items, file, f"tool.pdm.optional-dependencies.{group}", "optional", group)
    for env, table in _table(_table(tool.get("hatch")).get("envs")).items():
        _add(m, _table(table).get("dependencies"), file, f"tool.hatch.envs.{env}.dependencies", "group", "dev" if env == "default" else env)


def setup_cfg(path: Path, m: Manifest) -> None:
    ini = configparser.RawConfigParser(strict=False, delimiters=("=", ":"), comment_prefixes=("#", ";"), interpolation=None)
    try:
        ini.read_string(path.read_text("utf-8-sig"))
    except configparser.Error as e:
        m.warnings.append(f"{path.name}: {e}")
        return
    for k, at in (("name", "name"), ("version", "version")):
        if ini.has_option("metadata", k):
            _conflict(m, at, ini.get("metadata", k), path.name)
    if ini.has_option("options", "python_requires"):
        _conflict(m, "requires-python", ini.get("options", "python_requires"), path.name)
    lines = lambda s: [x.strip() for x in s.splitlines() if x.strip() and not x.strip().startswith("#")]
    if ini.has_option("options", "install_requires"):
        _add(m, lines(ini.get("options", "install_requires")), path.name, "options.install_requires")
    if ini.has_section("options.extras_require"):
        for extra, text in ini.items("options.extras_require"):
            _add(m, lines(text), path.name, f"options.extras_require.{extra}", "setup_extra", extra)
    if ini.has_section("options.entry_points"):
        for group, text in ini.items("options.entry_points"):
            m.entry_points += [(k.strip(), v.strip(), {"console_scripts": "console", "gui_scripts": "gui"}.get(group, group), path.name) for k, _, v in (x.partition("=") for x in lines(text)) if v]


def _conflict(m: Manifest, key: str, value: str, file: str) -> None:
    if m.metadata.setdefault(key, value) != value:
        m.warnings.append(f"{file}: {key} is {value!r} here and {m.metadata[key]!r} elsewhere")


def setup_py(path: Path, m: Manifest) -> None:
    """Literal arguments of the first setup() call; the script is never run."""
    try:
        tree = ast.parse(path.read_text("utf-8", "replace"))
    except SyntaxError:
        m.warnings.append(f"{path.name}: not static")
        return
    call = next((n for n in ast.walk(tree) if isinstance(n, ast.Call) and (getattr(n.func, "id", None) == "setup" or getattr(n.func, "attr", None) == "setup")), None)
    if call is None:
        m.warnings.append(f"{path.name}: not static")
        return

    def items(node: ast.expr) -> list[str]:
        if not isinstance(node, ast.List | ast.Tuple):
            m.warnings.append(f"{path.name}: partially static")
            return []
        out = [e.value for e in node.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        if len(out) < len(node.elts):
            m.warnings.append(f"{path.name}: partially static")
        return out

    for k in call.keywords:
        if k.arg in ("name", "version", "python_requires") and isinstance(k.value, ast.Constant):
            _conflict(m, {"python_requires": "requires-python"}.get(k.arg, k.arg), k.value.value, path.name)
        elif k.arg == "install_requires":
            _add(m, items(k.value), path.name, "install_requires")
        elif k.arg == "extras_require" and isinstance(k.value, ast.Dict):
            for name, value in zip(k.value.keys, k.value.values):
                if isinstance(name, ast.Constant):
                    _add(m, items(value), path.name, f"extras_require.{name.value}", "setup_extra", name.value)
        elif k.arg == "entry_points" and isinstance(k.value, ast.Dict):
            for name, value in zip(k.value.keys, k.value.values):
                group = {"console_scripts": "console", "gui_scripts": "gui"}.get(getattr(name, "value", ""), getattr(name, "value", ""))
                m.entry_points += [(a.strip(), b.strip(), group, path.name) for a, _, b in (x.partition("=") for x in items(value)) if b]


def strip_comment(line: str) -> str:
    return re.sub(r"(^|\s)#.*$", "", line).strip()


#: Group of a requirements file by name (fixed values), for files that others include too.
def include_kind(name: str, kind: str, label: str | None) -> tuple[str, str | None]:
    name = name.rsplit("/", 1)[-1].lower()
    if name in ("requirements-dev.txt", "dev-requirements.txt", "requirements-packaging.txt", "requirements-github-actions.txt"):
        return "group", "dev"
    if name.startswith("requirements-docs") or "documentation" in name or "docs" in name:
        return "group", "docs"
    if name.startswith("requirements-test") or "testing" in name or "tests" in name:
        return "group", "tests"
    return ("group", "dev") if "optional" in name else (kind, label)


def requirements(root: Path, name: str, m: Manifest, kind: str, label: str | None, stack: tuple[str, ...] = ()) -> None:
    """A requirements file and those it includes. Raises ValueError if they include each other."""
    if name in stack:
        raise ValueError(f"requirement files include each other: {' -> '.join([*stack, name])}")
    path = root / name
    if not path.is_file() or not path.resolve().is_relative_to(root.resolve()):
        if stack:
            m.warnings.append(f"{stack[-1]}: {name} is not there")
        return
    m.files.append(name)
    for n, raw in enumerate(path.read_text("utf-8-sig", "replace").splitlines(), 1):
        line = strip_comment(raw).rstrip("\\").strip()
        if not line:
            continue
        flag = re.match(r"^(-r|--requirement|-c|--constraint|-e|--editable)(?:\s+|=)(.+)$", line) or re.match(r"^(-r|-c|-e)(.+)$", line)
        if flag and flag[1] in ("-r", "--requirement"):
            inner = str(Path(name).parent / flag[2].strip()).replace("\\", "/")
            requirements(root, inner, m, *include_kind(inner, kind, label), (*stack, name))
        elif flag and flag[1] in ("-c", "--constraint"):
            inner = Manifest()
            requirements(root, str(Path(name).parent / flag[2].strip()), inner, kind, label, (*stack, name))
            m.constraints += inner.dependencies
        elif flag:
            found = parse_spec(flag[2].strip()) if "#egg=" in flag[2] else Declared("", opaque=True)
            m.dependencies.append(replace(found or Declared("", opaque=True), kind=kind, label=label, file=name, line=n, where="editable", opaque=not (found and found.name)))
        elif line.startswith("-"):
            m.warnings.append(f"{name}:{n}: {line.split()[0]} is left aside")
        elif (found := parse_spec(re.split(r"\s--", line)[0])) is None:
            m.warnings.append(f"{name}:{n}: {line!r} is no requirement")
        else:
            m.dependencies.append(replace(found, kind=kind, label=label, file=name, line=n, where="requirements"))


def uv_lock(path: Path, m: Manifest) -> None:
    """Edges of a lock file; of packages with one name the last counts."""
    try:
        data = tomllib.loads(path.read_text("utf-8-sig"))
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path.name}: {e}") from None
    packages = {normalize(p["name"]): [normalize(d["name"]) for d in p.get("dependencies", []) if isinstance(d, dict) and "name" in d] for p in data.get("package", []) if "name" in p}
    m.lock += [(src, dst) for src, ds in packages.items() for dst in ds]


#: Requirement files read at the root, and their group (fixed values); the first depends on what is declared elsewhere.
FILES = (("requirements-dev.txt", "dev"), ("dev-requirements.txt", "dev"), ("requirements-docs.txt", "docs"), ("requirements-tests.txt", "tests"), ("requirements-test.txt", "tests"))


def extract(root: Path) -> Manifest:
    """Everything a project declares, duplicates kept."""
    m = Manifest()
    for name, read in (("pyproject.toml", pyproject), ("setup.cfg", setup_cfg), ("setup.py", setup_py)):
        if (root / name).is_file():
            read(root / name, m)
            m.files.append(name)
    has_manifest = bool(m.files) and any(d.kind in ("runtime", "setup_extra") for d in m.dependencies)
    requirements(root, "requirements.txt", m, *(("group", "dev") if has_manifest else ("runtime", None)))
    for name, group in FILES:
        requirements(root, name, m, "group", group)
    if (root / "uv.lock").is_file():
        uv_lock(root / "uv.lock", m)
        m.files.append("uv.lock")
    return m


def can_add(m: Manifest) -> bool:
    """Whether a dependency can be added to a manifest: one whose dependencies stand in the project table."""
    data = _table(m.pyproject)
    return m.pyproject is not None and "poetry" not in _table(data.get("tool")) and "dependencies" not in _table(data.get("project")).get("dynamic", [])


def target_minor(explicit: str | None, requires: str | None) -> int:
    """Minor version to analyse for: the explicit one, else the highest lower bound, else 11."""
    if explicit:
        m = re.fullmatch(r"py3([0-9]{2})", explicit)
        if not m:
            raise ValueError(f"target_version {explicit!r} is not like py311")
        return int(m[1])
    lows = [int(x) for x in re.findall(r"(?:>=|~=|==|>)\s*3\.([0-9]+)", requires or "")]
    return max(lows, default=11)
