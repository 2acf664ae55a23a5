"""Configuration: defaults, two stand-alone files and a table of pyproject.toml, the later over the earlier."""

from __future__ import annotations

import fnmatch
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from treelens.functions.scalars import CONFIDENCE

#: Markers of a project root in the order of their priority (fixed values).
MARKERS = ("pyproject.toml", "uv.lock", "setup.cfg", "setup.py", "requirements.txt", ".git")
RULES = tuple(f"TL{n:03}" for n in range(1, 11))
PLUGINS = tuple("pytest django fastapi flask celery tox nox pre_commit github_actions sphinx mkdocs alembic".split())
ALWAYS_EXCLUDED = (".venv/**", "build/**", "dist/**", "**/__pycache__/**")
MODES = ("auto", "app", "library")
LEVELS = ("off", "info", "warning", "error")
#: Folders not searched for workspace members (fixed values).
SKIPPED = frozenset(".git .venv venv __pycache__ target node_modules".split())


@dataclass(frozen=True)
class Config:
    entry: tuple[str, ...] = ()
    project: tuple[str, ...] = ()
    mode: str = "auto"
    production: bool = False
    target_version: str | None = None
    respect_gitignore: bool = True
    confidence: str = "likely"
    exclude: tuple[str, ...] = ALWAYS_EXCLUDED
    dependencies: dict = field(default_factory=lambda: {"dev_groups": ["dev", "test", "tests", "lint", "docs"], "runtime_groups": ["server", "worker"], "type_groups": ["types", "typing", "mypy"]})
    package_module_map: dict = field(default_factory=dict)
    binary_map: dict = field(default_factory=dict)
    plugins: dict = field(default_factory=lambda: {p: p in ("pytest", "django", "fastapi") for p in PLUGINS})
    ignore: dict = field(default_factory=dict)
    severity: dict = field(default_factory=dict)
    workspaces: dict = field(default_factory=dict)

    def excluded(self) -> list[str]:
        return [*self.exclude, *(g for g in ALWAYS_EXCLUDED if g not in self.exclude)]


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def find_root(start: Path) -> tuple[Path, str]:
    """The nearest folder upwards that holds a marker, and the marker."""
    start = start.resolve()
    for folder in (start, *start.parents) if start.is_dir() else start.parents:
        for marker in MARKERS:
            at = folder / marker
            if at.is_file() or (marker == ".git" and at.is_dir()):
                return folder, marker
    raise ConfigError(f"no project root at or above {start}")


def _texts(key: str, value, what=lambda x: True) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
        raise ConfigError(f"{key} must be a list of texts")
    return tuple(value)


def relative_path(key: str, path: str) -> str:
    path = path.replace("\\", "/")
    if path.startswith("/") or re.match(r"^[A-Za-z]:", path) or ".." in path.split("/"):
        raise ConfigError(f"{key}: {path!r} must be relative and stay in the project")
    return re.sub(r"^(\./)+", "", path)


def entry_spec(spec: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"([^:]+)(?::([^:]+))?", spec)
    if not m:
        raise ConfigError(f"entry {spec!r} is not path or path:symbol")
    return relative_path("entry", m[1]), m[2]


def check(table: dict) -> dict:
    """A layer as fields of Config; raises ConfigError for what is unknown or of the wrong kind."""
    out: dict = {}
    for key, value in table.items():
        if key not in Config.__dataclass_fields__:
            raise ConfigError(f"unknown key {key!r}")
        if key in ("entry", "project", "exclude"):
            out[key] = _texts(key, value)
            for x in out[key]:
                entry_spec(x) if key == "entry" else relative_path(key, x)
        elif key in ("production", "respect_gitignore"):
            if not isinstance(value, bool):
                raise ConfigError(f"{key} must be true or false")
            out[key] = value
        elif key in ("mode", "confidence", "target_version"):
            legal = {"mode": MODES, "confidence": tuple(CONFIDENCE)}.get(key)
            if not isinstance(value, str) or (legal and value not in legal) or (key == "target_version" and not re.fullmatch(r"py3[0-9]{2}", value)):
                raise ConfigError(f"{key}: {value!r} is not legal")
            out[key] = value
        elif not isinstance(value, dict):
            raise ConfigError(f"{key} must be a table")
        elif key == "dependencies":
            if extra := set(value) - {"dev_groups", "runtime_groups", "type_groups"}:
                raise ConfigError(f"dependencies: unknown key {min(extra)!r}")
            out[key] = {k: list(_texts(k, v)) for k, v in value.items()}
        elif key in ("ignore", "severity"):
            for code, v in value.items():
                if code not in RULES:
                    raise ConfigError(f"{key}: unknown rule {code!r}")
                if key == "severity" and v not in LEVELS:
                    raise ConfigError(f"severity: {v!r} is not legal")
            out[key] = {c: list(_texts(c, v)) if key == "ignore" else v for c, v in value.items()}
        elif key == "plugins":
            for p, v in value.items():
                if p.replace("-", "_") not in PLUGINS or not isinstance(v, bool):
                    raise ConfigError(f"plugins: {p!r} is unknown or not true or false")
            out[key] = {p.replace("-", "_"): v for p, v in value.items()}
        elif key == "workspaces":
            for name, t in value.items():
                if not isinstance(t, dict) or set(t) - {"path", "entry", "project", "mode"} or not isinstance(t.get("path"), str):
                    raise ConfigError(f"workspaces.{name} needs a path, and may have entry, project and mode")
                relative_path("path", t["path"])
            out[key] = value
        else:
            out[key] = {k: list(_texts(k, v)) if key == "package_module_map" else v for k, v in value.items()}
            if key == "binary_map" and not all(isinstance(v, str) for v in value.values()):
                raise ConfigError("binary_map must map commands to distributions")
    return out


def merge(config: Config, layer: dict) -> Config:
    """What a layer sets replaces what was; plugins and dependencies are merged by key."""
    layer = dict(layer)
    for key in ("plugins", "dependencies"):
        if key in layer:
            layer[key] = getattr(config, key) | layer[key]
    return replace(config, **layer)


def load(root: Path, pyproject: dict | None = None) -> tuple[Config, list[str]]:
    """The effective configuration and the files that are part of it."""
    config, used = Config(), []
    for name in (".treelens.toml", "treelens.toml"):
        if (root / name).is_file():
            config = merge(config, check(_toml(root / name)))
            used.append(name)
    pyproject = _toml(root / "pyproject.toml") if pyproject is None and (root / "pyproject.toml").is_file() else pyproject
    own = ((pyproject or {}).get("tool") or {}).get("treelens")
    if own is not None:
        config = merge(config, check(own))
        used.append("pyproject.toml")
    return config, used


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text("utf-8-sig"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path.name}: {e}") from None


def overridden(config: Config, production: bool | None = None, confidence: str | None = None) -> Config:
    """What the command line sets over everything else."""
    config = replace(config, production=production) if production else config
    return replace(config, confidence=confidence) if confidence else config


@dataclass(frozen=True)
class Member:
    id: str
    path: str
    source: str


def members(root: Path, config: Config, pyproject: dict | None) -> list[Member]:
    """Workspace members: those of the lock tool's globs, and over them (by path) the configured ones."""
    globs = ((((pyproject or {}).get("tool") or {}).get("uv") or {}).get("workspace") or {}).get("members", [])
    found: dict[str, Member] = {}
    if globs:
        for p in sorted(root.rglob("pyproject.toml")):
            at = p.parent.relative_to(root).as_posix()
            if at != "." and not SKIPPED & set(at.split("/")) and any(fnmatch.fnmatchcase(at, g.rstrip("/")) for g in globs):
                found[at] = Member(at.rsplit("/", 1)[-1], at, "uv")
    for name, table in config.workspaces.items():
        at = relative_path("path", table["path"]).rstrip("/")
        found[at] = Member(name, at, "treelens")
    return [found[k] for k in sorted(found)]
