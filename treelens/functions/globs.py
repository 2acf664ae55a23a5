"""Globs as regular expressions that Java and Python both read, and .gitignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterable


def glob_regex(glob: str, crosses: bool = True) -> str:
    """The expression for a whole path. ``*`` and ``?`` cross ``/`` unless told not to; ``**`` as a whole part always does.

    ``[a-z]``, ``[!a]`` and ``{a,b}`` are known; a backslash takes the next
    character as it is. Raises ValueError for what does not close.
    """
    out, i, depth, any_ = [], 0, 0, "." if crosses else "[^/]"
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(any_ + "*")
        elif c == "?":
            out.append(any_)
        elif c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] in ("!", "^") else i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            inner = glob[i + 1 : end]
            no = inner[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", inner[no:])
            out.append(f"[{'^' * no}{inner}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
        i += 1
    if depth:
        raise ValueError(f"unclosed braces in glob {glob!r}")
    return "".join(out)


#: Expressions made before, by globs: most projects have the same ones.
_MADE: dict[tuple, str] = {}


def any_glob(globs: Iterable[str], crosses: bool = True) -> str:
    """One anchored expression for paths that any of the globs matches."""
    key = (*globs, crosses)
    if key not in _MADE:
        if len(_MADE) >= 1000:
            _MADE.clear()
        _MADE[key] = "^(?:" + "|".join(glob_regex(g, crosses) for g in key[:-1]) + ")$"
    return _MADE[key]


def literal_folder(glob: str) -> str:
    """The folders that every path a glob matches begins with, as far as they are written out; empty if there are none."""
    parts = glob.split("/")[:-1]
    plain = next((i for i, p in enumerate(parts) if re.search(r"[*?\[{},\\]", p)), len(parts))
    return "/".join(parts[:plain])


def match(path: str, globs: Iterable[str]) -> bool:
    globs = list(globs)
    return bool(globs) and re.match(any_glob(globs), path, re.S) is not None


class Gitignore:
    """Rules of .gitignore files, each with the folder (relative, no trailing slash) it lies in."""

    def __init__(self) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []  # pattern, keeps, folders only

    def add(self, text: str, folder: str = "") -> None:
        base = re.escape(folder) + "/" if folder else ""
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keeps = line.startswith("!")
            line = line[1:] if keeps else line[1:] if line[:2] in ("\\!", "\\#") else line
            only = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            anchored = "/" in line
            try:
                rule = glob_regex(line.lstrip("/"), crosses=False)
            except ValueError:
                continue
            self.rules.append((re.compile(f"^{base}{'' if anchored else '(?:.*/)?'}{rule}$"), keeps, only))

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        """Whether a path or a folder above it is ignored; the last rule that matches decides, and nothing below an ignored folder comes back."""
        if not self.rules:
            return False
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            at, folder = "/".join(parts[:i]), is_dir or i < len(parts)
            state = False
            for rule, keeps, only in self.rules:
                if (folder or not only) and rule.match(at):
                    state = not keeps
            if state:
                return True
        return False
