"""A folder of a tree that is held as rows: what the readers of manifests and configurations ask of a path."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from pathlib import PurePosixPath


class Folder:
    """Part of a path's interface over path -> content (None where only the name is known)."""

    def __init__(self, files: dict[str, bytes | None], at: str = ".", dirs: dict | None = None):
        self._files, self._at = files, posixpath.normpath(at)
        if dirs is None:
            dirs = {}
            for f in files:
                parts = f.split("/")
                for i in range(len(parts)):
                    below = dirs.setdefault("/".join(parts[:i]) or ".", (set(), set()))
                    below[i == len(parts) - 1].add(parts[i])
        self._dirs = dirs

    def _to(self, at: str) -> Folder:
        return Folder(self._files, at, self._dirs)

    def __truediv__(self, name) -> Folder:
        name = str(name)
        if not name or name[0] in "./" or name[-1] == "/" or "/." in name or "//" in name or (self._at[0] in "./" and self._at != "."):
            return self._to(posixpath.join(self._at, name))
        # plain parts below a plain folder need no normalising, and there are many
        out = object.__new__(Folder)
        out._files, out._at, out._dirs = self._files, name if self._at == "." else f"{self._at}/{name}", self._dirs
        return out

    def __lt__(self, other: Folder) -> bool:
        return self._at.split("/") < other._at.split("/")

    def __eq__(self, other) -> bool:
        return isinstance(other, Folder) and self._at == other._at

    def __hash__(self) -> int:
        return hash(self._at)

    def __str__(self) -> str:
        return self._at

    @property
    def name(self) -> str:
        return posixpath.basename(self._at)

    @property
    def parent(self) -> Folder:
        return self._to(posixpath.dirname(self._at) or ".")

    def is_file(self) -> bool:
        return self._at in self._files

    def is_dir(self) -> bool:
        return self._at in self._dirs

    def is_symlink(self) -> bool:
        return False

    def resolve(self) -> Folder:
        return self

    def is_relative_to(self, other: Folder) -> bool:
        return not self._at.startswith("../") and (other._at == "." or self._at == other._at or self._at.startswith(other._at + "/"))

    def relative_to(self, other: Folder) -> PurePosixPath:
        return PurePosixPath(posixpath.relpath(self._at, other._at))

    def read_bytes(self) -> bytes:
        return self._files[self._at] or b""

    def read_text(self, encoding: str = "utf-8", errors: str = "strict") -> str:
        return self.read_bytes().decode(encoding, errors)

    def walk(self) -> Iterator[tuple[Folder, list[str], list[str]]]:
        """As of a path: folders from the top; those taken out of the list are not entered."""
        below = self._dirs.get(self._at)
        if below is not None:
            dirs, names = sorted(below[0]), sorted(below[1])
            yield self, dirs, names
            for d in dirs:
                yield from (self / d).walk()

    def rglob(self, name: str) -> Iterator[Folder]:
        for folder, _, names in self.walk():
            yield from (folder / n for n in names if fnmatch.fnmatchcase(n, name))

    def glob(self, pattern: str) -> Iterator[Folder]:
        found = [self]
        for part in pattern.split("/"):
            found = [f / n for f in found for n in sorted(set().union(*f._dirs.get(f._at, ((), ())))) if fnmatch.fnmatchcase(n, part)]
        yield from found
