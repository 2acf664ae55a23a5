"""Files of a source tree: layout, walk with ignore rules, contexts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.globs import Gitignore, any_glob
from treelens.sources.config import Config, entry_spec

#: Folders of a flat layout that are no packages (fixed values).
RESERVED = frozenset("tests docs scripts build dist examples".split())
KINDS = {".py": "python", ".pyi": "stub", ".ipynb": "notebook"}
FILES = "path string, kind string, context string, content binary"


@dataclass
class Layout:
    kind: str
    packages: list[str] = field(default_factory=list)
    ambiguous: bool = False
    warnings: list[str] = field(default_factory=list)

    def globs(self) -> list[str]:
        base = {"src": ["src/**"], "flat": [f"{p}/**" for p in self.packages]}.get(self.kind, ["**/*.py", "**/*.ipynb"])
        more = ["tests/**", "docs/**", "scripts/**", "*.py"]
        return base + more if self.kind != "unknown" else base


def infer_layout(root: Path, name: str | None) -> Layout:
    """src if a package lies in src/, flat if one lies at the root; of several flat ones that of the project's name, else the first."""
    packages = lambda at: sorted(p.parent.name for p in at.glob("*/__init__.py"))
    if (root / "src").is_dir() and (own := packages(root / "src")):
        return Layout("src", own)
    flat = [p for p in packages(root) if p not in RESERVED]
    if not flat:
        return Layout("unknown")
    if len(flat) == 1:
        return Layout("flat", flat)
    plain = re.sub(r"[-_.]+", "_", name or "").lower()
    match = [p for p in flat if p.lower() == plain]
    if match:
        return Layout("flat", match, True)
    return Layout("flat", flat[:1], True, [f"several packages, {flat[0]} is taken: {', '.join(flat)}"])


#: Names of test files, in small letters.
TEST = re.compile(r"^test_.*\.pyi?$|^.*_test\.pyi?$")


def context(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    if path.startswith("tests/") or base == "conftest.py" or TEST.match(base.lower()):
        return "test"
    return "docs" if path.startswith("docs/") else "dev" if path.startswith("scripts/") or path == "noxfile.py" else "runtime"


def walk(root: Path, config: Config, include: list[str] | None = None) -> list[str]:
    """Paths of sources, sorted: links are not followed, excluded folders not entered."""
    ignore, out = Gitignore(), []
    excluded = re.compile(any_glob(config.excluded()), re.S)
    wanted = re.compile(any_glob(include), re.S) if include else None
    for folder, dirs, names in root.walk():
        at = folder.relative_to(root).as_posix()
        at = "" if at == "." else at
        if config.respect_gitignore and ".gitignore" in names:
            ignore.add((folder / ".gitignore").read_text("utf-8", "replace"), at)
        join = lambda n: f"{at}/{n}" if at else n
        dirs[:] = sorted(d for d in dirs if d != ".git" and not (folder / d).is_symlink() and not excluded.match(join(d)) and not excluded.match(join(d) + "/x") and not ignore.ignored(join(d), True))
        for n in names:
            path = join(n)
            if os.path.splitext(n)[1].lower() in KINDS and not (folder / n).is_symlink() and not excluded.match(path) and not ignore.ignored(path):
                if (wanted is None or wanted.match(path)) and not (config.production and context(path) != "runtime"):
                    out.append(path)
    return sorted(out)


def check_entries(root: Path, config: Config) -> list[str]:
    """Warnings for configured entries that are no files."""
    return [f"entry {e} is not a file" for e in config.entry if not (root / entry_spec(e)[0]).is_file()]


def load(spark: SparkSession, root: Path, config: Config, include: list[str] | None = None) -> DataFrame:
    """The files of one project, with their content."""
    rows = [(p, KINDS[os.path.splitext(p)[1].lower()], context(p), (root / p).read_bytes()) for p in walk(root, config, include)]
    return spark.createDataFrame(rows, FILES)


#: Columns of the files of many trees.
TREES = "project string, path string, length long, modified long, content binary"
#: Bytes of files in one batch of rows.
BATCH = 16 << 20


def _batches(rows: Iterator[tuple]) -> Iterator:
    """Rows of TREES as Arrow batches of bounded size (a larger file stands alone)."""
    import pyarrow as pa

    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("content", pa.binary())])
    held, size = [], 0
    for row in rows:
        if held and size + len(row[4]) > BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held, size = [], 0
        held.append(row)
        size += len(row[4]) + 200
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All files of many trees below ``path``: project (its first folder), path, length, modified (microseconds), content.

    The driver lists the first folders only; tasks list and read what is in
    each. Spark's own file sources leave out names that begin with ``_`` or
    ``.``, ``__init__.py`` among them, so tasks read through Arrow's file
    systems (local, HDFS, S3, GCS). From other stores, trees come as archives
    (``unpacked``) or as a table of these columns.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = re.sub(r"^(\w+):/*(?=/)", r"\1://", store.makeQualified(at).toString())
    names = sorted(s.getPath().getName() for s in store.listStatus(at) if s.isDirectory())

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(uri)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for project in b.column(0).to_pylist():
                    top = f"{base.rstrip('/')}/{project}"
                    for info in where.get_file_info(fs.FileSelector(top, recursive=True)):
                        if info.type == fs.FileType.File:
                            with where.open_input_stream(info.path) as f:
                                yield project, info.path[len(top) + 1 :], info.size, (info.mtime_ns or 0) // 1000, f.read()

        yield from _batches(rows())

    projects = spark.createDataFrame([(n,) for n in names], "project string").repartition(max(1, min(len(names), 10_000)))
    return projects.mapInArrow(run, TREES)


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """The files of many trees in archives below ``path`` (.zip, .whl, .tar, .tar.gz, .tgz), in any store that Spark reads; columns as of ``scan``.

    A project is an archive, by its name without the ending; a first folder
    that all files of it are in is left out. An archive that is broken gives
    the files before the fault. Archives are read one at a time in a task.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,whl,tar,gz,tgz}").load(path)

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    files = list(members(content))
                    first = {p.split("/", 1)[0] for p, *_ in files}
                    drop = len(first.pop()) + 1 if len(first) == 1 and all("/" in p for p, *_ in files) else 0
                    project = re.sub(r"\.(zip|whl|tar|tgz|tar\.gz)$", "", name.rsplit("/", 1)[-1])
                    yield from ((project, p[drop:], len(c), t, c) for p, t, c in files)

        yield from _batches(rows())

    return read.select("path", "content").mapInArrow(run, TREES)


def members(content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(path, modified, content) of the regular files of an archive, as far as it can be read."""
    import calendar
    import io
    import tarfile
    import zipfile
    import zlib

    try:
        if content[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename.removeprefix("./"), calendar.timegm(i.date_time) * 1_000_000, z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as t:
                for m in t:
                    if m.isreg():
                        yield m.name.removeprefix("./"), int(m.mtime * 1_000_000), t.extractfile(m).read()
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, ValueError):
        return
