"""Known findings, kept in a file inside the project."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from treelens.sinks.reports import VERSION

SCHEMA = "fingerprint string, code string, target string"


def read(spark: SparkSession, path: Path) -> DataFrame:
    """The findings of a baseline; none if there is no file. Raises ValueError if it cannot be read."""
    if not path.is_file():
        return spark.createDataFrame([], SCHEMA)
    try:
        issues = json.loads(path.read_text("utf-8")).get("issues", [])
        rows = [(i["fingerprint"], i.get("code") or i["fingerprint"].split(":")[0], i.get("target") or i["fingerprint"].partition(":")[2]) for i in issues]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"{path.name} is no baseline: {e}") from None
    return spark.createDataFrame(rows, SCHEMA)


def inside(root: Path, path: Path) -> Path:
    """The path, if it lies in the root, links followed. Raises ValueError otherwise."""
    at = (root / path).resolve() if not path.is_absolute() else path.resolve()
    if not at.is_relative_to(root.resolve()):
        raise ValueError(f"{path} is outside the project")
    return at


def replace_file(path: Path, text: str) -> None:
    """Written beside and renamed, so that it is there whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write(issues: DataFrame, root: Path, path: Path) -> int:
    """The reported findings as a baseline; how many there are."""
    rows = issues.where("disposition is null or disposition = 'baseline'").select("fingerprint", "code", "target").distinct().orderBy("fingerprint").collect()
    data = {"schema_version": "1", "version": VERSION, "generated_at": f"unix:{int(time.time())}", "issues": [r.asDict() for r in rows]}
    replace_file(inside(root, path), json.dumps(data, indent=2, ensure_ascii=False) + "\n")
    return len(rows)
