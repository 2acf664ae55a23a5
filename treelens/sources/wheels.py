"""Names that wheels provide, read from the wheels themselves."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from treelens.sources.requirements import normalize


def names(content: bytes) -> tuple[str, str, list[str]]:
    """Distribution, version and top-level import names of a wheel; empty ones if it is none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        files = z.namelist()
        meta = next(n for n in files if n.endswith(".dist-info/METADATA"))
        head = z.read(meta).decode("utf-8", "replace").split("\n\n")[0]
    except (zipfile.BadZipFile, StopIteration, KeyError):
        return "", "", []
    said = {k: v.strip() for k, v in re.findall(r"^(Name|Version):\s*(.+)$", head, re.M)}
    top = meta.replace("METADATA", "top_level.txt")
    if top in files:
        roots = {x.strip() for x in z.read(top).decode("utf-8", "replace").splitlines()}
    else:
        roots = {n.split("/")[0] if "/" in n else n[:-3] for n in files if ".dist-info/" not in n and ".data/" not in n and ("/" in n or n.endswith(".py"))}
    return normalize(said.get("Name", "")), said.get("Version", ""), sorted(r for r in roots if r and not r.startswith("_"))


def harvest(spark: SparkSession, path: str) -> DataFrame:
    """distribution, version, import_root and sha256 of all wheels below ``path``; what is no wheel gives no rows."""
    import hashlib

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for x in batches:
            for content in x.content:
                dist, version, roots = names(bytes(content))
                digest = hashlib.sha256(bytes(content)).hexdigest()
                yield pd.DataFrame([(dist, version, r, digest) for r in roots], columns=["distribution", "version", "import_root", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.whl").load(path)
    return files.select("content").mapInPandas(run, "distribution string, version string, import_root string, sha256 string")
