"""Public names that nobody uses: exports, re-exports, and imports that lead nowhere.

symbols: path, module, name, seq, is_public, in_type_checking, decorated,
exported. imports: path, importer (module), module, name, alias, line,
reachable. attributes: path, receiver, name. Joins are on the columns ``by``
too (a project, say), so that many projects go through at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.operators.dependencies import flag
from treelens.operators.resolve import first_of


def references(imports: DataFrame, attributes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """module and name in use, and by which module: from-imports, and attributes of imported modules."""
    live = imports.where("reachable and importer is not null")
    named = live.where("name is not null").select(*by, "module", "name", "importer")
    # a module is written by its alias, or by its whole name
    whole = live.where("name is null").select(*by, "path", "module", "importer", F.explode(F.array_distinct(F.array("module", F.coalesce("alias", "module")))).alias("receiver"))
    by_attribute = attributes.select(*by, "path", "receiver", "name").join(whole, [*by, "path", "receiver"]).select(*by, "module", "name", "importer")
    return named.union(by_attribute).distinct()


def unused_exports(symbols: DataFrame, refs: DataFrame, external: DataFrame, library: bool | Column = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL006: public names of reachable modules that no other module uses and no one outside needs.

    external: module, name of entry points and plugin references.
    """
    rows = symbols.where("is_public and not in_type_checking and reachable and not decorated")
    rows = first_of(rows, [*by, "module", "name"], [F.col("seq")])
    outside = refs.where("importer <> module").select(*by, "module", "name").distinct()
    rows = rows.join(outside, [*by, "module", "name"], "left_anti").join(external.select(*by, "module", "name"), [*by, "module", "name"], "left_anti")
    return rows.withColumns({"severity": F.when(flag(library), "info").otherwise("warning"), "confidence": F.when(F.col("exported"), "certain").otherwise("likely")})


def unused_reexports(reexports: DataFrame, refs: DataFrame, library: bool | Column = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL007: names (package, name, exported) that a package's __init__ takes from below and no one takes from it, itself included."""
    rows = reexports.where("exported or name not like '\\_%'")
    rows = rows.join(refs.select(*by, F.col("module").alias("package"), "name").distinct(), [*by, "package", "name"], "left_anti")
    return rows.withColumns({"severity": F.when(flag(library), "info").otherwise("warning"), "confidence": F.lit("likely")})


def unresolved(sites: DataFrame, reached: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TL010: imports of unknown origin in reachable files, once for each file, line and root."""
    rows = sites.where("origin = 'unknown'").select(*by, "path", "line", "import_root").distinct()
    return rows.join(reached.select(*by, F.col("node").alias("path")), [*by, "path"], "left_semi").withColumns({"severity": F.lit("warning"), "confidence": F.lit("likely")})


def unused_files(files: DataFrame, reached: DataFrame, framework: DataFrame, library: bool | Column = False, production: bool | Column = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL001: Python files and notebooks that no entry reaches and no framework loads.

    files: path, kind, context, opaque. Package markers never count, nor do
    tests in a library, nor anything but run-time files in production.
    """
    rows = files.where("kind in ('python', 'notebook')").where(~F.col("path").rlike(r"(^|/)__init__\.py$"))
    library, production = flag(library), flag(production)
    rows = rows.where(~(library & (F.col("context") == "test")) & ~(production & (F.col("context") != "runtime")))
    rows = rows.join(reached.select(*by, F.col("node").alias("path")).union(framework.select(*by, "path")).distinct(), [*by, "path"], "left_anti")
    doubt = F.when(library, "maybe").when(F.col("opaque"), "likely").otherwise("certain")
    return rows.withColumns({"severity": F.when(library, "warning").otherwise("error"), "confidence": doubt})
