"""Declared against used distributions: unused, missing, transitive, misplaced, unlisted and duplicate ones.

declared: distribution, kind (runtime, group, optional, setup_extra), label,
marker, opaque. used: distribution, context (runtime, test, type, docs, dev),
optional, platform_guarded, file, line. All are joins on the distribution, and
on the columns ``by`` (a project, say), so that many projects go through at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.operators.closure import nodes, of_node, reach, within

#: Kinds for development only.
DEV = ("group",)


def flag(x: bool | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def names(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*by, "distribution").where("distribution is not null and distribution <> ''").distinct()


def stub_uses(declared: DataFrame, used: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Stub packages count as used if what they describe is."""
    bare = F.regexp_replace(F.regexp_replace("distribution", "^types-", ""), "-stubs$", "")
    stubs = names(declared, by).where("distribution like 'types-%' or distribution like '%-stubs'").select(*by, "distribution", bare.alias("described"))
    return stubs.join(names(used, by).withColumnRenamed("distribution", "described"), [*by, "described"], "left_semi").select(*by, "distribution")


def unused(declared: DataFrame, used: DataFrame, strict: bool = False, production: bool | Column = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL002: declared but never used. Those with a marker or for development count only when strict, likely or certain."""
    seen = names(used, by).union(stub_uses(declared, used, by))
    rows = declared.where(~F.col("opaque") & (F.col("distribution") != "")).join(seen, [*by, "distribution"], "left_anti")
    marked, dev = F.col("marker").isNotNull(), F.col("kind").isin(*DEV)
    rows = rows.where(~(flag(production) & dev))
    if not strict:
        rows = rows.where(~marked & ~dev)
    doubtful = marked | F.coalesce(F.col("from_setup_py"), F.lit(False)) if "from_setup_py" in declared.columns else marked
    return rows.withColumns({"severity": F.lit("error"), "confidence": F.when(doubtful, "likely").otherwise("certain")})


def lock_closure(declared: DataFrame, lock: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """distribution and depth of all that declared ones need by the lock file (src, dst)."""
    if by == ("project",):
        return within(lock.select("project", "src", "dst", F.lit(0).alias("line")), names(declared, by).select("project", F.col("distribution").alias("node"))).select("project", F.col("node").alias("distribution"), "depth")
    node = lambda c: nodes([*by, c]) if by else F.col(c)
    found = reach(lock.select(node("src").alias("src"), node("dst").alias("dst")), names(declared, by).select(node("distribution").alias("node")))
    return found.select(*(of_node("node", [*by, "distribution"]) if by else [F.col("node").alias("distribution")]), "depth")


def undeclared(used: DataFrame, declared: DataFrame, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Uses of what is not declared, with the severity they have; only runtime uses unless strict."""
    rows = used.join(names(declared, by), [*by, "distribution"], "left_anti")
    rows = rows if strict else rows.where("context = 'runtime'")
    soft = F.col("optional") | F.col("platform_guarded")
    low = F.when(F.col("optional") & F.lit(strict), "warning").otherwise("info")
    return rows.withColumns({"severity": F.when(soft, low).otherwise("error"), "confidence": F.when(soft, "likely").otherwise("certain")})


def missing(used: DataFrame, declared: DataFrame, closure: DataFrame, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL003: undeclared, and no declared one brings it along."""
    return undeclared(used, declared, strict, by).join(names(closure, by), [*by, "distribution"], "left_anti")


def transitive(used: DataFrame, declared: DataFrame, closure: DataFrame, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """TL004: undeclared, but there because a declared one needs it."""
    return undeclared(used, declared, strict, by).join(names(closure, by), [*by, "distribution"], "left_semi")


def misplaced(used: DataFrame, declared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TL005: imported at run time, declared for development only."""
    only_dev = declared.groupBy(*by, "distribution").agg(F.bool_and(F.col("kind").isin(*DEV)).alias("only_dev")).where("only_dev").select(*by, "distribution")
    return names(used.where("context = 'runtime'"), by).join(only_dev, [*by, "distribution"], "left_semi").withColumns({"severity": F.lit("warning"), "confidence": F.lit("certain")})


def unlisted(binaries: DataFrame, providers: DataFrame, declared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TL008: commands in use (binary, file, line) of distributions that are not declared; a command no one is known for stands for itself."""
    known = providers.select(*by, "binary", F.col("distribution").alias("d"))
    rows = binaries.join(known, [*by, "binary"], "left").withColumn("distribution", F.coalesce("d", "binary")).drop("d")
    rows = rows.join(names(declared, by), [*by, "distribution"], "left_anti").groupBy(*by, "binary", "distribution").agg(F.min(F.struct("file", "line")).alias("at"))
    return rows.select(*by, "binary", "distribution", "at.file", "at.line", F.lit("warning").alias("severity"), F.lit("certain").alias("confidence"))


def duplicates(declared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """TL009: declared in more than one context."""
    context = F.when(F.col("kind") == "runtime", "runtime").otherwise(F.concat_ws(":", "kind", "label"))
    rows = declared.where("not opaque and distribution <> ''").groupBy(*by, "distribution").agg(F.sort_array(F.collect_set(context)).alias("contexts"))
    return rows.where(F.size("contexts") > 1).withColumns({"severity": F.lit("warning"), "confidence": F.lit("certain")})
