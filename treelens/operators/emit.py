"""From candidates to reported findings, and what follows from them.

candidates: code, kind (of the subject), path, module, name, line, severity,
confidence, message, member, seq. Each step is a filter or a join on small
tables; dropped rows keep their reason in ``disposition``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.functions import scalars as s
from treelens.functions.globs import any_glob
from treelens.session import saved

CANDIDATE = "code string, kind string, path string, module string, name string, line int, severity string, confidence string, message string, member string, seq int"


def with_identity(rows: DataFrame) -> DataFrame:
    """target, fingerprint and sort_key of each candidate."""
    cols = [F.col(c) for c in ("kind", "path", "module", "name")]
    target = s.stable_target(*cols, F.col("member"))
    return rows.withColumns({"target": target, "fingerprint": s.fingerprint(F.col("code"), target), "sort_key": s.sort_key(*cols, F.col("line"))})


def override_severity(rows: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Severities set by rule; ``off`` takes a rule's findings away, and they do not count as suppressed."""
    if not levels:
        return rows
    pairs = F.create_map(*[F.lit(x) for pair in sorted(levels.items()) for x in pair])
    new = F.try_element_at(pairs, F.col("code"))
    return rows.withColumn("severity", F.coalesce(new, "severity")).where("severity <> 'off'")


def config_ignored(patterns: dict[str, list[str]]) -> Column:
    """Whether the configuration ignores a candidate.

    A pattern with a colon is for names: file or module, and name. Others
    match the path of files, the name of distributions and commands, and
    the file or module of imports, each only for the rules of that kind.
    """
    out = F.lit(False)
    for code, globs in sorted(patterns.items()):
        hit = F.lit(False)
        plain = [g for g in globs if ":" not in g]
        for g in globs:
            if ":" in g and code in ("TL006", "TL007"):
                where, _, name = g.rpartition(":")
                at = F.coalesce(F.col("path").rlike(any_glob([where])), F.lit(False)) | F.coalesce(F.replace("module", F.lit("."), F.lit("/")).rlike(any_glob([where])), F.lit(False))
                hit = hit | ((F.col("kind") == "symbol") & at & F.col("name").rlike(any_glob([name])))
        if plain:
            x = any_glob(plain)
            if code in ("TL001", "TL010"):
                hit = hit | ((F.col("kind") == "file") & F.col("path").rlike(x))
            if code in ("TL002", "TL003", "TL004", "TL005", "TL008", "TL009"):
                hit = hit | ((F.col("kind") == "distribution") & F.col("name").rlike(x))
            if code == "TL008":
                hit = hit | ((F.col("kind") == "binary") & F.col("name").rlike(x))
            hit = hit | ((F.col("kind") == "import") & (F.col("path").rlike(x) | F.col("module").rlike(x)))
        out = out | ((F.col("code") == code) & F.coalesce(hit, F.lit(False)))
    return out


def directed(rows: DataFrame, directives: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by_directive``: file or inline where a directive covers a candidate (told apart by ``seq``), else null.

    directives: path, line, file_level, codes, seq. The first one of a
    file, in source order, that names the code and covers the line counts.
    """
    each = directives.select(*by, "path", F.explode("codes").alias("code"), F.col("line").alias("_line"), "file_level", F.col("seq").alias("_seq"))
    told = F.min_by(F.when(F.col("file_level"), "file").otherwise("inline"), "_seq").alias("by_directive")
    each = saved(each)  # few of many files have any: the optimizer knows its size then
    keyed = rows.where("path is not null").join(each, [*by, "path", "code"]).where("file_level or line = _line")
    keys = [*by, "code", "path"]
    found = saved(keyed.groupBy(*keys, F.col("line").alias("_l"), "seq").agg(told)).withColumnsRenamed({"seq": "_s", **{k: f"_{k}" for k in keys}})
    same = rows["line"].eqNullSafe(found["_l"]) & rows["seq"].eqNullSafe(found["_s"])
    for k in keys:
        same = same & (rows[k] == found[f"_{k}"])
    return rows.join(found, same, "left").drop("_l", "_s", *[f"_{k}" for k in keys])


def ignored_by_pattern(rows: DataFrame, patterns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by_pattern``: whether one of ``patterns`` (code, folder, regex, name_regex) covers a candidate, as ``config_ignored`` says.

    The folders that a pattern spells out are part of the join, against every
    folder above a subject, so patterns that cannot match are never tried.
    """
    kind, module = F.col("kind"), F.replace(F.col("module"), F.lit("."), F.lit("/"))
    tested = (
        F.when(kind == "file", F.array("path")).when(kind.isin("distribution", "binary"), F.array("name"))
        .when(kind == "symbol", F.array("path", module)).when(kind == "import", F.array("path", "module"))
    )
    keys = [*by, "code", "kind", "path", "module", "name"]
    named = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    # most projects, and most rules, have no pattern
    asked = rows.select(*keys).join(saved(patterns.select(*by, "code").distinct()), [*by, "code"], "left_semi")
    subjects = asked.distinct().withColumn("subject", F.explode(tested)).where("subject is not null")
    parts = F.split("subject", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = subjects.withColumn("folder", F.explode(above)).join(patterns, [*by, "code", "folder"])
    hits = hits.where(F.expr("rlike(subject, regex)") & ((kind == "symbol") == F.col("name_regex").isNotNull()) & F.coalesce(F.expr("rlike(name, name_regex)"), F.lit(True)))
    found = saved(hits.select(*[named(c).alias(f"_{c}") for c in keys]).distinct())
    same = F.lit(True)
    for c in keys:
        same = same & (named(c) == found[f"_{c}"])
    return rows.join(found.withColumn("by_pattern", F.lit(True)), same, "left").drop(*[f"_{c}" for c in keys]).withColumn("by_pattern", F.coalesce("by_pattern", F.lit(False)))


def suppress(rows: DataFrame, patterns: dict[str, list[str]], directives: DataFrame) -> DataFrame:
    """``disposition``: config, file or inline if a candidate is ignored, else null."""
    rows = directed(rows, directives)
    return rows.withColumn("disposition", F.when(config_ignored(patterns), "config").otherwise(F.col("by_directive"))).drop("by_directive")


def confident(rows: DataFrame, floor: str = "maybe", strict: bool = False) -> DataFrame:
    """Candidates at or above the floor; strict takes all."""
    least = s.CONFIDENCE["maybe" if strict else floor]
    return rows.where(s.rank(F.col("confidence"), s.CONFIDENCE) >= least)


def chosen(rows: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    if include:
        rows = rows.where(F.col("code").isin(*include))
    return rows.where(~F.col("code").isin(*exclude)) if exclude else rows


def emit(rows: DataFrame, directives: DataFrame, levels: dict[str, str] | None = None, patterns: dict[str, list[str]] | None = None, floor: str = "maybe", strict: bool = False, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """All candidates that are reported or suppressed; reported ones have no disposition."""
    rows = suppress(override_severity(with_identity(rows), levels or {}), patterns or {}, directives)
    return chosen(confident(rows, floor, strict), include, exclude)


def summary(rows: DataFrame) -> DataFrame:
    """Findings by rule, and in all (null rule)."""
    return rows.where("disposition is null").rollup("code").agg(F.count("*").alias("n"))


def fails(rows: DataFrame, strict: bool = False) -> DataFrame:
    """One row: whether any finding is severe and sure enough for an exit status of 1."""
    severity, confidence = ("warning", "maybe") if strict else ("error", "likely")
    bad = (s.rank(F.col("severity"), s.SEVERITY) >= s.SEVERITY[severity]) & (s.rank(F.col("confidence"), s.CONFIDENCE) >= s.CONFIDENCE[confidence])
    return rows.where("disposition is null").agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"))


def against_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline holds (by fingerprint) get the disposition ``baseline``."""
    known = baseline.select("fingerprint", F.lit(True).alias("_known")).distinct()
    held = rows.join(known, "fingerprint", "left")
    return held.withColumn("disposition", F.when(F.col("disposition").isNull() & F.col("_known"), "baseline").otherwise(F.col("disposition"))).drop("_known")


def merge_entries(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One root for each path from (path, symbol, context, origin, seq).

    Origins in order, each once; run time if any is, else the first context;
    the last symbol there is.
    """
    some = F.array_sort(F.collect_list(F.struct("seq", "context", "origin")))
    m = rows.groupBy(*by, "path").agg(some.alias("all"), F.max_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("seq"))).alias("symbol"))
    context = F.when(F.exists("all", lambda e: e["context"] == "runtime"), "runtime").otherwise(F.col("all")[0]["context"])
    return m.select(*by, "path", "symbol", context.alias("context"), F.array_distinct(F.transform("all", lambda e: e["origin"])).alias("origins"))


def fix_plan(findings: DataFrame, declarations: DataFrame, remove_files: bool = False, by: tuple[str, ...] = (), targets: DataFrame | None = None) -> DataFrame:
    """What could be changed for each finding that a fix exists for: action, the declaration it is about, and a reason if nothing.

    declarations: distribution, kind, file, label, seq. With ``targets``
    (member, file, supported: manifests that a distribution may be added to)
    missing ones are added too, each once for a manifest; findings then have
    member and summary, whose first word is the distribution.
    """
    d = declarations.withColumn("priority", s.rank(F.col("kind"), s.REMOVAL))
    said = d.groupBy(*by, F.col("distribution").alias("name")).agg(
        F.count("*").alias("declared"),
        F.max_by(F.struct("file", "label"), F.struct("priority", "seq")).alias("drop"),
        F.sum(F.when(F.col("kind").isin("runtime", "optional"), 1).otherwise(0)).alias("lasting"),
        F.sum(F.when(F.col("kind") == "group", 1).otherwise(0)).alias("groups"),
    )
    f = findings.where(F.col("code").isin("TL001", "TL002", "TL005", "TL009")).join(said, [*by, "name"], "left")
    code, sure, n = F.col("code"), F.col("confidence") == "certain", F.coalesce("declared", F.lit(0))
    movable = (F.coalesce("lasting", F.lit(0)) == 0) & (F.coalesce("groups", F.lit(0)) == 1)
    reason = (
        F.when((code == "TL001") & ~F.lit(remove_files), "file_removal_denied").when(~sure, "not_fixable")
        .when((code == "TL002") & (n == 0), "missing_origin").when(((code == "TL009") & (n < 2)) | ((code == "TL005") & ~movable), "ambiguous")
    )
    action = F.when(code == "TL001", "remove_file").when(code == "TL002", "remove_dependency").when(code == "TL009", "remove_duplicate").otherwise("move_to_runtime")
    out = f.select(*by, "code", "name", "path", F.col("drop.file").alias("file"), F.col("drop.label").alias("label"), reason.alias("reason"), action.alias("action"))
    if targets is not None:
        name = F.nullif(F.regexp_extract("summary", r"^(\S+)", 1), F.lit(""))
        wanted = findings.where("code = 'TL003'").groupBy(*by, F.coalesce("member", F.lit("")).alias("_m"), name.alias("name")).agg(F.bool_or(F.col("confidence") == "certain").alias("sure"))
        at = targets.select(*by, F.coalesce("member", F.lit("")).alias("_m"), "file", "supported")
        reason = F.when(~F.col("sure"), "not_fixable").when(~F.coalesce("supported", F.lit(False)), "unsupported_target").when(F.col("name").isNull(), "missing_origin")
        none = F.lit(None).cast("string")
        added = wanted.join(at, [*by, "_m"], "left").select(*by, F.lit("TL003").alias("code"), "name", none.alias("path"), "file", F.lit("project.dependencies").alias("label"), reason.alias("reason"), F.lit("add_missing").alias("action"))
        out = out.union(added)
    done = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return out.select(*by, "code", done("action"), "name", "path", done("file"), done("label"), "reason")
