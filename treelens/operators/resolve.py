"""Where imports come from: a ladder of joins, climbed once for each import root.

stdlib > the project's own packages > a workspace member > installed
distributions > the user's map > the bundled map > the root's own name, if
normalising changes it > unknown. The dimension tables are small and fixed
(see treelens.sources.dims) or one row for each package, and AQE broadcasts
them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.functions import scalars as s
from treelens.session import cut


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: what is inserted first wins."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") == 1).drop("_at")


def last_of(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key: a later layer overwrites."""
    return first_of(rows, keys, [order.desc()])


def providers(imports: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """import_root -> sorted distinct distributions that provide it, from (import_root, distribution)."""
    return imports.groupBy(*by, "import_root").agg(F.sort_array(F.collect_set("distribution")).alias("distributions"))


def ambiguous(imports: DataFrame) -> DataFrame:
    """Import roots that several installed distributions provide; the first is taken."""
    return providers(imports).where(F.size("distributions") > 1).select("import_root", F.col("distributions")[0].alias("chosen"), F.size("distributions").alias("candidates"))


def overlay(layers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """binary -> distribution from (binary, distribution, layer): the highest layer, and in it the last row by seq."""
    return last_of(layers, [*by, "binary"], F.struct("layer", "seq")).select(*by, "binary", "distribution")


def resolve_roots(roots: DataFrame, stdlib: DataFrame, own: DataFrame, members: DataFrame, installed: DataFrame, user: DataFrame, bundled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """origin, distribution, confidence and member of each distinct ``import_root``.

    stdlib: name. own: name (packages and the project). members: name,
    member. installed, user, bundled: import_root, distribution. Names of own
    packages are compared normalised, all else as it is. A dimension that has
    some of the columns ``by`` (project, version) holds for their values only.
    """
    on = lambda table: [c for c in by if c in table.columns]
    r = roots.select(*by, "import_root").where("import_root is not null and import_root <> ''").distinct()
    norm = s.normalize_name(F.col("import_root"))
    r = r.withColumn("norm", norm)
    r = r.join(stdlib.select(*on(stdlib), F.col("name").alias("import_root"), F.lit(True).alias("is_std")).distinct(), [*on(stdlib), "import_root"], "left")
    r = r.join(own.select(*on(own), s.normalize_name(F.col("name")).alias("norm"), F.lit(True).alias("is_own")).distinct(), [*on(own), "norm"], "left")
    r = r.join(members.groupBy(*on(members), F.col("name").alias("import_root")).agg(F.min("member").alias("member")), [*on(members), "import_root"], "left")
    for name, table in (("v", installed), ("u", user), ("b", bundled)):
        r = r.join(providers(table, tuple(on(table))).withColumnRenamed("distributions", name), [*on(table), "import_root"], "left")
    renamed = (F.col("norm") != F.col("import_root")) & (F.col("norm") != "")
    tier = (
        F.when(F.col("is_std"), 1).when(F.col("is_own"), 2).when(F.col("member").isNotNull(), 3)
        .when(F.col("v").isNotNull(), 4).when(F.col("u").isNotNull(), 5).when(F.col("b").isNotNull(), 6).when(renamed, 7).otherwise(8)
    )
    r = r.withColumn("tier", tier)
    t = F.col("tier")
    several = lambda c: F.size(c) > 1
    return r.select(
        *by,
        "import_root",
        F.when(t == 1, "stdlib").when(t.isin(2, 3), "first_party").when(t == 8, "unknown").otherwise("third_party").alias("origin"),
        F.when(t == 4, F.col("v")[0]).when(t == 5, F.col("u")[0]).when(t == 6, F.col("b")[0]).when(t == 7, F.col("norm")).alias("distribution"),
        F.when(t <= 3, "certain").when(t == 4, F.when(several("v"), "maybe").otherwise("certain")).when(t == 5, "likely").when(t == 6, F.when(several("b"), "maybe").otherwise("certain")).when(t == 7, "maybe").otherwise("maybe").alias("confidence"),
        F.when(t == 3, F.col("member")).alias("member"),
        "tier",
    )


#: At most so many import roots are dealt apart, each with at least this share of all sites.
HOT = 1000


def resolve(imports: DataFrame, *dims: DataFrame, by: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """``imports`` (with module) and what their roots resolve to."""
    sites = imports.withColumn("import_root", s.import_root(F.col("module")))
    return spread(sites, resolve_roots(sites, *dims, by=by), [*by, "import_root"], hot)


def spread(sites: DataFrame, roots: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """``sites`` joined with the one row of ``roots`` for their ``keys``, hot keys dealt over many tasks.

    Keys are counted (partial sums, so a hot one is few rows); those with
    more than a ``hot``-th of the sites, of which there are at most ``hot``,
    get a number of salts in proportion and as many copies of their row.
    """
    share = max(1, -(-sites.count() // hot))
    counts = sites.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    salts = F.broadcast(cut(counts.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))))
    spots = F.pmod(F.xxhash64(*[c for c, kind in sites.dtypes if not kind.startswith("map")]), F.col("_salts")).cast("int")
    dealt = sites.join(salts, keys, "left").withColumn("_salt", F.coalesce(spots, F.lit(0))).drop("_salts")
    copies = roots.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def owners(files: DataFrame, members: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Owning member of each file (path): that of the longest path that is the file or a folder above it.

    Every folder above a file is a row, so the join is on equal paths and
    grows with depth, not with the number of members.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select(*by, "path", F.explode(above).alias("prefix"))
    held = up.join(members.select(*by, F.col("path").alias("prefix"), F.col("id").alias("member")), [*by, "prefix"])
    best = held.groupBy(*by, "path").agg(F.max_by("member", F.struct(F.length("prefix"), F.col("member"))).alias("member"))
    return files.join(best, [*by, "path"], "left")


def module_index(files: DataFrame, layout: str, packages: list[str]) -> DataFrame:
    """module -> path; of files that are the same module the first by path is it."""
    rows = files.withColumn("module", s.index_module(F.col("path"), layout, packages)).where(F.col("module").isNotNull())
    return first_of(rows.select("module", "path"), ["module"], [F.col("path")])


def candidates_of(module: Column, layout: str | Column) -> Column:
    """Paths a module may have, the layout's first."""
    path = F.replace(module, F.lit("."), F.lit("/"))
    src = [F.concat(F.lit("src/"), path, F.lit(end)) for end in (".py", "/__init__.py")]
    flat = [F.concat(path, F.lit(end)) for end in (".py", "/__init__.py")]
    in_src = layout == "src" if isinstance(layout, Column) else F.lit(layout == "src")
    return F.when(in_src, F.array(*src, *flat)).otherwise(F.array(*flat, *src))


def module_paths(targets: DataFrame, files: DataFrame, layout: str | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """path of each ``module`` of ``targets``: the first candidate there is, else the first path that ends in src/ and it."""
    module = [*by, "module"]
    t = targets.withColumn("_layout", layout if isinstance(layout, Column) else F.lit(layout)).select(*module, "_layout").distinct()
    each = t.select(*module, F.posexplode(candidates_of(F.col("module"), F.col("_layout"))).alias("rank", "path"))
    direct = each.join(files.select(*by, "path"), [*by, "path"]).groupBy(*module).agg(F.min_by("path", "rank").alias("direct"))
    ends = files.where(F.col("path").contains("/src/")).select(*by, "path", F.regexp_replace(F.regexp_extract("path", r"/src/(.*)$", 1), r"(/__init__)?\.py$", "").alias("tail"))
    nested = t.withColumn("tail", F.replace(F.col("module"), F.lit("."), F.lit("/"))).join(ends, [*by, "tail"]).groupBy(*module).agg(F.min("path").alias("nested"))
    return t.join(direct, module, "left").join(nested, module, "left").select(*module, F.coalesce("direct", "nested").alias("path"))


def merge_origins(rows: DataFrame) -> DataFrame:
    """Origin of each module from (module, origin, seq): the highest rank, and of equal ones the first seen."""
    ranked = rows.withColumn("rank", s.rank(F.col("origin"), s.ORIGIN))
    return ranked.groupBy("module").agg(F.max_by("origin", F.struct("rank", -F.col("seq"))).alias("origin"))
