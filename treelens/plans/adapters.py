"""The engine's relations, as views of the star-schema tables, so that every operator runs at their scale.

An order is a file, a line item an import, a part a module, a brand a
distribution, a customer a config line. The same views in SQL are in oracles.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelens.functions import scalars as s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(key) -> F.Column:
    return F.concat(F.lit("src/pkg"), (key % 50).cast("string"), F.lit("/m_"), key.cast("string"), F.lit(".py"))


def files(spark, d) -> DataFrame:
    """path, kind, context, opaque and key."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    context = F.when(F.col("o_orderstatus") == "O", "runtime").when(F.col("o_orderstatus") == "F", "test").otherwise("dev")
    return o.select(key.alias("key"), path_of(key).alias("path"), F.lit("python").alias("kind"), context.alias("context"), (F.col("o_orderpriority") == "1-URGENT").alias("opaque"))


def brand(x) -> F.Column:
    return s.normalize_name(F.replace(x, F.lit("#"), F.lit("_")))


def imports(spark, d) -> DataFrame:
    """file key, part key, line, optional, guarded."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("optional"), (F.col("l_linestatus") == "F").alias("platform_guarded")
    )


def part_dist(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), brand(F.col("p_brand")).alias("distribution"))


def used(spark, d) -> DataFrame:
    """Uses of distributions: distribution, context, optional, platform_guarded, file, line."""
    i = imports(spark, d).join(part_dist(spark, d), "part").join(files(spark, d).select("key", "path", "context"), "key")
    return i.select("distribution", "context", "optional", "platform_guarded", F.col("path").alias("file"), "line", "part")


def declared(spark, d) -> DataFrame:
    """Every third brand is declared, in a context for each type of its largest parts."""
    p = table(spark, d, "part").where("p_size = 50").withColumn("n", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")).where("n % 3 = 0")
    kind = F.when(F.col("p_type").startswith("S"), "runtime").when(F.col("p_type").startswith("P"), "group").otherwise("optional")
    return p.select(brand(F.col("p_brand")).alias("distribution"), kind.alias("kind"), F.lower(F.substring_index("p_type", " ", 1)).alias("label"), F.when(F.col("n") % 2 == 0, "python_version < '4'").alias("marker"), F.lit(False).alias("opaque")).distinct()


def edges(spark, d) -> DataFrame:
    """Imports between files, as order keys."""
    n = table(spark, d, "orders").count()
    return table(spark, d, "lineitem").where("l_quantity >= 42").select(F.col("l_orderkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("dst")).distinct()


def seeds(spark, d) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("node"))


def lock(spark, d) -> DataFrame:
    """Brands need the brands of the parts on the next line of an order."""
    i = imports(spark, d).join(part_dist(spark, d), "part")
    a, b = i.select("key", "line", F.col("distribution").alias("src")), i.select("key", (F.col("line") - 1).alias("line"), F.col("distribution").alias("dst"))
    n = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int")
    return a.join(b, ["key", "line"]).where((n("dst") - n("src")).between(1, 2)).select("src", "dst").distinct()


def candidates(spark, d) -> DataFrame:
    """A finding for each line item of the first orders of a customer: all kinds of subjects, severities and confidences."""
    i = table(spark, d, "lineitem")
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    code = F.concat(F.lit("TL"), F.lpad((p % 10 + 1).cast("string"), 3, "0"))
    kind = F.when(code.isin("TL001"), "file").when(code.isin("TL002", "TL005", "TL009"), "distribution").when(code == "TL008", "binary").when(code.isin("TL006", "TL007"), "symbol").otherwise("import")
    module = F.concat(F.lit("pkg"), (o % 50).cast("string"), F.lit(".m_"), o.cast("string"))
    of = lambda kinds, x: F.when(kind.isin(*kinds), x)
    return i.select(
        code.alias("code"), kind.alias("kind"),
        of(["file", "symbol", "import"], path_of(o)).alias("path"),
        F.when(kind == "symbol", module).when(kind == "import", F.concat(F.lit("mod"), (p % 40).cast("string"))).alias("module"),
        of(["distribution", "binary", "symbol"], F.concat(F.lit("name_"), (p % 60).cast("string"))).alias("name"),
        n.alias("line"),
        F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), (p % 3 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(F.lit("certain"), F.lit("likely"), F.lit("maybe")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("confidence"),
        F.lit("").alias("message"),
        F.when(o % 11 == 0, F.concat(F.lit("member"), (o % 3).cast("string"))).alias("member"),
        n.alias("seq"),
    )


def directives(spark, d) -> DataFrame:
    """Ignore directives of every seventh file; every second of them for the whole file."""
    o = F.col("o_orderkey")
    codes = F.array(F.concat(F.lit("TL"), F.lpad((o % 10 + 1).cast("string"), 3, "0")), F.lit("TL003"))
    return table(spark, d, "orders").where("o_orderkey % 7 = 0").select(path_of(o).alias("path"), (o % 4 + 1).cast("int").alias("line"), (o % 2 == 0).alias("file_level"), codes.alias("codes"), F.lit(1).alias("seq"))


def trees(spark, d) -> DataFrame:
    """A source tree for each customer: project, path, content.

    An order is a module that imports the customer's next one (but for every
    fourth order) and a distribution for each line item; the first is the
    entry. Two distributions are declared. Every customer has a stub, every
    fifth a file with an error.
    """
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    own = F.concat(F.lit("c"), c.cast("string"))
    here = table(spark, d, "customer").select(c, own.alias("project"), F.concat(F.lit("src/"), own, F.lit("/")).alias("at"))
    by = Window.partitionBy("c_custkey").orderBy(k)
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), k).withColumns({"next": F.lead(k).over(by), "rank": F.row_number().over(by)})
    used = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("import dep_"), (F.col("l_partkey") % 26).cast("string")).alias("line"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(used)).alias("lines"))
    follows = F.when((k % 4 != 0) & F.col("next").isNotNull(), F.concat(F.lit("import "), "project", F.lit(".m_"), F.col("next").cast("string")))
    text = F.concat_ws("\n", follows, F.transform(F.coalesce("lines", F.array()), lambda x: x["line"]), F.lit("def main(): pass\n"))
    modules = here.join(orders.join(lines, "o_orderkey", "left"), "c_custkey")
    modules = modules.select("project", F.concat("at", F.lit("m_"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"), F.when(F.col("rank") == 1, k).alias("first"))
    dep = lambda n: F.concat(F.lit('"dep-'), n.cast("string"), F.lit('"'))
    first = modules.where("first is not null").select("project", "first")
    run = F.when(F.col("first").isNotNull(), F.concat(F.lit('[project.scripts]\nrun = "'), own, F.lit(".m_"), F.col("first").cast("string"), F.lit(':main"\n'))).otherwise("")
    manifest = F.concat(F.lit('[project]\nname = "'), own, F.lit('"\ndependencies = ['), dep(c % 7), F.lit(", "), dep(c % 11 + 13), F.lit("]\n"), run)
    out = here.join(first, "project", "left").select("project", F.lit("pyproject.toml").alias("path"), manifest.alias("text"))
    for name, content, where in (("__init__.py", "", F.lit(True)), ("types.pyi", "x: int\n", F.lit(True)), ("broken.py", "def (\n", c % 5 == 0)):
        out = out.union(here.where(where).select("project", F.concat("at", F.lit(name)), F.lit(content)))
    return out.union(modules.select("project", "path", "text")).select("project", "path", F.encode("text", "UTF-8").alias("content"))
