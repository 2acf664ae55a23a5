"""Scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelens.functions.globs import any_glob

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranks of ordered values (fixed).
CONFIDENCE = {"certain": 2, "likely": 1, "maybe": 0}
SEVERITY = {"error": 3, "warning": 2, "info": 1}
ORIGIN = {"first_party": 3, "stdlib": 3, "third_party": 2, "unknown": 1}
#: Kinds of declared dependencies, the last to go first when one of several is removed.
REMOVAL = {"runtime": 0, "optional": 1, "group": 2, "setup_extra": 3}


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def normalize_name(x: Column) -> Column:
    """Distribution name: runs of - _ . are one -, ASCII letters small."""
    return F.regexp_replace(ascii_lower(x), "[-_.]+", "-")


def import_root(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, n in ranks.items():
        out = F.when(value == name, n).otherwise(out)
    return out


def normalize_path(path: Column) -> Column:
    """Forward slashes, without leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def _dotted(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def index_module(path: Column, layout: str, packages: list[str]) -> Column:
    """Module by which a file can be imported, null if it cannot: of .py files, below src/ or in a known package."""
    below = F.when(path.startswith("src/"), F.regexp_replace(path, "^src/", ""))
    first = F.regexp_replace(F.substring_index(path, "/", 1), r"\.py$", "")
    flat = F.when(first.isin(packages), path) if packages else F.lit(None).cast("string")
    kept = below if layout == "src" else flat if layout == "flat" else F.coalesce(below, flat)
    name = _dotted(kept)
    return F.when(path.endswith(".py") & (name != ""), name)


def parser_module(path: Column, layout: str) -> Column:
    """Module name for relative imports: any path maps, and src/ is dropped only in that layout."""
    return _dotted(F.regexp_replace(path, "^src/", "") if layout == "src" else path)


def relative_module(module: Column, is_init: Column, level: Column, suffix: Column, name: Column) -> Column:
    """Absolute module of a relative import; null if it leaves the package.

    The base is the containing package (an __init__ is its own), up level - 1
    times; then the suffix, or else the imported name.
    """
    parts = F.split(module, r"\.")
    base = F.when(is_init, F.size(parts)).otherwise(F.size(parts) - 1) - (level - 1)
    rest = F.coalesce(F.when(suffix != "", suffix), F.when(name != "", name))
    head = F.slice(parts, F.lit(1), F.greatest(F.lit(0), base).cast("int"))
    return F.when((base >= 1) & (level >= 1) & (module != ""), F.array_join(F.when(rest.isNotNull(), F.concat(head, F.array(rest))).otherwise(head), "."))


def file_context(path: Column) -> Column:
    """runtime, test, docs or dev, by place and name."""
    base = F.lower(F.substring_index(path, "/", -1))
    test = path.startswith("tests/") | (F.substring_index(path, "/", -1) == "conftest.py") | base.rlike(r"^test_.*\.pyi?$") | base.rlike(r"^.*_test\.pyi?$")
    dev = path.startswith("scripts/") | (path == "noxfile.py")
    return F.when(test, "test").when(path.startswith("docs/"), "docs").when(dev, "dev").otherwise("runtime")


def import_context(type_checking: Column, context: Column) -> Column:
    return F.when(type_checking, "type").when(context == "test", "test").otherwise("runtime")


def entry_spec(spec: Column) -> Column:
    """path[:symbol] as a struct; null if the path or the symbol is empty, or there are two colons."""
    ok = spec.rlike(r"^[^:]+(:[^:]+)?$")
    return F.when(ok, F.struct(F.substring_index(spec, ":", 1).alias("path"), F.when(spec.contains(":"), F.substring_index(spec, ":", -1)).alias("symbol")))


def module_symbol(x: Column) -> Column:
    """module:symbol as a struct; null unless both are there. The first colon parts them."""
    at = F.instr(x, F.lit(":"))
    left, right = F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.length(x))
    return F.when((at > 1) & (F.length(right) > 0), F.struct(left.alias("module"), right.alias("symbol")))


def manifest_target(x: Column) -> Column:
    """Target of a script entry: of a server command, of module:symbol, or a bare module."""
    served = F.regexp_extract(x, r"\buvicorn\s+([A-Za-z_][\w.]*):([A-Za-z_]\w*)", 1)
    symbol = F.regexp_extract(x, r"\buvicorn\s+([A-Za-z_][\w.]*):([A-Za-z_]\w*)", 2)
    none = F.lit(None).cast("string")
    split = module_symbol(x)
    return F.when(served != "", F.struct(served.alias("module"), symbol.alias("symbol"))).when(split.isNotNull(), split).otherwise(F.struct(x.alias("module"), none.alias("symbol")))


def app_module(module: Column) -> Column:
    """An application class stands for its first package."""
    return F.when(module.endswith("AppConfig"), import_root(module)).otherwise(module)


def symbol_public(name: Column, exports: Column) -> Column:
    return ~name.startswith("_") | F.coalesce(F.array_contains(exports, name), F.lit(False))


def stable_target(kind: Column, path: Column, module: Column, name: Column, member: Column) -> Column:
    """What a finding is about, without its line."""
    own = F.when(kind == "file", path).when(kind.isin("distribution", "binary"), name).when(kind == "symbol", F.concat(F.coalesce(path, module), F.lit(":"), name)).otherwise(F.concat(path, F.lit(":"), module))
    return F.when(member.isNotNull(), F.concat(member, F.lit(":"), own)).otherwise(own)


def fingerprint(code: Column, target: Column) -> Column:
    return F.concat(code, F.lit(":"), target)


def sort_key(kind: Column, path: Column, module: Column, name: Column, line: Column) -> Column:
    """Place of a finding among those of its rule; lines compare as text."""
    return F.when(kind.isin("distribution", "binary"), name).when(kind == "file", path).when(kind == "symbol", F.concat(module, F.lit(":"), name)).otherwise(F.concat(path, F.lit(":"), line.cast("string"), F.lit(":"), module))


def command_tokens(text: Column) -> Column:
    """Words of a command line, trimmed of what cannot be in a command name."""
    words = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9\-_.]+|[^A-Za-z0-9\-_.]+$", ""))
    return F.filter(words, lambda w: w != "")


def run_modules(tokens: Column) -> Column:
    """Names run as ``python -m NAME`` in a list of tokens."""
    following = F.transform(tokens, lambda t, i: F.when((t.rlike(r"^python[0-9.]*$")) & (F.try_element_at(tokens, i + 2) == "-m"), F.try_element_at(tokens, i + 3)))
    return F.filter(following, lambda t: t.isNotNull())


def target_minor(x: Column) -> Column:
    """Minor version of py3NN; null for what is no such text (two or three digits after py)."""
    return F.when(x.rlike(r"^py3[0-9]{2}$"), F.substring(x, 4, 3).cast("int"))


def directives(line: Column) -> Column:
    """Ignore directives of a line: struct of file_level and codes; null if there is none."""
    pattern = r"#\s*treelens:\s*(file-)?ignore\[(TL[0-9]{3}(?:,TL[0-9]{3})*)\]"
    codes = F.regexp_extract(line, pattern, 2)
    return F.when(codes != "", F.struct((F.regexp_extract(line, pattern, 1) != "").alias("file_level"), F.split(codes, ",").alias("codes")))


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether any glob matches; the globs are one regular expression."""
    return path.rlike(any_glob(patterns)) if patterns else F.lit(False)
