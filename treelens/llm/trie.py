"""A trie of conversations without a trie: prefixes as keys, and smallest-member ownership.

A node is a sequence of first turns. Its key is the exclusive or of a 128-bit
hash of each turn and its depth, so prefix keys are running aggregates. The
smallest conversation through a node owns it; what a conversation owns is a
suffix of its path, since the members of a child are members of its parent. So
sums over a subtree become sums over the conversations through its top: the
tokens of a conversation from there on, less those of the turns that it owns,
is what its turns share with smaller conversations.

Turns are numbered and hashed within stretches of a conversation, and the
stretches put together, so a long conversation is not gathered. Owners come
from a grouping and a join rather than from a window over each node: all
conversations meet in the root, and a third of them may begin alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Runs of what is no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Values of turn that are numbered together.
STRETCH = 1024
#: Stretch of borrowed turns, and of those without a number.
BORROWED, UNNUMBERED = -(2**62), -(2**62) + 1
KEY = ["key1", "key2"]
CONV = ["c", "stretch"]


def borrowed(conv: Column, most: int = 4) -> Column:
    """How many turns a conversation takes from its model."""
    return (F.crc32(conv.cast("string")) % most).cast("int")


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of their model, ``conv_id - conv_id % family``.

    One row for each turn (c, stretch, n within it, depth, t1 and t2 hash of
    the turn, words), and stretches with their counts: two tables.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(text, F.lit("treelens"), role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), "t1", "t2"]
    # the number of a row is compared with a constant, so Spark keeps few rows of each conversation before it shuffles
    first = turns.where(F.col("c") % family == 0).withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy(*order))).where(F.col("n") < most)
    heads = first.groupBy(F.col("c").alias("b")).agg(F.array_sort(F.collect_list(F.struct("n", "t1", "t2", "words"))).alias("head"))
    own = turns.select("c").distinct().withColumns({"b": F.col("c") - F.col("c") % family, "h": borrowed(F.col("c"), most)})
    taken = own.where("h > 0").join(heads, "b").select("c", F.inline(F.slice("head", F.lit(1), F.col("h")))).select("c", F.lit(BORROWED).alias("stretch"), "n", "t1", "t2", "words")
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(UNNUMBERED)).cast("long")
    at = Window.partitionBy(*CONV).orderBy(*order)
    mine = turns.withColumn("stretch", stretch).withColumn("n", F.row_number().over(at)).select("c", "stretch", "n", "t1", "t2", "words")
    return mine.unionByName(taken)


def occurrences(turns: DataFrame, most: int = 4) -> DataFrame:
    """Every prefix of every conversation: c, depth, key1, key2, before (words of earlier turns), words, len (turns in all)."""
    conv = Window.partitionBy("c").orderBy("stretch")
    earlier, whole = conv.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("c")
    own = F.col("stretch") != BORROWED
    n = F.col("count")
    counts = turns.groupBy(*CONV).agg(F.count("*").alias("count"))
    counts = counts.select(*CONV, F.coalesce(F.sum(F.when(own, n)).over(earlier), F.lit(0)).alias("passed"), F.coalesce(F.sum(F.when(~own, n)).over(whole), F.lit(0)).alias("taken"))
    h = borrowed(F.col("c"), most)
    place = F.col("passed") + F.col("n")
    t = turns.join(counts, CONV).where(~own | (place > h)).withColumn("depth", F.when(own, F.col("taken") + place - h).otherwise(F.col("n")).cast("long"))
    hashes = {"key1": F.xxhash64("depth", "t1", "t2"), "key2": F.xxhash64("t2", "depth", "t1")}
    t = t.withColumns(hashes).select(*CONV, "depth", *KEY, "words")
    sums = t.groupBy(*CONV).agg(*[F.bit_xor(k).alias(k) for k in KEY], F.sum("words").alias("words"), F.max("depth").alias("last"))
    prior = [F.coalesce(F.bit_xor(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in KEY]
    sums = sums.select(*CONV, *prior, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_words"), F.max("last").over(whole).alias("len"))
    upto = Window.partitionBy(*CONV).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({**{k: F.bit_xor(k).over(upto) for k in KEY}, "upto": F.sum("words").over(upto)}).join(sums, CONV)
    keys = [F.col(k).bitwiseXOR(F.col(f"_{k}")).alias(k) for k in KEY]
    return t.select("c", "depth", *keys, (F.col("_words") + F.col("upto") - F.col("words")).alias("before"), "words", "len")


def prefixes(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first; of equal numbers the order is that of a
    hash of role and text. Null roles and texts count as empty; rows with a
    null conv_id are left out; repeated rows are turns of their own; other
    columns are left aside. A conversation without turns of its own ends in
    the root. An empty table gives no rows. saved_tokens is what a cache of
    prefixes saves in the node's subtree: the words of each node's last turn,
    times its members but one.
    """
    o = written(occurrences(rebuilt(conversations, family, most), most), "trie-paths")
    every = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c")).distinct()
    least = conversations.agg(F.min(F.col("conv_id").cast("long"))).first()[0]
    nodes = o.groupBy("depth", *KEY).agg(F.min("c").alias("owner"), F.max("len").alias("deepest"))
    j = o.join(nodes, ["depth", *KEY])
    mine = F.col("owner") == F.col("c")
    path = j.groupBy("c").agg(
        F.max("len").alias("len"),
        F.min(F.when(mine, F.col("depth"))).alias("from"),
        F.min(F.when(mine, F.col("before"))).alias("from_words"),
        F.max(F.col("before") + F.col("words")).alias("all_words"),
        F.max_by("owner", F.when(~mine, F.col("depth"))).alias("above"),
        F.coalesce(F.bool_or(mine & (F.col("depth") == F.col("deepest"))), F.lit(False)).alias("leaf"),
    )
    # the root is every conversation's, and the smallest one's own
    root = every.join(path, "c", "left").select(
        "c",
        F.coalesce("len", F.lit(0)).alias("len"),
        F.when(F.col("c") == least, 0).otherwise(F.coalesce("from", F.col("len") + 1, F.lit(1))).alias("from"),
        F.when(F.col("c") == least, 0).otherwise(F.coalesce("from_words", "all_words", F.lit(0))).alias("from_words"),
        F.coalesce("above", F.lit(least)).alias("above"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"),
    )
    root = written(root, "trie-owners")
    top = root.select("c", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in KEY], F.lit(0).cast("long").alias("before"), *root.columns[1:])
    rows = o.select("c", "depth", *KEY, "before").join(root, "c").unionByName(top)
    depth = F.col("depth")
    parent = F.when(depth > F.col("from"), F.col("c")).when((depth == F.col("from")) & (depth > 0), F.when(depth == 1, F.lit(least)).otherwise(F.col("above")))
    out = rows.groupBy("depth", *KEY).agg(
        F.min("c").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((depth + 1 >= F.col("from")) & (depth + 1 <= F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("from_words") - F.col("before"))).cast("long").alias("saved_tokens"),
        F.max("len").alias("deepest"),
    )
    # a node without a turn below it, reached by no leaf of a path with turns, is the root of turnless conversations
    out = out.withColumn("n_leaves", F.when(F.col("deepest") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")))
    said = ends(o, root)
    shown = out.join(said, ["depth", *KEY], "left")
    none = F.sha2(F.lit(""), 256)
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def ends(o: DataFrame, root: DataFrame, chunk_bits: int = 12) -> DataFrame:
    """depth, keys and ends_sha256 of the nodes in which conversations end.

    Ids are put together in chunks of 4096 consecutive numbers first, so a
    node's digest, which needs all its text, reads few rows.
    """
    last = o.where("depth = len").select("depth", *KEY, "c")
    last = last.unionByName(root.where("len = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in KEY], "c"))
    chunk = F.shiftright("c", chunk_bits).alias("chunk")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    parts = last.groupBy("depth", *KEY, chunk).agg(text.alias("ids"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"])
    return parts.groupBy("depth", *KEY).agg(F.sha2(F.array_join(ordered, ","), 256).alias("ends_sha256"))
