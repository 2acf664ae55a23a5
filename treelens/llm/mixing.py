"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is ``share`` of all tokens. Sources get it by weight, none more than
``most`` times its size; what is above that is shared among the others by
weight, again and again. Targets become integer quotas of blocks: each block
goes to the source with the highest quotient target / (2 * blocks so far + 1),
and the blocks of a source go to its shards in the same way, by their tokens.

A shard lays the documents of a source out in a seeded order and cuts them in
blocks of (nearly) equal tokens. Of n blocks with quota q each is taken q // n
times, and q % n of them, from a seeded place on, once more. So documents stay
whole but where such a run begins or ends. All of it is a function of the seed
and the rows: reruns agree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_of

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
SPACED = r"[\x20\x09-\x0D]*" + WORD
SEED = "treelens-mix"
#: Tokens of a block; a source's mix is within about half a block of its target.
BLOCK = 16
#: A shard of a source holds about so many tokens, but there are at most MAX_SHARDS of them.
SHARD_TOKENS, MAX_SHARDS = 100_000, 65_536
#: Tables of up to so many sources are broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2) -> dict[str | None, float]:
    """Target tokens by source: sources by code point, null last, get ``weights`` in turn."""
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while len(capped) < len(order):
        level = (total - sum(most * sizes[s] for s in order if s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: float(most * sizes[s]) if s in capped else level * weight[s] for s in order}


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotient votes / (2 * seats so far + 1), the earlier first on ties, none above its cap.

    Seats that every outcome gives are given at once, so that only about two
    for each party are dealt by the heap.
    """
    total, n = sum(votes), len(votes)
    sure = max(0.0, seats - n / 2) / total if total else 0.0
    out = [min(c, max(0, math.ceil(v * sure - 0.5) - 1)) for v, c in zip(votes, caps)]
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps)) if v > 0 and s < c]
    heapq.heapify(heap)
    left = seats - sum(out)
    while left > 0 and heap:
        i = heap[0][1]
        out[i], left = out[i] + 1, left - 1
        if out[i] < caps[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
        else:
            heapq.heappop(heap)
    return out


def _hex(column: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("long")


def blocks_of(tokens, block: int):
    """Number of blocks of a shard's tokens: the nearest count, at least one if there is a token."""
    return F.when(tokens > 0, F.greatest(F.lit(1), F.floor((2 * tokens + block) / (2 * block)))).otherwise(0).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: str = SEED, shard_tokens: int = SHARD_TOKENS, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, times, runs and taken of every row (and all of it as ``row``, with ``carry``).

    size: words of the text (null: 0). times: how often the whole document is
    taken; runs: word ranges [start, end) taken once more; taken: words
    of both. A source without words has target 0, and a table with fewer
    words than a third of a block gives an empty mix. Null sources are one
    source, the last; repeated rows are rows like any other. There is one
    row for each source on the driver, and no more than MAX_SHARDS for each
    source in a task; documents are ordered within a shard of a source only.
    """
    text, source = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(source, F.lit("")).alias("s"),
        source.isNull().alias("no_s"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text)).alias("key"),
        *([row_of(docs.columns)] if carry else []),
    )
    spark, by = docs.sparkSession, ["s", "no_s", "shard"]
    sizes = {None if r.no_s else r.s: r.n for r in rows.groupBy("s", "no_s").agg(F.sum("size").alias("n")).collect()}
    aims = targets(sizes, weights, share, most)
    total = sum(sizes.values())
    shards = {x: min(MAX_SHARDS, max(1, -(-n // shard_tokens))) for x, n in sizes.items()}
    quota = sainte_lague(list(aims.values()), math.floor(share * total / block + 0.5), [-(-most * sizes[x] // block) + most * shards[x] for x in aims])
    per = spark.createDataFrame([(x or "", x is None, sizes[x], aims[x], q, shards[x]) for x, q in zip(aims, quota)], "s string, no_s boolean, source_size long, target double, quota long, shards long")
    per = F.broadcast(per) if len(aims) <= BROADCAST_SOURCES else per
    rows = rows.join(per.select("s", "no_s", "shards"), ["s", "no_s"]).withColumn("shard", F.pmod(_hex(F.col("key")), F.col("shards"))).drop("shards")

    def deal(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("shard", ignore_index=True)
        x["q"] = sainte_lague([int(v) for v in x.tokens], int(x.quota[0]), [most * int(n) for n in x.n])
        return x.drop(columns="quota")

    parts = rows.groupBy(*by).agg(F.sum("size").alias("tokens")).withColumn("n", blocks_of(F.col("tokens"), block))
    parts = parts.join(per.drop("shards"), ["s", "no_s"]).groupBy("s", "no_s").applyInPandas(deal, "s string, no_s boolean, shard long, tokens long, n long, source_size long, target double, q long")
    place = _hex(F.md5(F.concat_ws("|", F.lit(seed), "s", F.col("shard").cast("string"))))
    some = F.col("n") > 0
    parts = parts.withColumns({"f": F.when(some, F.pmod(place, F.col("n"))).otherwise(0), "m": F.when(some, F.col("q") % F.col("n")).otherwise(0), "times": F.when(some, F.expr("q div n")).otherwise(0)})
    # the run of blocks taken once more, in tokens; it may go on at the beginning
    edge = lambda i: F.when(some, F.expr(f"({i}) * tokens div n")).otherwise(0)
    parts = parts.select(*by, "source_size", "target", "times", edge("f").alias("a1"), edge("least(n, f + m)").alias("b1"), edge("greatest(0, f + m - n)").alias("b2"))

    order = Window.partitionBy(*by).orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("at", F.sum("size").over(order) - F.col("size")).join(parts, by)
    start = lambda a: F.greatest(F.lit(0), a - F.col("at")).cast("long").alias("start")
    end = lambda b: F.least(F.col("size"), b - F.col("at")).cast("long").alias("end")
    runs = F.filter(F.array(F.struct(start(F.lit(0)), end(F.col("b2"))), F.struct(start(F.col("a1")), end(F.col("b1")))), lambda r: r["end"] > r["start"])
    out = joined.withColumn("runs", runs).withColumn("source", F.when(~F.col("no_s"), F.col("s")))
    taken = (F.col("times") * F.col("size") + tokens_of("runs")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("times").cast("long").alias("times"), "runs", taken.alias("taken"), *["row"] * carry)


def tokens_of(runs):
    """Words within the runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"])


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, a partly taken one with those words only and the white space before each."""
    plan = mix(docs, id_col, text_col, source_col, carry=True, **how)
    rows = plan.withColumn("copy", F.explode(F.expr("sequence(1, times + 1)"))).withColumn("part", tokens_of("runs"))
    last, some = F.col("copy") > F.col("times"), F.col("part") > 0
    rows = rows.where(~last | some)
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text.cast("string"), F.lit(SPACED), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")
    new = F.when(last & (F.col("part") < F.col("size")), cut).otherwise(text.cast("string"))
    return rows.select(*[new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
