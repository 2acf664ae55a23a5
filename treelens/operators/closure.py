"""Reachability over edges in few rounds: breadth-first search, with chains contracted.

A node with one way in is as far as that way says, so it needs no search: such
nodes are forests, and pointer jumping finds their heads in a number of rounds
that grows with the logarithm of their length. Between heads the search goes
on over weighted edges. A few plain levels come first, as most graphs are
shallow, and contraction begins where they are not enough. Every round's rows
are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.session import Steps, saved, tasks, uncollected

#: Plain levels before chains are contracted.
PLAIN = 4
#: Chains are contracted while that leaves at most this share of the nodes.
SHRINKS = 0.5


#: Between the parts of a node's name.
PART = "\x1f"


def nodes(parts: list[str]) -> Column:
    """Columns as the name of one node, so that equal names in two projects are two nodes."""
    return F.concat_ws(PART, *parts)


def of_node(node: str, names: list[str]) -> list[Column]:
    """The parts of a node's name again; the last may be anything."""
    parts = F.split(F.col(node), PART, len(names))
    return [parts[i].alias(n) for i, n in enumerate(names)]


def _chains(edges: DataFrame, fixed: DataFrame) -> DataFrame:
    """node, up and off (distance from it) of the nodes with one way in, but for ``fixed`` ones, of weighted edges (src, dst, w)."""
    ways = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"), F.min("w").alias("off"))
    chains = ways.where((F.col("n") == 1) & (F.col("up") != F.col("dst"))).join(fixed.select(F.col("node").alias("dst")), "dst", "left_anti")
    return chains.select(F.col("dst").alias("node"), "up", "off")


def _contracted(edges: DataFrame, jump: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame, int]:
    """(edges between heads, node -> head and distance, rounds) of edges and their chains.

    A head is a node that is in no chain. Nodes that only a cycle of chains
    leads into have no head and are left out: nothing reaches them.
    """
    # a chain has no more nodes than there are; what is still open then goes round a cycle
    rounds, open_, most = 0, True, jump.count().bit_length()
    while open_ and rounds < most:
        rounds += 1
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("off").alias("off2"))
        joined = jump.join(above, "up", "left")
        step = joined.select("node", F.coalesce("up2", "up").alias("up"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), F.col("up2").isNotNull().alias("moved"))
        jump = steps.keep(step)
        open_ = not jump.where("moved").isEmpty()
        jump = jump.drop("moved")
    inner = jump.join(jump.select(F.col("node").alias("up")), "up", "left_anti")
    heads = inner.select("node", F.col("up").alias("head"), "off")
    chain = jump.select(F.col("node").alias("src"), F.lit(True).alias("inside"))
    e = edges.join(jump.select(F.col("node").alias("dst")), "dst", "left_anti")
    e = e.join(heads.select(F.col("node").alias("src"), "head", "off"), "src", "left").join(chain, "src", "left")
    e = e.where("head is not null or inside is null")
    e = e.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("off", F.lit(0))).alias("w")).where(F.col("src") != F.col("dst"))
    return steps.keep(e.groupBy("src", "dst").agg(F.min("w").alias("w"))), steps.keep(heads), rounds


def distances(edges: DataFrame, seeds: DataFrame, most: int | None = None, plain: int = PLAIN) -> tuple[DataFrame, int]:
    """(node and least number of edges from any seed, rounds) of what is reachable from ``seeds`` (node) over ``edges`` (src, dst)."""
    steps = Steps(edges.sparkSession)
    front = steps.keep(seeds.select("node").where(F.col("node").isNotNull()).distinct().withColumn("dist", F.lit(0).cast("long")))
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct().repartition("src").persist()
    seen, rounds = front, 0
    while rounds < plain and not front.isEmpty() and (most is None or rounds < most):
        rounds += 1
        met = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front = steps.keep(met.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(rounds).cast("long")))
        seen = seen.union(front)
    done = steps.keep(seen)
    if front.isEmpty() or (most is not None and rounds >= most):
        edges.unpersist()
        return steps.last(done), rounds
    # what is left: edges into nodes that are not reached, from them or from the frontier
    rest = edges.join(done.select(F.col("node").alias("dst")), "dst", "left_anti")
    old = done.join(front.select("node"), "node", "left_anti")
    rest = rest.join(old.select(F.col("node").alias("src")), "src", "left_anti").withColumn("w", F.lit(1).cast("long"))
    core, ways = steps.keep(rest), []
    edges.unpersist()
    while True:
        chains = steps.keep(_chains(core, front))
        rounds += 1
        if chains.isEmpty() or chains.count() < (1 - SHRINKS) * core.select("dst").distinct().count():
            break
        core, heads, more = _contracted(core, chains, steps)
        ways.append(heads)
        rounds += more
    # the search between heads: nodes that got nearer tell their successors
    best = changed = front
    while not changed.isEmpty():
        rounds += 1
        told = core.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        changed = steps.keep(told.join(best, "node", "left").where("dist is null or new < dist").select("node", F.col("new").alias("dist")))
        best = steps.keep(best.join(changed.select("node"), "node", "left_anti").union(changed))
    for heads in reversed(ways):
        inner = heads.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("dist") + F.col("off")).alias("dist"))
        best = steps.keep(best.union(inner))
    found = done.join(front.select("node"), "node", "left_anti").union(best)
    if most is not None:
        found = found.where(F.col("dist") <= most)
    return steps.last(found), rounds


def reach(edges: DataFrame, seeds: DataFrame, order: list[Column] | None = None, most: int | None = None, plain: int = PLAIN) -> DataFrame:
    """node, depth and pred of everything reachable from ``seeds`` (node) over ``edges`` (src, dst).

    Cycles are fine. pred is the smallest source of the least depth (by
    ``order`` over the edge's columns first, if given); seeds have none.
    ``most`` bounds the depth. Null nodes, and edges with a null end, take no
    part. ``rounds`` of the result is how many rounds it took.
    """
    found, rounds = distances(edges, seeds, most, plain)
    before = found.select(F.col("node").alias("src"), (F.col("dist") + 1).alias("dist"))
    into = edges.where("src is not null and dst is not null").join(before, "src").join(found.select(F.col("node").alias("dst"), "dist"), ["dst", "dist"])
    way = F.struct(*(order or []), F.col("src"))
    pred = into.groupBy(F.col("dst").alias("node")).agg(F.min_by("src", way).alias("pred"))
    out = found.join(pred, "node", "left").select("node", F.col("dist").cast("int").alias("depth"), "pred")
    out.rounds = rounds
    return out


#: Edges of one project that a task searches by itself; larger graphs go through ``reach``.
WITHIN = 200_000


def within(edges: DataFrame, seeds: DataFrame, most: int = WITHIN) -> DataFrame:
    """project, node, depth and pred as ``reach`` finds them in the graph of each project, by least line.

    edges: project, src, dst, line. seeds: project, node. No edge leads from
    one project to another, so a task searches its small graphs one after the
    other, with one shuffle for all levels. Projects with more than ``most``
    edges are searched together, by rounds of joins.
    """
    import pyarrow as pa

    names = ["project", "node", "depth", "pred"]
    types = (pa.string(), pa.string(), pa.int32(), pa.string())

    def search(project: str, ways: dict[str, list], found: dict[str, int]) -> list[tuple]:
        preds: dict[str, tuple] = {}
        front, depth = list(found), 0
        while front:
            depth += 1
            met = []
            for src in front:
                for dst, known, line in ways.get(src, ()):
                    if dst not in found:
                        found[dst] = depth
                        met.append(dst)
                    if found[dst] == depth and (dst not in preds or (known, line, src) < preds[dst]):
                        preds[dst] = (known, line, src)
            front = met
        return [(project, n, d, preds[n][2] if n in preds else None) for n, d in found.items()]

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        out, project, ways, found = [], None, {}, {}
        for at, src, dst, line in rows():
            if at != project:
                with uncollected():
                    out += search(project, ways, found)
                project, ways, found = at, {}, {}
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
            if src is None:
                found[dst] = 0
            else:
                ways.setdefault(src, []).append((dst, line is not None, line or 0))
        out += search(project, ways, found)
        if out:
            yield batch(out)

    edges = edges.select("project", "src", "dst", F.col("line").cast("int").alias("line")).where("project is not null and src is not null and dst is not null")
    seeds = seeds.select("project", "node").where("project is not null and node is not null")
    large = saved(edges.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > most).select("project"))
    some = not large.isEmpty()
    small_edges, small_seeds = (t.join(large, "project", "left_anti") if some else t for t in (edges, seeds))
    told = small_edges.unionByName(small_seeds.select("project", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("int").alias("line")))
    out = told.repartition(tasks(edges.sparkSession), "project").sortWithinPartitions("project").mapInArrow(run, "project string, node string, depth int, pred string")
    if not some:
        return out
    node = lambda c: nodes(["project", c])
    rest = reach(edges.join(large, "project").select(node("src").alias("src"), node("dst").alias("dst"), "line"), seeds.join(large, "project").select(node("node").alias("node")), [F.col("line")])
    return out.unionByName(rest.select(*of_node("node", ["project", "node"]), "depth", F.split("pred", PART, 2)[1].alias("pred")))


def lifted(reached: DataFrame, steps: Steps) -> list[DataFrame]:
    """node and its 2**k-th predecessor, for k = 0, 1, ... as long as there is one."""
    tables = [steps.keep(reached.where("pred is not null").select("node", F.col("pred").alias("up")))]
    while not tables[-1].isEmpty():
        t = tables[-1]
        tables.append(steps.keep(t.join(t.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up"))))
    return tables[:-1]


def paths(reached: DataFrame, targets: DataFrame) -> DataFrame:
    """target, step and at: the way from each target (node) back to its seed, one row for each step, the target's own first.

    Ancestor tables double the way at a time, so there are as many rounds as
    the depth has binary digits, and no row holds a way.
    """
    steps = Steps(reached.sparkSession)
    out = targets.join(reached.select("node"), "node", "left_semi").select(F.col("node").alias("target"), F.lit(0).alias("step"), F.col("node").alias("at"))
    for k, table in reversed(list(enumerate(lifted(reached, steps)))):
        on = out.join(table.withColumnRenamed("node", "at"), "at").select("target", (F.col("step") + 2**k).alias("step"), F.col("up").alias("at"))
        out = steps.keep(out.union(on))
    return steps.last(out)


def along(reached: DataFrame, value: Column) -> DataFrame:
    """node, steps (nodes on its way, itself included) and every: whether ``value`` holds for all of them.

    Each round a row takes over what is known of the one it points to, which
    doubles what it knows: no row holds a way.
    """
    steps = Steps(reached.sparkSession)
    now = steps.keep(reached.select("node", F.col("pred").alias("up"), F.lit(1).alias("steps"), value.alias("every")))
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.col("every").alias("too"))
        now = steps.keep(now.join(above, "up", "left").select("node", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("every") & F.coalesce("too", F.lit(True))).alias("every")))
    return steps.last(now.select("node", "steps", "every"))


def unreachable(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows of ``nodes`` whose node was not reached."""
    return nodes.join(reached.select("node"), "node", "left_anti")


def importers(edges: DataFrame, reached: DataFrame, target: Column) -> DataFrame:
    """Sources of edges into nodes that meet ``target``, and whether they are reached: why a file is not."""
    into = edges.where(target)
    flag = reached.select(F.col("node").alias("src"), F.lit(True).alias("reachable")).distinct()
    return into.join(flag, "src", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
