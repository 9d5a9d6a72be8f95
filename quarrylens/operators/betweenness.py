"""Betweenness of a directed, unweighted graph, by reducing it before shortest paths are counted.

A node with one neighbour is taken off with all that hangs on it: what reaches
the neighbour through it, and what is reached, become weights I and O of the
neighbour, and its own betweenness follows from products of such counts. Of what
is left, nodes with the same neighbours are one class. Shortest paths are counted
between classes only, weighted by I of the source and O of the target; a node
adds what passes between its own branches.

The classes' graph goes to all executors if it has CORE_EDGES edges at most, and
each task counts from its share of the sources by levels in numpy. A larger one
is counted by joins, level by level for blocks of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.graph import admit, both_ways, numbered, union
from quarrylens.operators.lineage import cut, scratch

#: Edges between classes that are sent to all executors at most (4 bytes each, and 28 for each class).
CORE_EDGES = 8_000_000
#: Rows of (source, node) pairs that a block of sources may make by joins.
BLOCK_ROWS = 20_000_000
#: Nodes with one neighbour are taken off while they are this share of those left, in so many rounds at most; what stays is counted like any other node.
WORTH, ROUNDS = 0.02, 40


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, betweenness) of every node, normalised by (n - 1)(n - 2); fewer than three nodes have 0.

    Loops, repeated edges and edges to nodes that are not there do not count.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    with scratch(nodes.sparkSession) as kept:
        live = cut(admit(edges.where("source <> target").select("source", "target"), ids).distinct())
        live, weights, peeled = _peel(live)
        values = _core(live, weights)
        for level in reversed(peeled):
            # a node hangs on one of the core or of any later round
            values = values.unionByName(cut(_hung(level, values)))
        found = cut(values.select("id", "b"))
        kept.append(found)
    scale = float(n - 1) * (n - 2)
    return nodes.select("id").join(found, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) / scale).alias("betweenness"))


def _peel(live: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The edges that are left, (id, i, o, io) of their nodes, and what was taken off, round by round.

    i and o count the nodes that reach the node through its branches, and that it
    reaches there, itself included; io sums the products of both over branches.
    """
    one = F.lit(1).cast("long")
    weights = both_ways(live).select(F.col("source").alias("id")).distinct().select("id", one.alias("i"), one.alias("o"), F.lit(0.0).alias("io"))
    peeled: list[DataFrame] = []
    for _ in range(ROUNDS):
        up, down = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = live.select(F.col("source").alias("u"), F.col("target").alias("v"), up.alias("up"), down.alias("down"))
        ends = ends.unionAll(live.select(F.col("target").alias("u"), F.col("source").alias("v"), down.alias("up"), up.alias("down")))
        near = cut(ends.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.max("up").alias("up"), F.max("down").alias("down")))
        single = near.where("v = w").drop("w")
        # of two that have each other only, the greater one goes
        pair = single.select(F.col("u").alias("v"), F.lit(True).alias("too"))
        single = cut(single.join(pair, "v", "left").where("too IS NULL OR u > v").select("u", "v", "up", "down"))
        taken = single.count()
        if not taken or taken < WORTH * near.count():
            break
        level = cut(single.join(weights.withColumnRenamed("id", "u"), "u"))
        peeled.append(level)
        more = level.groupBy(F.col("v").alias("id")).agg(
            F.sum(F.col("up") * F.col("i")).alias("di"), F.sum(F.col("down") * F.col("o")).alias("do"), F.sum((F.col("up") * F.col("down")).cast("double") * F.col("i") * F.col("o")).alias("dio")
        )
        gone = single.select(F.col("u").alias("id"))
        weights = weights.join(gone, "id", "left_anti").join(more, "id", "left").na.fill(0, ["di", "do"]).na.fill(0.0, ["dio"])
        weights = cut(weights.select("id", (F.col("i") + F.col("di")).alias("i"), (F.col("o") + F.col("do")).alias("o"), (F.col("io") + F.col("dio")).alias("io")))
        live = cut(live.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti"))
    return live, weights, peeled


def _hung(level: DataFrame, values: DataFrame) -> DataFrame:
    """(id, rin, rout, b) of a round's nodes, from those they hang on."""
    up, down = F.col("up"), F.col("down")
    j = level.join(values.select(F.col("id").alias("v"), "rin", "rout"), "v")
    # what comes from beyond the neighbour: not what this node itself adds there
    j = j.withColumn("pin", down * (1 + F.col("rin") - up * F.col("i"))).withColumn("pout", up * (1 + F.col("rout") - down * F.col("o")))
    rin, rout = F.col("i") - 1 + F.col("pin"), F.col("o") - 1 + F.col("pout")
    through = rin.cast("double") * rout - F.col("io") - F.col("pin").cast("double") * F.col("pout")
    return j.select(F.col("u").alias("id"), rin.alias("rin"), rout.alias("rout"), through.alias("b"))


def classes(live: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, c), classes (c, m, i, o, io: counts and sums of members) and edges between them (a, b): nodes with the same neighbours."""

    def side(near: str, of: str) -> DataFrame:
        # two hashes of a set of neighbours and its size
        return live.groupBy(F.col(of).alias("id")).agg(*[F.bit_xor(F.xxhash64(near, F.lit(k))).alias(f"{of}{k}") for k in (1, 2)], F.count("*").alias(f"{of}n"))

    key = ["source1", "source2", "sourcen", "target1", "target2", "targetn"]
    signed = cut(weights.join(side("target", "source"), "id", "left").join(side("source", "target"), "id", "left").na.fill(0, key))
    grouped = signed.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("m"), F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum(F.col("i").cast("double") * F.col("o")).alias("io"))
    of = cut(numbered(grouped, "c", "first"))
    members = cut(signed.select("id", "i", "o", "io", *key).join(of.select("c", *key), key).select("id", "c", "i", "o", "io"))
    # all members have the first one's neighbours
    first = of.select(F.col("first").alias("source"), F.col("c").alias("a"))
    between = live.join(first, "source").join(members.select(F.col("id").alias("target"), F.col("c").alias("b")), "target").select("a", "b").distinct()
    return members, of.select("c", "m", "i", "o", "io"), cut(between)


def _core(live: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, rin, rout, b) of the nodes that were not taken off: nodes that reach it and that it reaches, and the pairs that pass."""
    members, of, between = classes(live, weights)
    found = _counted(of, between) if between.count() <= CORE_EDGES else _joined(of, between)
    j = members.join(of.select("c", F.col("i").alias("ci"), F.col("o").alias("co")), "c").join(found, "c", "left").na.fill(0, ["rin", "rout", "back"]).na.fill(0.0, ["x"])
    # the others of its class reach it if the class comes back to itself
    cin, cout = F.col("rin") + F.col("back") * (F.col("ci") - F.col("i")), F.col("rout") + F.col("back") * (F.col("co") - F.col("o"))
    fin, fout = (F.col("i") - 1).cast("double"), (F.col("o") - 1).cast("double")
    b = F.col("x") + fin * fout - F.col("io") + fin * cout + cin * fout
    return cut(j.select("id", (cin + F.col("i") - 1).alias("rin"), (cout + F.col("o") - 1).alias("rout"), b.alias("b")))


FOUND = "c bigint, rin bigint, rout bigint, back bigint, x double"


class Core:
    """The classes' graph in arrays, and what the shortest paths from one class add to the others."""

    def __init__(self, of: pa.Table, between: pa.Table):
        order = np.argsort(of["c"].to_numpy())
        self.m, self.i, self.o, self.io = (of[x].to_numpy()[order].astype(float) for x in ("m", "i", "o", "io"))
        self.k = len(order)
        a, b = between["a"].to_numpy(), between["b"].to_numpy()
        by = np.argsort(a, kind="stable")
        self.to = b[by].astype(np.int32)
        self.at = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=self.k)))).astype(np.int64)
        self.x, self.rin, self.rout, self.back = np.zeros(self.k), np.zeros(self.k), np.zeros(self.k), np.zeros(self.k)

    def source(self, s: int) -> None:
        seen = np.zeros(self.k, bool)
        paths = np.zeros(self.k)
        seen[s], paths[s] = True, 1.0
        front, steps, home = np.array([s]), [], None
        while True:
            lo, deg = self.at[front], self.at[front + 1] - self.at[front]
            a = np.repeat(front, deg)
            b = self.to[np.arange(len(a)) + np.repeat(lo - (np.cumsum(deg) - deg), deg)]
            if home is None and self.m[s] > 1 and (b == s).any():
                home = len(steps), a[b == s]  # the other members of the class
            new = ~seen[b]
            a, b = a[new], b[new]
            if not len(a):
                break
            np.add.at(paths, b, paths[a] * np.where(a == s, 1.0, self.m[a]))
            front = np.unique(b)
            seen[front] = True
            steps.append((a, b))
        share = np.zeros(self.k)
        for d in range(max(len(steps), home[0] + 1 if home else 0) - 1, -1, -1):
            if d < len(steps):
                a, b = steps[d]
                np.add.at(share, a, paths[a] / paths[b] * (self.o[b] + self.m[b] * share[b]))
            if home and home[0] == d:
                a = home[1]
                others = (self.i[s] * self.o[s] - self.io[s]) / self.i[s]
                total = (paths[a] * np.where(a == s, 1.0, self.m[a])).sum()
                np.add.at(share, a, paths[a] / total * others)
        seen[s] = False
        self.x[seen] += self.i[s] * share[seen]
        self.rin[seen] += self.i[s]
        self.rout[s] += self.o[seen].sum()
        self.back[s] += home is not None


def _counted(of: DataFrame, between: DataFrame) -> DataFrame:
    """x, rin, rout and back of each class, by tasks that hold the classes' graph."""
    spark = of.sparkSession
    k = of.count()
    shared = spark.sparkContext.broadcast((of.toArrow(), between.toArrow()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        core = None
        for batch in batches:
            core = core or Core(*shared.value)
            for s in batch.column(0).to_pylist():
                core.source(s)
        if core is not None:
            c = np.flatnonzero((core.rin > 0) | (core.rout > 0) | (core.back > 0))
            whole = [x[c].astype(np.int64) for x in (core.rin, core.rout, core.back)]
            yield pa.RecordBatch.from_arrays([pa.array(c), *map(pa.array, whole), pa.array(core.x[c])], names=["c", "rin", "rout", "back", "x"])

    tasks = max(1, min(k // 32 + 1, 4 * spark.sparkContext.defaultParallelism))
    parts = spark.range(k).repartition(tasks).mapInArrow(run, FOUND)
    return cut(parts.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("rin", "rout", "back", "x")]))


def _joined(of: DataFrame, between: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The same by joins: levels of (s, v, w: paths) for blocks of sources, then the shares from the last level back."""
    k = of.count()
    blocks = -(-k * k // (block_rows or BLOCK_ROWS))
    many = of.select("c", "m", "o", ((F.col("i") * F.col("o") - F.col("io")) / F.col("i")).alias("others"), "i")
    step = between.join(many.select(F.col("c").alias("a"), F.col("m").alias("ma")), "a")
    parts: list[DataFrame] = []
    for block in range(blocks):
        sources = of.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == block)
        # the source stands for itself alone; its class is found again, if at all, as its other members
        levels = [cut(sources.select(F.col("c").alias("s"), F.col("c").alias("v"), F.lit(1.0).alias("w")))]
        known = of.where("m = 1").select(F.col("c").alias("s"), F.col("c").alias("v"))
        while True:
            paths = F.sum(F.col("w") * F.when((F.col("v") == F.col("s")), 1.0).otherwise(F.col("ma")))
            new = levels[-1].join(step, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(paths.alias("w"))
            new = cut(new.join(known, ["s", "v"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
            known = known.unionByName(new.select("s", "v"))
        weights = many.select(F.col("c").alias("v"), "m", "o", "others")
        after = None
        for d in range(len(levels) - 1, 0, -1):
            level = levels[d]
            if after is not None:
                back = after.join(between, F.col("v") == F.col("b")).select("s", F.col("a").alias("v"), "y").groupBy("s", "v").agg(F.sum("y").alias("y"))
                level = level.join(back, ["s", "v"], "left")
            else:
                level = level.withColumn("y", F.lit(0.0))
            mine = F.col("v") == F.col("s")
            level = level.join(weights, "v").withColumn("x", F.when(mine, 0.0).otherwise(F.coalesce(F.col("w") * F.col("y"), F.lit(0.0))))
            # y: what each path to the node carries on to those before it
            y = F.when(mine, F.col("others")).otherwise(F.col("o") + F.col("m") * F.col("x")) / F.col("w")
            after = cut(level.select("s", "v", "w", "o", "x", y.alias("y")))
            si = many.select(F.col("c").alias("s"), F.col("i").alias("si"))
            far = after.where("s <> v").join(si, "s")
            parts.append(far.groupBy(F.col("v").alias("c")).agg(F.sum("si").alias("rin"), F.sum(F.col("si") * F.col("x")).alias("x")))
            parts.append(far.groupBy(F.col("s").alias("c")).agg(F.sum("o").alias("rout")))
            parts.append(after.where("s = v").select(F.col("s").alias("c"), F.lit(1).cast("long").alias("back")))
    if not parts:
        return of.sparkSession.createDataFrame([], FOUND)
    return cut(union(*parts).groupBy("c").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("rin", "rout", "back")], F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")))

