"""A typed property graph as two tables, and what is computed on it.

``nodes`` has id, kind and label, ``edges`` kind, source, target and via. Every
function takes and returns DataFrames; loops write each round down.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut, drop, scratch

# Kinds of edges that carry a flow, and kinds of nodes that belong to one. What contains what is shape, not flow.
TRAVERSED = ("CALLS", "READS", "WRITES", "QUERIES", "INVOKES", "DEPENDS_ON", "ENTRY_TO", "TRIGGERS", "OBSERVES")
IN_FLOW = ("PROCEDURE", "TABLE", "VIEW", "DBPROC", "SQL", "ENTRY", "COMPONENT", "FLOW")
GIANT_SHARE, HUB_RATIO = 0.5, 0.6


class NotSettled(RuntimeError):
    """A method did not come to an end within its rounds."""


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def admit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select(F.col("id").alias("_end"))
    return edges.join(ids, F.col("source") == F.col("_end"), "left_semi").join(ids, F.col("target") == F.col("_end"), "left_semi")


def merge_call_sites(sites: DataFrame) -> DataFrame:
    """One edge for each (kind, source, target) of (kind, source, target, site); via has the distinct sites in order."""
    merged = sites.groupBy("kind", "source", "target").agg(F.array_sort(F.collect_set("site")).alias("sites"))
    return merged.select("kind", "source", "target", F.array_join(F.transform("sites", lambda x: x.cast("string")), ",").alias("via"), F.size("sites").cast("long").alias("call_sites"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over as many tasks as the session shuffles to, not fewer for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incident edges (a loop counts once) and distinct neighbours of every node."""
    # one pass over the edges; a loop stands twice among its node's pairs
    pairs = both_ways(edges).groupBy("source", "target").agg(F.count("*").alias("n"))
    mine = F.when(F.col("source") == F.col("target"), F.expr("n DIV 2")).otherwise(F.col("n"))
    ends = pairs.groupBy(F.col("source").alias("id")).agg(F.sum(mine).alias("degree"), F.count("*").alias("neighbours"))
    return nodes.select("id").join(ends, "id", "left").na.fill(0, ["degree", "neighbours"])


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out) / (n - 1) on the simple graph, 0 for a graph of one node."""
    # dealt first, by a number of tasks that stays: no task holds pairs before they are dealt, and each gets an equal share
    simple = spread(edges.select("source", "target"), "source", "target").distinct()
    ends = simple.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    n = nodes.agg(F.count("*").alias("n"))
    full = nodes.select("id", "kind", "label").join(ends, "id", "left").na.fill(0, ["links"]).crossJoin(F.broadcast(n))
    return full.select("id", "kind", "label", "links", F.when(F.col("n") > 1, F.col("links") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def hubs(central: DataFrame, kinds: list[str], betweenness: DataFrame | None = None) -> DataFrame:
    """Nodes of the given kinds with more than one link and at least HUB_RATIO of the highest centrality, ranked and numbered.

    Equal centrality is told apart by betweenness (id, betweenness) to 12 digits, then by id.
    """
    some = central.where(F.col("kind").isin(*kinds))
    peak = some.agg(F.max("centrality").alias("peak"))
    some = some.crossJoin(F.broadcast(peak)).where((F.col("links") > 1) & (F.col("centrality") >= F.col("peak") * HUB_RATIO))
    some = some.join(betweenness, "id", "left").na.fill(0.0, ["betweenness"]) if betweenness is not None else some.withColumn("betweenness", F.lit(0.0))
    placed = numbered(some, "_rank", F.col("centrality").desc(), F.round("betweenness", 12).desc(), "id")
    name = F.concat(F.lit("HUB-"), F.upper("label"), F.format_string("-%02d", "_rank"))
    return placed.withColumns({"rank": F.col("_rank") + 1, "hub_id": name}).select("hub_id", "id", "label", "links", "centrality", "betweenness", "rank")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 0 in the given total order: sorted by ranges in parallel, the ranges' offsets from their counts."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = placed.withColumn("_of", part).join(counts.select(F.col("_part").alias("_of"), before.alias("_before")), "_of")
    return both.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_of", "_at", "_before")


def flow_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that a slice follows: of a kind that carries a flow, to a node that belongs to one."""
    ends = nodes.where(F.col("kind").isin(*IN_FLOW)).select(F.col("id").alias("_end"))
    return edges.where(F.col("kind").isin(*TRAVERSED)).join(ends, F.col("target") == F.col("_end"), "left_semi")


def reach(edges: DataFrame, start: DataFrame, depth: int, within: DataFrame | None = None) -> DataFrame:
    """(id, distance): all nodes within ``depth`` steps of the nodes in ``start`` (id), by frontiers; with ``within`` (id) only over these nodes."""
    if depth < 1:
        raise ValueError("depth starts at 1")
    front = start.select("id").distinct()
    known = cut(front.withColumn("distance", F.lit(0).cast("long")))
    for step in range(1, depth + 1):
        # the frontier is what was new last; Spark broadcasts it when its written size allows
        front = known.where(F.col("distance") == step - 1).select(F.col("id").alias("_at"))
        new = edges.select("source", "target").join(front, F.col("source") == F.col("_at")).select(F.col("target").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        if within is not None:
            # the new ones are few, so they are looked up rather than all edges filtered
            new = within.select("id").join(new, "id", "left_semi")
        new = cut(new.withColumn("distance", F.lit(step).cast("long")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    return admit(edges, reached)


def truncated(reached: DataFrame, depth: int) -> DataFrame:
    """One row: nodes, greatest distance, and whether some node lies at the bound."""
    return reached.agg(F.count("*").alias("n_nodes"), F.max("distance").alias("max_distance"), F.coalesce(F.max("distance") == depth, F.lit(False)).alias("truncated"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all ends of (src, dst), root the least node reachable.

    Every node first hangs on its least neighbour; the trees that come of this
    are resolved, the edges are renamed to their roots, and only what joins two
    trees is resolved again: each edge is joined twice, whatever the rounds.
    Joins are told to sort: names take few bytes where they are written, and would be broadcast for it.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    least = both_ways(e.select(F.col("u").alias("source"), F.col("v").alias("target"))).groupBy(F.col("source").alias("u")).agg(F.min("target").alias("v"))
    least = cut(least)
    trees = cut(_stars(least.where("v < u")))
    of = lambda end: trees.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")).hint("merge")
    ends = e.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
    rest = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    over = _stars(rest).select(F.col("node").alias("tree"), F.col("root").alias("over"))
    nodes = least.select(F.col("u").alias("node")).join(trees.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("tree"))
    return nodes.join(over.hint("merge"), "tree", "left").select("node", F.coalesce("over", "tree").alias("root"))


def _stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all ends of (u, v), v < u, by rounds of large-star and small-star."""
    seen = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def cluster_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Of clusters (node, root): idx by size and least member, size, share, cohesion, and the one giant if there is just one."""
    total = members.agg(F.count("*").alias("total"))
    size = members.groupBy("root").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    a, b = members.select(F.col("node").alias("source"), F.col("root").alias("ra")), members.select(F.col("node").alias("target"), F.col("root").alias("rb"))
    inner = edges.select("source", "target").distinct().join(a, "source").join(b, "target").where("ra = rb").groupBy(F.col("ra").alias("root")).agg(F.count("*").alias("inner_edges"))
    out = size.join(inner, "root", "left").na.fill(0, ["inner_edges"]).crossJoin(F.broadcast(total))
    out = out.withColumn("share", F.col("size") / F.col("total"))
    out = out.withColumn("cohesion", F.when(F.col("size") > 1, F.col("inner_edges") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0))
    # shares over one half can belong to one cluster at most
    return numbered(out, "idx", F.col("size").desc(), "first").select("root", "idx", "size", "share", "cohesion", (F.col("share") > GIANT_SHARE).alias("is_giant"))


def cluster_labels(members: DataFrame, degrees: DataFrame, most: int = 3) -> DataFrame:
    """The names of the ``most`` best linked members of each cluster (node, root), from degrees (node, degree, label)."""
    order = Window.partitionBy("root").orderBy(F.col("degree").desc(), "label")
    top = members.join(degrees, "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return top.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("n", "label"))).alias("x")).select("root", F.array_join(F.col("x.label"), ", ").alias("label"))


def propagate_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after synchronous rounds: each node takes the commonest label around it, the least of equals."""
    pairs = cut(both_ways(edges).where("source <> target").distinct())
    labels = pairs.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = pairs.join(labels, F.col("target") == F.col("node")).groupBy("source", "label").agg(F.count("*").alias("n"))
        labels = cut(keep_first(votes, ["source"], F.col("n").desc(), "label").select(F.col("source").alias("node"), "label"))
    return labels


def louvain(edges: DataFrame, sweeps: int = 16, levels: int = 20) -> DataFrame:
    """(node, root) by modularity of the undirected simple graph: nodes move, then communities become nodes, until nothing is gained.

    Modularity of a large graph joins small communities whatever lies between them
    (its resolution limit), so each community is then taken as a graph of its own,
    of what the first level found in it, and is split where that tells enough of its edges (``_splits``), until none is.
    At the end communities that do not hang together are split, which costs no
    modularity, so that each is connected. Reruns agree. NotSettled if something is
    still gained after ``levels``.
    """
    with scratch(edges.sparkSession) as kept:
        simple = cut(both_ways(edges.where("source <> target")).distinct().withColumn("w", F.lit(1).cast("long")))
        total = simple.agg(F.sum("w")).first()[0]
        if not total:
            out = cut(simple.select(F.col("source").alias("node"), F.col("source").alias("root")))
            kept.append(out)
            return out
        members, base = _climb(simple.withColumn("total", F.lit(total)), sweeps, levels)
        # splits are made of what single nodes came to by themselves, which the limit does not reach: these are the nodes now
        small = cut(_merged(simple, base, F.sum("w").alias("w")))
        left = base.join(members, "node").groupBy(F.col("base").alias("node")).agg(F.first("root").alias("root"), F.count("*").alias("size"))
        left = placed = cut(left)
        while True:
            inner = cut(_inside(small, left))
            if inner.isEmpty():
                break
            finer = _climb(inner.select("source", "target", "w", "total"), sweeps, levels)[0]
            split = _splits(inner, left, finer)
            left = cut(left.join(split, "root", "left_semi").drop("root").join(finer, "node"))
            if left.isEmpty():
                break
            placed = cut(placed.join(left.select("node", F.col("root").alias("piece")), "node", "left").select("node", F.coalesce("piece", "root").alias("root")))
        members = base.join(placed.select(F.col("node").alias("base"), "root"), "base").select("node", "root")
        out = cut(refine(members, edges))
        kept.append(out)
    return out


def _merged(pairs: DataFrame, at: DataFrame, *sums: Column) -> DataFrame:
    """(source, target) and sums over pairs, of communities (node, base) instead of nodes."""
    a, b = (at.select(F.col("node").alias(end), F.col("base").alias(f"r{end}")) for end in ("source", "target"))
    return pairs.join(a, "source").join(b, "target").groupBy(F.col("rsource").alias("source"), F.col("rtarget").alias("target")).agg(*sums)


def _inside(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(root, source, target, w, total, n) of pairs inside of communities (node, root, size): total is the weight of a community's pairs, n its size.

    Of m edges no split tells more than m * ln(1 / density), and it costs n * ln(2) at
    least: communities that fall short of it, such as cliques, are left out.
    """
    a, b = (members.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("source", "target"))
    inner = pairs.join(a, "source").join(b, "target").where("rsource = rtarget").select(F.col("rsource").alias("root"), "source", "target", "w")
    size = inner.groupBy("root").agg(F.sum("w").alias("total")).join(members.groupBy("root").agg(F.sum("size").alias("n"), F.count("*").alias("parts")), "root")
    return inner.join(size.where("parts > 1 AND total / 2 * ln(n * (n - 1) / total) > n * ln(2)").drop("parts"), "root")


def _splits(inner: DataFrame, members: DataFrame, finer: DataFrame) -> DataFrame:
    """(root) of the communities of ``_inside`` whose edges are told shorter by their pieces (node, root).

    With a share q of m edges inside of pieces, that have a share p of the pairs of n
    nodes, the k pieces tell m * (q ln(q / p) + (1 - q) ln((1 - q) / (1 - p))), the
    surprise, and naming each node's piece costs n * ln(k). Trees are never split.
    """
    a, b = (finer.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("source", "target"))
    pieces = members.join(finer.select("node", F.col("root").alias("piece")), "node").groupBy("root", "piece").agg(F.sum("size").alias("size"))
    per = pieces.groupBy("root").agg(F.count("*").alias("k"), F.sum(F.col("size") * (F.col("size") - 1)).alias("near"), F.sum("size").alias("n"))
    within = inner.join(a, "source").join(b, "target").groupBy("root").agg(F.sum(F.when(F.col("rsource") == F.col("rtarget"), F.col("w")).otherwise(0)).alias("within"), F.max("total").alias("total"))
    told = per.join(within, "root").where("k > 1").select("root", "k", "n", "total", (F.col("within") / F.col("total")).alias("q"), F.expr("near / (n * (n - 1))").alias("p")).where("q > p")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    q, p = F.col("q"), F.col("p")
    return told.where(F.col("total") / 2 * (part(q, p) + part(1 - q, 1 - p)) > F.col("n") * F.log("k")).select("root")


def _climb(pairs: DataFrame, sweeps: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(node, root), and (node, base) as the first level left it, by modularity of weighted (source, target, w, total), given both ways, of one graph or of several without pairs between them.

    All nodes of a sweep see the same communities. Half of them, by a hash that
    changes with the sweep, move to where they gain most, so that neighbours do
    not swap for ever; the best state of a level is kept.
    """
    with scratch(pairs.sparkSession) as kept:
        members = cut(pairs.select(F.col("source").alias("node")).distinct().withColumn("root", F.col("node")))
        base = members
        for level in range(levels):
            own_w = F.when(F.col("source") == F.col("target"), F.col("w")).otherwise(0)
            degree = cut(pairs.groupBy("source").agg(F.sum("w").alias("k"), F.sum(own_w).alias("loop"), F.max("total").alias("total")))
            at = degree.select(F.col("source").alias("node"), F.col("source").alias("root"))
            best = found = None
            idle = 0
            # what tells where to go tells how good it is here: pairs are shuffled to the ends that are told, and back, once for each sweep
            for sweep in range(sweeps + 1):
                mine = degree.join(at.select(F.col("node").alias("source"), F.col("root").alias("own")).hint("shuffle_hash"), "source")
                mine = mine.join(mine.groupBy("own").agg(F.sum("k").alias("tot")).hint("shuffle_hash"), "own")
                of = mine.select(F.col("source").alias("target"), F.col("own").alias("root"), "tot")
                near = pairs.where("source <> target").join(of.hint("shuffle_hash"), "target").select("source", "root", "tot", "w")
                near = near.unionAll(mine.select("source", "own", "tot", F.lit(0).cast("long"))).repartition("source")
                near = near.groupBy("source", "root").agg(F.max("tot").alias("tot"), F.sum("w").alias("w"))
                away = F.col("root") != F.col("own")
                loss = F.col("w") * -1.0 + F.col("k") * (F.col("tot") - F.when(away, 0).otherwise(F.col("k"))) / F.col("total")
                pick = near.join(mine.select("source", "own", "k", "loop", "total").hint("shuffle_hash"), "source").groupBy("source").agg(
                    F.min(F.struct(loss.alias("loss"), away.alias("away"), "root")).alias("to"), F.min("own").alias("own"), F.max("k").alias("k"), F.max("total").alias("total"),
                    (F.max(F.when(away, 0).otherwise(F.col("w"))) + F.max("loop")).alias("inner"),
                )
                turn = F.pmod(F.xxhash64("source", F.lit(level * sweeps + sweep)), F.lit(2)) == 0
                state = cut(pick.select(F.col("source").alias("node"), "own", "k", "total", "inner", F.when(turn, F.col("to.root")).otherwise(F.col("own")).alias("root")))
                per = state.groupBy("own").agg(F.sum("k").alias("tot"), F.sum("inner").alias("inner"), F.max("total").alias("total"))
                q = per.agg(F.sum(F.col("inner") / F.col("total") - (F.col("tot") / F.col("total")) ** 2)).first()[0]
                if best is None:
                    best = q
                elif q > best + 1e-9:
                    best, found, idle = q, at, 0
                else:
                    idle += 1
                    if idle == 3:
                        break
                at = state.select("node", "root")
            if found is None:
                break
            over = found.select(F.col("node").alias("root"), F.col("root").alias("over"))
            members = cut(members.join(over, "root").select("node", F.col("over").alias("root")))
            base = members if level == 0 else base
            pairs = cut(_merged(pairs, found.withColumnRenamed("root", "base"), F.sum("w").alias("w"), F.max("total").alias("total")))
        else:
            raise NotSettled(f"modularity still grows after {levels} levels")
        kept += [members, base]
    return members, base.select("node", F.col("root").alias("base"))


def refine(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): clusters (node, root) split into pieces that edges inside of them connect; the root is a piece's least node."""
    a, b = (members.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("source", "target"))
    inner = edges.select("source", "target").join(a, "source").join(b, "target").where("rsource = rtarget AND source <> target")
    pieces = connected(inner.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return members.select("node").join(pieces, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def colouring(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, colour) of symmetric pairs (source, target): neighbours differ, colours start at 0.

    In each round the nodes whose hash is the greatest among their neighbours
    without a colour take the least colour that no neighbour has.
    """
    with scratch(pairs.sparkSession) as kept:
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        nodes = pairs.select(F.col("source").alias("node")).distinct()
        done = nodes.select("node", F.lit(None).cast("int").alias("colour"))
        for _ in range(rounds):
            of = done.select(F.col("node").alias("target"), F.col("colour").alias("near"))
            around = pairs.join(of.hint("shuffle_hash"), "target").groupBy(F.col("source").alias("node")).agg(
                F.max(F.when(F.col("near").isNull(), rank("target"))).alias("best"), F.collect_set("near").alias("taken")
            )
            least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"))
            new = done.join(around.hint("shuffle_hash"), "node").select("node", F.coalesce("colour", F.when(F.col("best").isNull() | (rank("node") > F.col("best")), least)).alias("colour"))
            done = cut(new)
            if done.where("colour IS NULL").isEmpty():
                break
        else:
            raise NotSettled(f"no colouring after {rounds} rounds")
        kept.append(done)
    return done


#: Pairs of a component that is settled inside of one task, and of those that one is given at once, about.
IN_TASK, PER_TASK = 100_000, 500_000


def _colour_here(source: np.ndarray, target: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """colouring() in numpy: of nodes by number, pairs given both ways and in order, every node having one."""
    colour = np.full(len(rank), -1)
    start = np.searchsorted(source, np.arange(len(rank)))
    while (colour < 0).any():
        best = np.maximum.reduceat(np.where(colour[target] < 0, rank[target], -1), start)
        turn = (colour < 0) & (rank > best)
        mine = turn[source] & (colour[target] >= 0)
        # the least number that is missing: each node's distinct colours in order, up to the first that is not its place
        s, c = np.divmod(np.unique(source[mine] * len(rank) + colour[target[mine]]), len(rank))
        place = np.arange(len(s)) - np.searchsorted(s, s)
        colour[turn] = np.bincount(s[place == c], minlength=len(rank))[turn]
    return colour


def _settle_here(source: np.ndarray, target: np.ndarray, rank: np.ndarray, sweeps: int) -> np.ndarray | None:
    """The labels of settle_labels(), as numbers, or None if they still move."""
    colour, label, n = _colour_here(source, target, rank), np.arange(len(rank)), len(rank)
    of = [(source[m], target[m]) for c in range(colour.max() + 1) for m in [colour[source] == c]]
    still = 0
    for sweep in range(sweeps * len(of)):
        s, t = of[sweep % len(of)]
        key, votes = np.unique(s * n + label[t], return_counts=True)
        s, told = np.divmod(key, n)
        # the most votes, then the own label, then the least
        order = np.lexsort((told, told != label[s], -votes, s))
        s, told = s[order], told[order]
        first = np.flatnonzero(np.diff(s, prepend=-1))
        moves = told[first] != label[s[first]]
        label[s[first]] = told[first]
        still = 0 if moves.any() else still + 1
        if still >= len(of):
            return label
    return None


def _settle_small(pairs: DataFrame, sweeps: int) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the components of at most IN_TASK pairs, each settled inside of a task with others, and the pairs of larger ones."""
    kind = pairs.schema["source"].dataType.simpleString()
    roots = connected(pairs.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    placed = cut(pairs.join(roots.select(F.col("node").alias("source"), "root").hint("shuffle_hash"), "source"))
    size = cut(placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= IN_TASK))
    total = size.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / PER_TASK))
    small = placed.join(size.select("root").hint("shuffle_hash"), "root", "left_semi")
    small = small.select(F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("part"), "source", "target", F.xxhash64("source").alias("hash"))

    def settle(part: pa.Table) -> pa.Table:
        names, source = np.unique(part["source"].to_numpy(), return_inverse=True)
        target = np.searchsorted(names, part["target"].to_numpy())
        order = np.lexsort((target, source))
        hashes = np.empty(len(names), np.int64)
        hashes[source] = part["hash"].to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((np.arange(len(names)), hashes))] = np.arange(len(names))
        label = _settle_here(source[order], target[order], rank, sweeps)
        given = pa.nulls(len(names), part["source"].type) if label is None else pa.array(names[label], part["source"].type)
        return pa.table({"node": pa.array(names, part["source"].type), "label": given})

    labels = cut(small.groupBy("part").applyInArrow(settle, f"node {kind}, label {kind}"))
    if not labels.where("label IS NULL").isEmpty():
        raise NotSettled(f"labels still move after {sweeps} sweeps")
    return labels, placed.join(size.select("root").hint("shuffle_hash"), "root", "left_anti").select("source", "target")


def settle_labels(edges: DataFrame, sweeps: int = 60) -> DataFrame:
    """(node, label) by asynchronous label propagation: at the end every node's label is among the commonest around it.

    Nodes of one colour have no edges between them and move together, one colour
    after another. A node moves only to a label that more neighbours have than its
    own, the least of these, so each move adds edges within labels and the sweeps
    end, on bipartite graphs too. NotSettled after ``sweeps``. What a component
    comes to depends on nothing outside of it: small ones are settled in tasks, by
    the same rules, and sweeps are made over the rest.
    """
    with scratch(edges.sparkSession) as kept:
        all_ = cut(both_ways(edges).where("source <> target").distinct())
        settled, large = _settle_small(all_, sweeps)
        if large.isEmpty():
            out = settled
        else:
            pairs = cut(large)
            colour = colouring(pairs)
            classes = [r.colour for r in colour.select("colour").distinct().orderBy("colour").collect()]
            labels = cut(colour.select("node", "colour", F.col("node").alias("label")))
            still = 0
            for sweep in range(sweeps * max(1, len(classes))):
                c = classes[sweep % len(classes)] if classes else 0
                mine = labels.where(F.col("colour") == c)
                # shuffled, not broadcast: a broadcast goes through the driver, and there are many sweeps
                own = mine.select(F.col("node").alias("source"), F.col("label").alias("own"))
                told = pairs.join(own.hint("shuffle_hash"), "source").join(labels.select(F.col("node").alias("target"), "label").hint("shuffle_hash"), "target")
                votes = told.groupBy("source", "own", "label").agg(F.count("*").alias("n"))
                # the most votes, then the own label, then the least
                best = votes.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("label") != F.col("own")).alias("moves"), "label")).alias("x"))
                moved = cut(best.where("x.moves").select(F.col("source").alias("node"), F.col("x.label").alias("to")))
                if moved.isEmpty():
                    still += 1
                    if still >= len(classes):
                        break
                    continue
                still = 0
                old = labels
                labels = cut(labels.join(moved.hint("shuffle_hash"), "node", "left").select("node", "colour", F.coalesce("to", "label").alias("label")))
                drop(old)
            else:
                if classes:
                    raise NotSettled(f"labels still move after {sweeps} sweeps")
            out = cut(labels.select("node", "label").unionByName(settled))
        kept.append(out)
    return out


#: Methods in the order in which they are tried, and the name that is reported of each.
CHAIN = ("louvain", "label_propagation", "components")


def communities(nodes: DataFrame, edges: DataFrame, method: str = "components", **options) -> tuple[DataFrame, str]:
    """(node, root) and the method that was used; fewer than three nodes are one cluster, none are "none".

    With method "auto" modularity is tried first, then label propagation, then
    components: the next one if the one before does not settle. ``options`` go to
    the first method. Clusters are connected whatever the method.
    """
    if method != "auto" and method not in CHAIN:
        raise ValueError(f"no such method: {method}")
    few = nodes.limit(3).count()
    if few < 3:
        return nodes.select(F.col("id").alias("node"), F.min("id").over(Window.partitionBy(F.lit(0))).alias("root")), "singleton" if few else "none"
    chain = CHAIN if method == "auto" else (method,)
    for at, name in enumerate(chain):
        more = options if at == 0 else {}
        try:
            if name == "louvain":
                found = louvain(edges, **more)
            elif name == "label_propagation":
                labelled = settle_labels(edges, **more).withColumnRenamed("label", "root")
                found = refine(labelled, edges)
            else:
                found = connected(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
            method = name
            break
        except NotSettled:
            if name == chain[-1]:
                raise
    rest = nodes.select(F.col("id").alias("node")).join(found, "node", "left")
    return rest.select("node", F.coalesce("root", "node").alias("root")), method


def contained(members: DataFrame, reached: DataFrame) -> DataFrame:
    """The clusters (node, root) of which every member is in a slice (id)."""
    out = members.join(reached.select(F.col("id").alias("node")), "node", "left_anti").select("root").distinct()
    return members.select("root").distinct().join(out, "root", "left_anti")


def with_clusters(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with the root of their cluster as cluster_id, null for those outside of all."""
    return nodes.join(members.select(F.col("node").alias("id"), F.col("root").alias("cluster_id")), "id", "left")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
