"""Communities: by modularity, by labels, and the chain of methods."""

import random
from itertools import combinations

import pytest

from quarrylens.operators import graph as g


def cliques(n, size):
    """A ring of cliques, joined by one edge each."""
    out = [(f"{c:02}{a}", f"{c:02}{b}") for c in range(n) for a, b in combinations(range(size), 2)]
    return out + [(f"{c:02}0", f"{(c + 1) % n:02}1") for c in range(n)]


def groups(members):
    got = {}
    for r in members.collect():
        got.setdefault(r.root, set()).add(r.node)
    return sorted(map(sorted, got.values()))


RING = cliques(5, 5)
NAMES = [(x,) for x in sorted({x for r in RING for x in r})] + [("lone",)]
WANT = sorted([[f"{c:02}{a}" for a in range(5)] for c in range(5)] + [["lone"]])


def test_ring_of_cliques(spark):
    # the other way round, repeated and loops: the graph is simple
    edges = spark.createDataFrame(RING + [(b, a) for a, b in RING[:7]] + RING[:3] + [("000", "000")], "source string, target string")
    nodes = spark.createDataFrame(NAMES, "id string")
    members, used = g.communities(nodes, edges, "auto")
    assert used == "louvain" and groups(members) == WANT


def test_no_clique_is_lost_in_a_large_graph(spark):
    # of 60 cliques in a ring plain modularity joins neighbours; a tree is not taken apart for it
    chain = [(f"t{i}", f"t{i + 1}") for i in range(9)]
    edges = spark.createDataFrame(cliques(60, 5) + chain, "source string, target string")
    members = g.louvain(edges)
    assert [x for x in groups(members) if x[0][0] != "t"] == [[f"{c:02}{a}" for a in range(5)] for c in range(60)]
    assert max(len(x) for x in groups(members) if x[0][0] == "t") > 4


def test_methods_fall_through(spark):
    edges, nodes = spark.createDataFrame(RING, "source string, target string"), spark.createDataFrame(NAMES, "id string")
    members, used = g.communities(nodes, edges, "auto", levels=1)
    assert used == "label_propagation"
    for group in groups(members):
        assert len(group) == 1 or g.connected(edges.where(g.F.col("source").isin(group) & g.F.col("target").isin(group)).select(g.F.col("source").alias("src"), g.F.col("target").alias("dst"))).select("root").distinct().count() == 1
    with pytest.raises(g.NotSettled):
        g.communities(nodes, edges, "louvain", levels=1)
    with pytest.raises(ValueError):
        g.communities(nodes, edges, "guess")
    assert g.communities(nodes.limit(0), edges)[1] == "none" and g.communities(nodes.limit(2), edges)[1] == "singleton"


def test_no_edges(spark):
    edges = spark.createDataFrame([("a", "a")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    for method in ("auto", "label_propagation", "components"):
        assert {(r.node, r.root) for r in g.communities(nodes, edges, method)[0].collect()} == {("a", "a"), ("b", "b"), ("c", "c")}


def test_communities_are_split_into_connected_pieces(spark):
    members = spark.createDataFrame([(i, i // 4 * 4) for i in range(12)], "node long, root long")
    edges = spark.createDataFrame([(0, 1), (2, 3), (3, 2), (1, 5), (4, 5), (5, 6), (6, 7), (8, 8)], "source long, target long")
    assert groups(g.refine(members, edges)) == [[0, 1], [2, 3], [4, 5, 6, 7], [8], [9], [10], [11]]


@pytest.mark.parametrize("kind", ["bipartite", "random", "star"])
def test_labels_settle(spark, kind):
    rnd = random.Random(3)
    if kind == "bipartite":  # synchronous rounds would swap the sides' labels for ever
        rows = [(a, 100 + b) for a in range(8) for b in range(8)]
    elif kind == "star":
        rows = [(0, i) for i in range(1, 60)] + [(200, 201)]
    else:
        rows = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(150)]
    edges = spark.createDataFrame(rows + rows[:5], "source long, target long")
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    pairs = g.both_ways(edges).where("source <> target").distinct()
    colour = {r.node: r.colour for r in g.colouring(pairs).collect()}
    assert colour.keys() == near.keys() and all(colour[a] != colour[b] for a in near for b in near[a])
    assert max(colour.values()) <= max(map(len, near.values()))
    label = {r.node: r.label for r in g.settle_labels(edges).collect()}
    assert label.keys() == near.keys()
    for v, around in near.items():
        votes = [label[u] for u in around]
        assert votes.count(label[v]) == max(map(votes.count, votes))
    if kind != "random":
        assert len({label[v] for v in near if v < 200}) == 1
    with pytest.raises(g.NotSettled):
        g.settle_labels(edges, sweeps=0)


@pytest.mark.parametrize("kind", ("long", "string"))
def test_small_components_settle_in_tasks_as_in_sweeps(spark, monkeypatch, kind):
    rnd = random.Random(7)
    rows = [(c * 40 + rnd.randrange(12), c * 40 + rnd.randrange(12)) for c in range(9) for _ in range(30)] + [(500, 501), (501, 500), (900, 900)]
    edges = spark.createDataFrame(rows, "source long, target long").selectExpr(f"CAST(source AS {kind}) AS source", f"CAST(target AS {kind}) AS target")
    swept, colouring = [], g.colouring
    monkeypatch.setattr(g, "colouring", lambda pairs: swept.append(pairs.count()) or colouring(pairs))
    got = {}
    for most in (100_000, 40):
        monkeypatch.setattr(g, "IN_TASK", most)
        got[most] = {r.node: r.label for r in g.settle_labels(edges).collect()}
    pairs = {(a, b) for x, y in rows if x != y for a, b in ((x, y), (y, x))}
    assert len(swept) == 1 and 0 < swept[0] < len(pairs)
    assert got[100_000] == got[40] and len(got[40]) == len({a for a, _ in pairs})
    assert 9 < len(set(got[40].values())) < len(got[40])


def test_a_sweep_tells_how_good_its_state_is(spark, monkeypatch):
    """Modularity comes with the sweep, without joining all pairs twice more, and is right, loops and weights included."""
    rows = [(a, b, 1 + (a + b) % 3) for a, b in combinations(range(6), 2)] + [(a, b, 1) for a, b in combinations(range(6, 10), 2)] + [(0, 6, 1)]
    rows += [(b, a, w) for a, b, w in rows] + [(2, 2, 4)]
    total = sum(w for *_, w in rows)
    states, cut = [], g.cut
    monkeypatch.setattr(g, "cut", lambda df: (x := cut(df), states.append([tuple(r) for r in x.select("node", "own", "k", "inner").collect()]) if "inner" in x.columns else None)[0])
    members, _ = g._climb(spark.createDataFrame([(*r, total) for r in rows], "source long, target long, w long, total long"), 16, 20)
    assert groups(members) == [[*range(6)], [*range(6, 10)]]
    first = [x for x in states if len(x) == 10]
    assert len(first) > 2
    for state in first:
        own = {n: c for n, c, *_ in state}
        for n, c, k, inner in state:
            assert k == sum(w for a, _, w in rows if a == n) and inner == sum(w for a, b, w in rows if a == n and own[b] == c)
