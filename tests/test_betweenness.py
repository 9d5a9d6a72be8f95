import random
import time

import pytest

from quarrylens.operators import betweenness as bt
from quarrylens.operators.betweenness import betweenness


def brandes(n, edges):
    out = {i: [] for i in range(n)}
    for a, b in set(edges):
        if a != b:
            out[a].append(b)
    total = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        if not out[s]:
            continue
        order, dist, paths, before = [s], {s: 0}, {s: 1.0}, {}
        for v in order:
            for t in out[v]:
                if t not in dist:
                    dist[t], paths[t], before[t] = dist[v] + 1, 0.0, []
                    order.append(t)
                if dist[t] == dist[v] + 1:
                    paths[t] += paths[v]
                    before[t].append(v)
        share = dict.fromkeys(order, 0.0)
        for t in reversed(order[1:]):
            for v in before[t]:
                share[v] += paths[v] / paths[t] * (1 + share[t])
            total[t] += share[t]
    return {i: x / ((n - 1) * (n - 2)) for i, x in total.items()}


def check(spark, n, edges):
    nodes = spark.range(n)
    df = spark.createDataFrame([*edges, *edges[:3], (0, 0), (0, n + 5)], "source long, target long")
    got = {r.id: r.betweenness for r in betweenness(nodes, df).collect()}
    want = brandes(n, edges)
    assert len(got) == n
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want), max(want, key=lambda i: abs(got[i] - want[i]))
    return want


def graph(rnd, kind):
    """Edges of a core, of trees that hang on it, and of nodes with equal neighbours."""
    k = rnd.randint(2, 9)
    edges = [(rnd.randrange(k), rnd.randrange(k)) for _ in range(rnd.randint(1, 3 * k))]
    n = k
    for _ in range(rnd.randint(0, 14)):
        v = rnd.randrange(n)
        way = rnd.choice(("up", "down", "both"))
        edges += [(n, v)] * (way != "down") + [(v, n)] * (way != "up")
        n += 1
    if kind == "twins":
        for _ in range(rnd.randint(1, 4)):
            like = rnd.randrange(k)
            near = [e for e in edges if like in e and e[0] < k and e[1] < k and e[0] != e[1]]
            for _ in range(rnd.randint(1, 3)):
                edges += [tuple(n if x == like else x for x in e) for e in near]
                n += 1
                if rnd.random() < 0.5:
                    edges.append((n - 1, n) if rnd.random() < 0.5 else (n, n - 1))
                    n += 1
    return n, edges


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    """Many small graphs side by side in one, so that few runs see many shapes; counted by tasks and by joins."""
    rnd = random.Random(seed)
    n, edges = 0, []
    for i in range(60):
        m, some = graph(rnd, "twins" if i % 2 else "trees")
        edges += [(a + n, b + n) for a, b in some]
        n += m
    want = check(spark, n, edges)
    assert max(want.values()) > 0
    monkeypatch.setattr(bt, "CORE_EDGES", 0)
    monkeypatch.setattr(bt, "BLOCK_ROWS", n * n // 3)
    check(spark, n, edges)


def test_graphs_of_over_5000_nodes(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(4)]
    assert max(check(spark, 5100, edges).values()) > 0


def test_long_paths_and_few_nodes(spark):
    check(spark, 130, [(i, i + 1) for i in range(128)])
    check(spark, 60, [(i, (i + 1) % 60) for i in range(60)])
    for n in (1, 2):
        got = betweenness(spark.range(n), spark.createDataFrame([(0, 1)], "source long, target long")).collect()
        assert [r.betweenness for r in got] == [0.0] * n
    assert all(r.betweenness == 0 for r in betweenness(spark.range(4), spark.createDataFrame([], "source long, target long")).collect())
    named = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    got = {r.id: r.betweenness for r in betweenness(named, spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "source string, target string")).collect()}
    assert got == {"a": 0.0, "b": 1 / 6, "c": 0.0, None: 0.0}


def test_fifty_thousand_nodes(spark):
    """A core of 400 nodes, 12,000 pairs of equal neighbours and trees; all pairs would be 2.5 thousand million."""
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(900)]
    n = 400
    while n < 24_400:
        a, b = rnd.sample(range(400), 2)
        edges += [(a, n), (n, b), (a, n + 1), (n + 1, b)]
        n += 2
    while n < 50_000:
        edges.append((n, rnd.randrange(n)) if rnd.random() < 0.5 else (rnd.randrange(n), n))
        n += 1
    nodes, df = spark.range(n), spark.createDataFrame(edges, "source long, target long")
    began = time.time()
    got = {r.id: r.betweenness for r in betweenness(nodes, df).collect()}
    assert time.time() - began < 240
    assert len(got) == n
    # all paths of a few sources, counted one by one, give no more than the sum; pairs with a path in all agree with it
    out = {}
    for a, b in set(edges):
        if a != b:
            out.setdefault(a, []).append(b)
    inner = 0
    for s in range(0, n, 25):
        dist, order = {s: 0}, [s]
        for v in order:
            for t in out.get(v, ()):
                if t not in dist:
                    dist[t] = dist[v] + 1
                    order.append(t)
        inner += sum(d - 1 for d in dist.values() if d > 1)
    total = sum(got.values()) * (n - 1) * (n - 2)
    # the sum of all betweenness is the number of inner nodes of all shortest paths; every 25th source estimates it
    assert abs(25 * inner / total - 1) < 0.05
