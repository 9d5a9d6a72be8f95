import re

import numpy as np

from quarrylens.llm import mixing
from quarrylens.llm.mixing import flight, landing, mix, op4_mixing


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s for s in names if s not in fixed}
        spare = total - sum(fixed.values())
        got = {s: spare * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if got[s] >= cap[s]}
        if not over:
            return fixed | got
        fixed |= {s: cap[s] for s in over}


def test_flight_keeps_totals_and_probabilities():
    rnd = np.random.default_rng(4)
    size = rnd.integers(1, 900, 501).astype(float)
    p = flight(np.full(501, 0.37), size, rnd)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - 0.37 * 501) < 1e-6 and abs(p @ size - 0.37 * size.sum()) < 1e-3
    q = landing(p, size)
    assert set(q) <= {0.0, 1.0} and abs(q @ size - 0.37 * size.sum()) <= size.max()
    mean = np.mean([flight(np.full(9, 0.3), np.arange(1.0, 10), rnd) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.03
    assert flight(np.full(5, 0.5), np.full(5, 7.0), rnd).sum() == 2.5


def check(rows, share=1.5):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = water(sizes, (3, 1, 2))
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(r.size for r in rows if r.source == s)


def test_whole_table(spark, sf):
    rows = op4_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    from types import SimpleNamespace as N

    full = [N(source=docs[r.doc_id].source, **r.asDict()) for r in rows]
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in full)
    check(full)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_mixing(spark, sf).collect()))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "MERGE", 2)
    rows = [(i, "w " * (1 + i * 7 % 23), ["b", "a", None, "a", "é"][i % 5], i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix(df, "doc_id", "source").collect()
    assert len(got) == 400
    check(got)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z " * 50_000, "b"), (5, "q", "b"), (6, " ", "c")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, target string")
    got = mix(df, "doc_id", "source").collect()
    assert len(got) == len(rows)
    check(got)
    assert mix(df.limit(0), "doc_id").count() == 0
    zero = mix(df.where("doc_id IN (1, 2)"), "doc_id").collect()
    assert [(r.target, r.taken) for r in zero] == [(0.0, 0)] * 2


def test_equal_rows_are_split_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    sizes = []
    fly = mixing._fly

    def spy(df, land):
        sizes.append(df.groupBy("source", "block").count().agg({"count": "max"}).first()[0])
        return fly(df, land)

    monkeypatch.setattr(mixing, "_fly", spy)
    rows = [(7, "one two three", "a")] * 3000 + [(i, "w " * (1 + i % 9), "b") for i in range(500)] + [(7, "one two three", None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix(df, "doc_id", "source").collect()
    assert sizes[0] == 64 and max(sizes) < 200
    check(got)
    again = mix(df.repartition(3), "doc_id", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
