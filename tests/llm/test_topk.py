import duckdb
import numpy as np

from quarrylens.llm import topk
from quarrylens.llm.topk import OP10_SQL, best, op10_topk, quantised, top_k


def test_survivors_hold_the_best():
    rnd = np.random.default_rng(1)
    for width, spread in ((64, 30), (64, 30_000), (7, 2), (2, 3), (1, 5)):
        smooth = np.cumsum(rnd.normal(size=(300, width)), axis=1)
        v = np.floor(smooth * spread)
        ids = rnd.permutation(300)
        n = {}
        q, c, s = best(v[:40], ids[:40], v, ids, 5, n)
        got = sorted(zip(ids[q].tolist(), ids[c].tolist(), s.tolist()))
        want = sorted((int(ids[i]), j, -x) for i in range(40) for x, j in sorted((-int(v[i] @ v[t]), int(ids[t])) for t in range(300) if ids[t] != ids[i])[:5])
        assert got == want
        if width == 64:
            assert n["alive"][-1] < 300 * 40 / 2 and sorted(n["alive"], reverse=True) == n["alive"]


def test_whole_table_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(OP10_SQL).fetchall()) == sorted(map(tuple, op10_topk(spark, sf).collect()))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (0, [0.5, -0.01]), (20, [0.5, -0.01]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [0.25, 0.25]), (6, [0.25, 0.25]), (7, []), (40, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k(quantised(df), 2).collect()))
    # the repeated row of id 0 is a query twice and a candidate twice
    assert got == [(0, 1, 20, 1025), (0, 2, 20, 1025), (20, 1, 0, 1025), (20, 2, 0, 1025)]
    assert top_k(quantised(df.limit(0))).count() == 0


def test_repeated_ids_match_sql(spark, tmp_path, monkeypatch):
    """Ids that repeat with other vectors and with the same, one of them a third of the rows, over several blocks."""
    rnd = np.random.default_rng(5)
    rows = [(int(rnd.integers(0, 90)) if i % 3 else 40, [float(x) for x in rnd.integers(-3, 4, 4 + (i % 50 == 0)) / 8]) for i in range(900)]
    rows += [(20, [0.5, 0.25, 1.0, 2.0]), (20, [1.0, 0.0, 0.0, 2.0])] * 3 + [(60, [0.5, 0.25, 1.0, 2.0])] * 30
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, n in (("QUERY_BLOCK", 64), ("CANDIDATE_BLOCK", 100), ("AT_ONCE", 10)):
        monkeypatch.setattr(topk, name, n)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(OP10_SQL).fetchall())
    assert sorted(map(tuple, op10_topk(spark, str(tmp_path)).collect())) == want and len(want) == 100
    assert all(q != v for q, _, v, _ in want)


def test_blocks_that_cannot_win_are_not_sent(spark, monkeypatch):
    """Vectors about a few directions and of very different norms: most blocks of candidates cannot win, and nothing is lost."""
    rnd = np.random.default_rng(8)
    ways = rnd.normal(size=(6, 32)) * 20
    v = np.array([ways[i % 6] * rnd.uniform(0.01, 2) ** 2 + rnd.normal(size=32) for i in range(3000)])
    rows = [(i, np.floor(x).tolist()) for i, x in enumerate(v)]
    for name, n in (("QUERY_BLOCK", 16), ("CANDIDATE_BLOCK", 64), ("SAMPLE", 400), ("ENVELOPES", 20)):
        monkeypatch.setattr(topk, name, n)
    kept, can_win = [], topk.can_win

    def spy(q, c):
        out = can_win(q, c)
        kept.append((out.count(), q.count() * c.count()))
        return out

    monkeypatch.setattr(topk, "can_win", spy)
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), 5).collect()))
    m = np.array([r[1] for r in rows])
    want = []
    for i in range(0, 3000, 20):
        score = (m @ m[i]).astype(np.int64)
        order = sorted((-int(s), j) for j, s in enumerate(score) if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(order)]
    assert got == sorted(want)
    assert kept[0][0] < 0.5 * kept[0][1]
