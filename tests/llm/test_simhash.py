import random

from quarrylens.llm.common import components
from quarrylens.llm.simhash import majority, near_links, op2_simhash, shingle_hashes, signed, simhash_groups


def brute(fps):
    """Smallest member of each value's component under distance <= 2."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


def test_links_match_brute_force(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rnd.randint(0, 3)):
                y ^= 1 << rnd.randrange(64)
            fps.add(signed(y))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute(fps)
    for bucket in (64, 3):
        got = {r.node: r.root for r in components(near_links(df, bucket)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_edge_cases(spark):
    rows = [(1, "A b c d"), (1, "A b c d"), (2, "a  B\tc d"), (3, None), (4, " \n"), (5, ""), (None, "zz"), (7, "x" * 100_000), (8, "one two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(df).collect()), key=str)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert len(got) == len(rows) and len(by[1]) == 2
    assert by[1][0] == by[2][0] and by[1][0][1] == 1
    assert {by[i][0] for i in (3, 4, 5)} == {("0" * 16, 3)}
    assert by[None][0][1] is None
    assert simhash_groups(df.limit(0)).count() == 0


def test_whole_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: signed(majority(shingle_hashes(r.text, 3))) for r in docs}
    root = brute(set(fp.values()))
    first = {}
    for i, f in fp.items():
        first[root[f]] = min(i, first.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{f & (2**64 - 1):016x}", first[root[f]]) for i, f in fp.items()}


def test_no_variants_go_through_the_driver(spark, monkeypatch):
    """Spark takes exploded variants for few rows and would broadcast them: over 1 GB for 380,000 fingerprints."""
    from quarrylens.llm import simhash

    plans, cut = [], simhash.cut
    said = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(said(df)) or cut(df))
    plans.append(said(near_links(spark.range(50).selectExpr("id * 3 AS fp"))))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(4)] + [(9, "a b c d e f g 0")], "doc_id long, text string")
    plans.append(said(simhash_groups(docs)))
    simhash.keep_one(docs).count()
    held = [p for p in plans if "explode" in p]
    assert len(held) >= 4 and not any("Broadcast" in p for p in [plans[1], *held])
