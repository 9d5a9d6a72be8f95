import random

import numpy as np
import pytest

from quarrylens.llm import simhash
from quarrylens.llm.simhash import keep_one, shingle_hashes


def jaccard(a, b):
    x, y = (set(shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def brute(texts):
    """The least of each component of similarity 0.8."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            m = len(a & b)
            if m >= 0.8 * (len(a) + len(b) - m):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {root(i) for i in range(len(sets))}


def edited(rnd, words, edits):
    w = list(words)
    for at in rnd.sample(range(len(w)), edits):
        w[at] = f"e{rnd.getrandbits(32)}"
    return w


def kept(spark, texts):
    return {r.doc_id for r in keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_crowd_matches_brute_force(spark, seed):
    """Copies of one text, some too far from it but near to each other or to a half-way copy."""
    rnd = random.Random(seed)
    base = [f"w{rnd.getrandbits(24)}" for _ in range(200)]
    rows = [edited(rnd, base, rnd.randint(1, 3)) for _ in range(150)]
    for _ in range(12):
        middle = edited(rnd, base, 6)
        rows += [edited(rnd, middle, 1), edited(rnd, middle, 2)]
    for _ in range(40):
        far = edited(rnd, base, rnd.randint(5, 9))
        rows += [far, edited(rnd, far, 1), edited(rnd, far, 2)]
    rnd.shuffle(rows)
    texts = [" ".join(w) for w in rows]
    assert kept(spark, texts) == brute(texts)


def test_crowd_of_cut_and_extended_copies(spark):
    """Copies that lack parts or have common additions, so that links run between copies far from the centre."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.getrandbits(24)}"
    base = [word() for _ in range(150)]
    add = [[word() for _ in range(60)] for _ in range(3)]
    rows = [edited(rnd, base, 1) for _ in range(60)]
    rows += [edited(rnd, base[: rnd.randint(40, 150)], 1) for _ in range(90)] + [base[a : a + rnd.randint(50, 90)] for a in (rnd.randint(0, 60) for _ in range(60))]
    rows += [edited(rnd, base + rnd.choice(add)[: rnd.randint(20, 60)], rnd.randint(0, 2)) for _ in range(90)]
    rows += [edited(rnd, base, rnd.randint(4, 8)) for _ in range(60)]
    rnd.shuffle(rows)
    texts = [" ".join(w) for w in rows]
    assert kept(spark, texts) == brute(texts)


def test_large_crowd_grows_in_proportion(spark, monkeypatch):
    """Copies of a short text with an edit or two: hardly any pair is similar, and hardly any is compared."""
    rnd = random.Random(5)
    base = [f"w{rnd.getrandbits(24)}" for _ in range(34)]
    texts = [" ".join(edited(rnd, base, rnd.randint(1, 2))) for _ in range(3000)]
    compared, plain = [], simhash.similar

    def counted(pairs, sets):
        compared.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(simhash, "similar", counted)
    got = kept(spark, texts)
    assert sum(compared) < 12 * len(texts)
    assert got == brute(texts)


def test_pairs_about_the_threshold(spark):
    """Of pairs at 0.8 to 0.86 none stays, of those below 0.8 both."""
    rnd = random.Random(3)
    texts, near = [], []
    while len(texts) < 1200:
        base = [f"w{rnd.getrandbits(32)}" for _ in range(rnd.randint(60, 300))]
        a, b = " ".join(base), " ".join(edited(rnd, base, max(1, round(len(base) * rnd.uniform(0.018, 0.045)))))
        if 0.6 < jaccard(a, b) < 0.86:
            near.append(jaccard(a, b) >= 0.8)
            texts += [a, b]
    got = kept(spark, texts)
    assert np.sum(near) > 100 and {2 * i for i in range(len(near))} <= got
    assert [2 * i + 1 not in got for i in range(len(near))] == near
