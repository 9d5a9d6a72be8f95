import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from quarrylens.llm.runs import factors, find_runs, op12_runs, runs, runs_of_texts


def brute(w, times, least):
    """All stretches with their smallest period, by trying every period and growing."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                start, end = i, j + q
                if end - start >= max(least, times * q):
                    out.setdefault((start, end), q)  # smaller periods come first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("times, least", [(2, 1), (3, 1), (4, 6), (2, 5)])
def test_runs_match_brute_force(times, least):
    rnd = random.Random(times)
    for n in range(2500):
        letters = rnd.choice((1, 2, 2, 3, 5))
        w = [rnd.randrange(letters) for _ in range(rnd.randint(0, 40))]
        if n % 2:
            block = [rnd.randrange(letters) for _ in range(rnd.randint(1, 6))]
            at = rnd.randint(0, len(w))
            w[at:at] = block * rnd.randint(2, 7)
        assert sorted(runs(w, times, least)) == brute(w, times, least), w
        assert sorted(runs_of_texts([w, w[::-1]], times, least)[0]) == brute(w, times, least), w


def test_special_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    nested = []
    for _ in range(4):
        nested = (nested + [len(nested) % 3]) * 4
    for w in (fib[-1], nested, [7] * 500, [1, 2, 3] * 300 + [1, 2], list(range(300)) * 5, []):
        for times, least in ((2, 1), (3, 4), (4, 6)):
            assert sorted(runs(w, times, least)) == brute(w, times, least)


def test_factors_are_the_longest_that_began_before():
    rnd = random.Random(4)
    for _ in range(300):
        w = [rnd.randrange(3) for _ in range(rnd.randint(1, 30))]
        at = 0
        for s, n, old in factors(w):
            assert s == at
            best = max((k for j in range(s) for k in range(1, len(w) - s + 1) if w[j : j + k] == w[s : s + k]), default=0)
            assert n == max(best, 1) and (old < 0) == (best == 0)
            if best:
                assert old < s and w[old : old + n] == w[s : s + n]
            at += n
        assert at == len(w)


def plain(doc_id, text):
    """The contract, word for word, by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(brute(words, 4, 6), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in drop)))


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_query_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(op12_runs(spark, sf))
    assert got == sorted(((d.doc_id, *plain(d.doc_id, d.text)) for d in docs), key=str)
    assert any(r[1] for r in got)


def test_edges(spark, tmp_path):
    tail = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " * 5000, "  " * 8, "é\x1cb " * 9, "a b c d " * 3 + "a b c d", "a b " * 6 + "c " + "b a " * 6]
    rows = [(i, t, "x") for i, t in zip(tail, texts)] + [(1000 + i, t, "x") for i, t in enumerate(texts)] + [(None, "q r " * 7, None), (None, None, None), (1000, "a", "x"), (1000, "a", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op12_runs(spark, str(tmp_path)))
    assert got == sorted(((i, *plain(i, t)) for i, t, _ in rows), key=str)
    spark.createDataFrame([], "doc_id long, text string, collapsed string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_runs(spark, f"{tmp_path}/none").collect() == []


def test_long_text_and_real_outputs(spark):
    w = ["a", "b", "c"] * 40_000 + [str(i) for i in range(50_000)] * 2
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    r = find_runs(df, "doc_id").first()
    assert [tuple(x) for x in r.runs] == [(0, 120_000, 3)]
    assert r.collapsed == " ".join(["a", "b", "c", *w[120_000:]])
    r = find_runs(df, "doc_id", times=2, least=6).first()
    assert [tuple(x) for x in r.runs] == [(0, 120_000, 3), (120_000, 100_000, 50_000)]
