import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import substrings as sub
from quarrylens.llm.substrings import common_prefixes, op5_substrings, ranges, remove_repeats, repeats, strips, suffix_array


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=150, deadline=None)
def test_suffix_array_and_prefixes(x):
    s = np.array([v + 1 for v in x] + [0], np.uint8)
    sa, rank = suffix_array(s)
    t = s.tolist()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    assert rank[sa].tolist() == list(range(len(t)))
    got = common_prefixes(s, np.array([0]), np.array([len(x)]), sa, rank, 1000)
    for i in range(len(x)):
        if rank[i]:
            a, b = t[i:], t[sa[rank[i] - 1] :]
            n = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert got[i] == n


def windows(parts, w):
    count = {}
    for p in parts:
        for i in range(len(p) - w + 1):
            count[p[i : i + w]] = count.get(p[i : i + w], 0) + 1
    return [[count[p[i : i + w]] > 1 for i in range(len(p) - w + 1)] for p in parts]


def test_repeats_match_brute_force():
    rnd = random.Random(1)
    for letters in ("ab", "abcdefgh"):
        for _ in range(150):
            parts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))).encode() for _ in range(rnd.randint(1, 6))]
            parts += [p[rnd.randint(0, 5) :] for p in parts[:2]]
            want = [x for f in windows(parts, 6) for x in f]
            assert repeats(parts, 6).tolist() == want


def test_strips_cover_all_windows_and_follow_content():
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcd ") for _ in range(900)).encode()
    parts = [base, b"xx" + base[100:700] + b"yyy", b"short", b"", b"ab" * 400]
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    s, n, anchor, digest = strips(raw, ends)
    covered = sorted(int(a) + i for a, m in zip(s, n) for i in range(m))
    begins = np.concatenate(([0], ends[:-1]))
    assert covered == [int(b) + i for b, p in zip(begins, parts) for i in range(max(0, len(p) - 199))]
    at = {}
    for a, m, h in zip(s, n, anchor):
        for i in range(m):
            at.setdefault(raw[a + i : a + i + 200].tobytes(), set()).add(int(h))
    assert all(len(x) == 1 for x in at.values())


def brute(rows):
    docs = [(t or "").encode() for _, t in rows]
    flags = windows(docs, 200)
    out = []
    for (i, _), d, f in zip(rows, docs, flags):
        gone = np.zeros(len(d), bool)
        for a, b in ranges(np.array(f, bool)):
            gone[a : b + 199] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((i, len(d), int(gone.sum()), len(ranges(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def make_rows():
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdeé fgh\n") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 260, 500, 900)]
    rows = [(i, text(rnd.randint(0, 300)) + rnd.choice(shared) + text(rnd.randint(0, 120)) + rnd.choice(shared) + text(40)) for i in range(60)]
    edit = rows[0][1]
    rows += [(100 + i, edit[: 7 * i] + "#" + edit[7 * i :]) for i in range(25)]
    return rows + [(200, None), (201, ""), (202, "ab" * 300), (203, "x" * 5000), (204, shared[3]), (204, shared[3]), (None, text(300)), (206, "é" * 120), (207, text(30_000))]


def test_against_brute_force(spark, monkeypatch):
    rows = make_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_bytes int, k string")
    want = brute(rows)
    assert result(remove_repeats(df)) == want
    monkeypatch.setattr(sub, "CHUNK", 1000)
    monkeypatch.setattr(sub, "SHARD", 3000)
    monkeypatch.setattr(sub, "STRIPS", 2)
    assert result(remove_repeats(df)) == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op5_substrings(spark, sf)) == brute(docs)


def test_spans_of_a_repetitive_text_are_merged_before_they_are_gathered(spark):
    rows = [(1, "ab" * 100_000), (2, "x" * 50_000 + "".join(chr(97 + i * i % 26) for i in range(400))), (3, "no repeats here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sub.repeated_spans(df, sub.packed_texts(df)).collect()
    # 100,000 and more before; a few for each task that has some
    assert {r.doc_id for r in spans} == {1, 2} and all(len(r.spans) <= 10 for r in spans)
    assert result(remove_repeats(df)) == brute(rows)
