import hashlib
import random
import re
import time

from quarrylens.llm.pii import base_spans, beliefs, candidates, detect, digest, find, luhn, op9_pii, replace, skip_edges, train

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, p in P.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rnd = random.Random(11)
    for letters in ("a@.b ", "01.2+- (", "1234567890 -+", "a@b.c1.2.3.4+5 -)", "é@a.b9", "ab@.\n\r\u2028", "12.+ \n-\r\t", "a1@.-+\x0b\x85\n"):
        for _ in range(3000):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
            assert base_spans(t) == naive(t), t
    t = "x 4111 1111 1111 1111, +1 (555) 123-4567; a.b+c@x-y.co.uk 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8"
    assert base_spans(t) == naive(t) and len(base_spans(t)) == 6
    for t in ("abc\n@x.yz tail", "\n@x.yz", "a@b.c\nd@e.f", "+12345\n6789", "1.2.3.4\n.5"):
        assert base_spans(t) == naive(t), t


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 400_000 + "@", "1" * 400_000 + ".", "1." * 200_000, "+" * 100_000 + "1 " * 100_000, "a@" * 100_000):
        base_spans(t)
        candidates(t, base_spans(t))
    assert time.time() - began < 30


def test_beliefs_are_exact_on_trees():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(2)
    unary, edges, pair = rnd.normal(size=(4, 3)), np.array([(0, 1), (1, 2), (1, 3)]), rnd.normal(size=(3, 3, 3))
    p = np.zeros((4, 3))
    for x in itertools.product(range(3), repeat=4):
        w = np.exp(sum(unary[i, x[i]] for i in range(4)) + sum(pair[e, x[u], x[v]] for e, (u, v) in enumerate(edges)))
        for i in range(4):
            p[i, x[i]] += w
    assert np.allclose(beliefs(unary, edges, pair, 60), p / p.sum(1, keepdims=True), atol=1e-3)


def test_skip_edges_carry_labels(spark):
    seen = "mail me or call +1 415 555 0{:03d}. later call 415 555 0{:03d} again. item 1234567 left."
    df = spark.createDataFrame([(i, seen.format(i, i)) for i in range(200)] + [(1000 + i, f"order number {i:09d} shipped") for i in range(400)], "doc_id long, text string")
    field = train(df)
    _, full = find(["call +1 415 555 0777 then 415 555 0777 ok", "order number 123456789 shipped"], field)
    assert [s[0] for s in full[0]] == ["phone", "phone"] and full[1] == []
    nodes = candidates("5550001111 x 5550001111 y 5550001111", [])
    assert skip_edges(nodes) == [(0, 1), (1, 2)]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc"), (3, "a@b.cc"), (None, "1.2.3.4"), (5, "z" * 300_000), (6, "😀 a@b.cc")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    got = detect(df, train(df), "doc_id", redact=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_sha256 == by[2].base_sha256 == hashlib.sha256(b"").hexdigest() and by[1].spans == ""
    assert by[6].spans == "email:2:8" and by[6].redacted == "😀 <EMAIL>" and by[1].redacted is None
    assert by[None].n_ip == 1
    assert detect(df.limit(0), train(df.limit(0)), "doc_id").count() == 0
    assert replace("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<CARD>f"


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = naive(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))  | {""}


def test_look_alike_mail_is_taken_whole():
    text = "mail " + "long.name-" * 20 + "x@host now"
    (c,) = candidates(text, [])
    assert (c.start, c.end) == (5, text.index(" now"))


def test_evidence_reaches_all_repeats():
    import numpy as np

    n = 60
    unary = np.tile(np.log([0.5, 0.5]), (n, 1))
    unary[0] = np.log([1e-9, 1.0])
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    p = beliefs(unary, edges, np.array([np.eye(2) * 7.0] * (n - 1)))
    # probability that an even number of links differs
    want = (1 + np.tanh(3.5) ** np.arange(n)) / 2
    assert np.allclose(p[:, 1], want, atol=0.01)
