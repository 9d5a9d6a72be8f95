import math

import numpy as np
import pytest

from quarrylens.llm.quality import FEATURES, Classifier, features, op8_quality, score


def test_classifier_separates():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(500, len(FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] > 0).astype(float)
    p = Classifier(x, y).probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    assert Classifier(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3


def test_posteriors_match_plain_arithmetic(spark):
    rnd = np.random.default_rng(1)
    good, bad = "the old house stands near a river and people walk there. ", "BUY!! NOW!! BUY!! "
    docs, labels, sites = [], [], []
    for i in range(240):
        host = f"h{i % 6}"
        y = int(rnd.random() < (0.95 if i % 6 < 3 else 0.2))
        docs.append((i, (good if y else bad) * rnd.integers(1, 5), "x"))
        sites.append((i, host, f"/p{i % 4}"))
        if i % 2:
            labels.append((i, y))
    d = spark.createDataFrame(docs, "doc_id long, text string, keep string")
    got = score(d, spark.createDataFrame(labels, "doc_id long, quality int"), spark.createDataFrame(sites, "doc_id long, host string, path string")).collect()
    assert len(got) == 240
    lab = dict(labels)
    v = {r.doc_id: float(lab.get(r.doc_id, r.p_text)) for r in got}
    at = {i: (h, p) for i, h, p in sites}

    def strength(groups, centre):
        n = np.array([len(g) for g in groups.values()], float)
        s = np.array([sum(g) for g in groups.values()])
        q = np.array([sum(x * x for x in g) for g in groups.values()])
        mean = s.sum() / n.sum()
        noise = (q - s * s / n).sum() / max(1, n.sum() - len(n))
        base = np.array([centre(k) if centre else mean for k in groups])
        var = ((n * (s / n - base) ** 2).sum() - (len(n) - 1) * noise) / (n.sum() - (n * n).sum() / n.sum())
        return mean, 1e6 if var <= 0 else min(max(mean * (1 - mean) / var - 1, 1), 1e6)

    hosts, paths = {}, {}
    for i, x in v.items():
        hosts.setdefault(at[i][0], []).append(x)
        paths.setdefault(at[i], []).append(x)
    mean, kh = strength(hosts, None)
    _, kp = strength(paths, lambda k: np.mean(hosts[k[0]]))
    for r in got:
        h, p = hosts[at[r.doc_id][0]], paths[at[r.doc_id]]
        ph = (kh * mean + sum(h) - v[r.doc_id]) / (kh + len(h) - 1)
        pp = (kp * ph + sum(p) - v[r.doc_id]) / (kp + len(p) - 1)
        assert r.p_host == pytest.approx(ph) and r.p_path == pytest.approx(pp) and 0 <= r.quality <= 1
    # the same text is better on a better host
    mean_of = lambda hs: np.mean([r.p_path for r in got if r.host in hs])
    assert mean_of({"h0", "h1", "h2"}) > mean_of({"h3", "h4", "h5"}) + 0.3


def test_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang"), None
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = score(docs, train, docs.selectExpr("doc_id", "source AS host", "lang AS path")).join(held, "doc_id", "inner").select("keep", held.quality.alias("y")).collect()
    right = np.mean([r.keep == bool(r.y) for r in got])
    kept = np.mean([r.keep for r in got if r.y])
    print(right, kept, len(got))
    assert right > 0.97 and kept > 0.98


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b c", 1), (3, "a b c", 1), (None, "w", 1), (5, "x" * 200_000, 1)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "doc_id long, host string, path string")
    got = score(docs, *none).collect()
    assert len(got) == 6 and all(math.isclose(r.quality, 0.5, abs_tol=1e-6) for r in got)
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")
    sites = spark.createDataFrame([(1, "h", None), (1, "h", "/b"), (3, None, None), (None, "h", "/")], "doc_id long, host string, path string")
    got = score(docs, labels, sites).collect()
    assert len(got) == 6 and all(0 <= r.quality <= 1 for r in got)
    assert score(docs.limit(0), labels, sites).count() == 0
    assert features("") == [0.0] * len(FEATURES)


def test_words_tell_where_statistics_do_not(spark):
    """Texts of the same lengths and shapes that differ in what they are about."""
    rnd = np.random.default_rng(4)
    good, bad = (["".join(rnd.choice(list("abcdefghij"), 6)) for _ in range(60)] for _ in range(2))
    common = ["".join(rnd.choice(list("klmnop"), 6)) for _ in range(60)]
    text = lambda own: " ".join(rnd.choice(own if rnd.random() < 0.3 else common) for _ in range(40)) + "."
    rows = [(i, text(good if i % 2 else bad), "s") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = df.where("doc_id < 400").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    got = score(df, labels, df.selectExpr("doc_id", "host", "host AS path")).where("doc_id >= 400").collect()
    assert np.mean([(r.p_text > 0.5) == bool(r.doc_id % 2) for r in got]) > 0.95


def test_words_of_a_label_do_not_speak_for_their_own_text(spark):
    """Labels without any meaning: a word that only one document has must not tell its label back."""
    rnd = np.random.default_rng(6)
    df = spark.createDataFrame([(i, f"alpha beta own{i} gamma", int(rnd.integers(2))) for i in range(400)], "doc_id long, text string, quality int")
    got = {r.doc_id: r.p_text for r in score(df.select("doc_id", "text"), df.select("doc_id", "quality"), df.selectExpr("doc_id", "'h' AS host", "'p' AS path")).collect()}
    right = np.mean([(got[r.doc_id] > 0.5) == bool(r.quality) for r in df.collect()])
    assert right < 0.65


def test_query_links_pages_and_documents(spark, sf):
    """Each document once; its site from the addresses of pages, told by a parser of its own."""
    from urllib.parse import urlsplit

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sites = {}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        u = urlsplit(p.url)
        parts = [x for x in u.path.split("/") if x]
        number = parts[-1].removesuffix(".html") if parts else ""
        if number.isascii() and number.isdigit():
            sites.setdefault(int(number), []).append((u.hostname, f"/{parts[0]}"))
    got = op8_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    by = {r.doc_id: r for r in got}
    linked = 0
    for d in docs:
        r = by[d.doc_id]
        want = min(sites.get(d.doc_id, []) + [(f"~{d.source}", f"~{d.lang}")])
        assert (r.host, r.path) == want
        linked += not r.host.startswith("~")
        assert 0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5)
    assert linked > 10
