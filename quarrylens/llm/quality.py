"""Document quality by hierarchical empirical Bayes.

A logistic classifier over statistics of the whole text, and over what its words
say, gives each document its evidence. The words' weights are log odds from the
labelled sample, in two halves: a document is judged by the half that it is not
in, so that no label speaks for its own text. Sites add to it: a host's documents are summed up (labels where there
are labels, else classifier probabilities) and shrunk towards the global mean, a
path's documents towards their host. How strongly is estimated from the data by
moments, once for hosts and once for paths: where sites hardly differ, or have
few documents, the prior above them decides. A document's own share is taken
out of its site before the two are combined.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, map_batches, share

#: The classifier is fitted on so many labelled documents at most, chosen by hash.
FIT_ROWS = 20_000
FEATURES = ("log_words", "word_length", "word_spread", "distinct", "top_word", "again", "upper", "shout", "symbols", "digits", "pipes", "line_repeat", "ends", "function", "words")
#: Words count by hash; the mean of their log odds is the last of FEATURES.
BUCKETS = 1 << 18
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER, _SYMBOL, _DIGIT, _END = (re.compile(x) for x in (r"[A-Z]+", r"[^\w\s.,;:!?'\"()-]+", r"[0-9]+", r"[.?][ \n]"))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def half(doc_id: int | None) -> int:
    """In which half of the labelled sample a document is, or would be."""
    return zlib.crc32(f"half {doc_id}".encode()) & 1


class Words:
    """Log odds of good against bad for each bucket of words, by presence in labelled documents of either half."""

    def __init__(self, counts: np.ndarray, docs: np.ndarray):
        """counts[half, label, bucket] and docs[half, label]: in how many documents, and of how many."""
        share = (counts + 0.5) / (docs[:, :, None] + 1)
        # a half without both labels says nothing
        both = (docs > 0).all(axis=1)
        self.weights = np.where(both[:, None], np.log(share[:, 1]) - np.log(share[:, 0]), 0.0).astype(np.float32)

    def evidence(self, words, doc_id: int | None) -> float:
        at = np.fromiter({bucket(w) for w in words}, np.int64)
        return float(self.weights[1 - half(doc_id), at].mean()) if len(at) else 0.0


def features(text: str | None, doc_id: int | None = None, known: Words | None = None) -> list[float]:
    """Statistics of a whole text, in the order of FEATURES; all 0 without words."""
    w = _WORDS.findall(text or "")
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    count = Counter(w)
    sizes = list(map(len, w))
    mean = sum(sizes) / n
    total = lambda p: sum(map(len, p.findall(text)))
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(c for x, c in count.items() if len(x) <= 3)
    return [
        math.log(n),
        mean,
        math.sqrt(max(0.0, sum(x * x for x in sizes) / n - mean * mean)),
        len(count) / n**0.8,
        count.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(w, w[1:])) / n,
        total(_UPPER) / chars,
        text.count("!") / n,
        total(_SYMBOL) / chars,
        total(_DIGIT) / chars,
        text.count("|") / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(_END.findall(text)) / n,
        short / n,
        known.evidence(count, doc_id) if known else 0.0,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and roots."""
    return np.concatenate([x, x**2, np.sqrt(np.abs(x))], axis=1)


class Classifier:
    """Standardised logistic regression, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        z = expand(x) if len(x) else np.zeros((0, 3 * len(FEATURES)))
        self.mean = z.mean(0) if len(z) else np.zeros(z.shape[1])
        self.spread = np.maximum(z.std(0), 1e-6) if len(z) else np.ones(z.shape[1])
        z = np.concatenate([np.ones((len(z), 1)), np.clip((z - self.mean) / self.spread, -8, 8)], axis=1)
        self.base = (y.sum() + 1) / (len(y) + 2)
        w = np.zeros(z.shape[1])
        w[0] = math.log(self.base / (1 - self.base))
        ridge = np.full(len(w), 1.0)
        ridge[0] = 1e-3
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * np.where(np.arange(len(w)) > 0, w, 0)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expand(x) - self.mean) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def _strength(groups: DataFrame, inside: str | None) -> tuple[float, float]:
    """Overall mean and prior strength (in documents) of groups (n, s, q: count, sum, sum of squares), by moments.

    With ``inside`` the groups' differences are from the mean of the group above,
    given as columns above_n and above_s.
    """
    base = "above_s / above_n" if inside else "m"
    if not inside:
        total = groups.agg(F.sum("s") / F.sum("n")).first()[0]
        groups = groups.withColumn("m", F.lit(float(total if total is not None else 0.5)))
    r = groups.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.count("*").alias("k"),
        F.sum(F.expr("n * n")).alias("n2"),
        F.sum(F.expr("q - s * s / n")).alias("within"),
        F.sum(F.expr(f"n * pow(s / n - {base}, 2)")).alias("between"),
    ).first()
    if not r.n:
        return 0.5, 1.0
    mean = min(max(r.s / r.n, 1e-6), 1 - 1e-6)
    noise = r.within / max(1, r.n - r.k)
    spare = r.n - r.n2 / r.n
    var = (r.between - (r.k - 1) * noise) / spare if spare > 0 else 0.0
    if var <= 0:
        return mean, 1e6
    return mean, min(max(mean * (1 - mean) / var - 1, 1.0), 1e6)


def _words(source: DataFrame, labelled: DataFrame) -> Words:
    """From the whole texts of the labelled documents: a row for each half, label and bucket, whatever their number."""

    def rows(x: dict) -> dict:
        out: dict[str, list] = {"h": [], "y": [], "b": []}
        for i, y, t in zip(x["doc_id"], x["y"], x["text"]):
            # bucket -1 counts the documents
            found = [-1, *{bucket(w) for w in _WORDS.findall(t or "")}]
            out["h"] += [half(i)] * len(found)
            out["y"] += [int(y)] * len(found)
            out["b"] += found
        return out

    counts, docs = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
    got = map_batches(source.join(labelled, "doc_id").select("doc_id", "y", "text"), rows, "h int, y int, b int").groupBy("h", "y", "b").agg(F.count("*").alias("n")).toArrow()
    h, y, b, n = (got[c].to_numpy() for c in ("h", "y", "b", "n"))
    words = b >= 0
    counts[h[words], y[words], b[words]] = n[words]
    docs[h[~words], y[~words]] = n[~words]
    return Words(counts, docs)


def score(docs: DataFrame, labels: DataFrame, sites: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, host, path, p_text, p_host, p_path, quality and keep.

    ``labels`` has doc_id and quality (1 good, 0 bad; null: no label; of several
    the least holds), ``sites`` doc_id, host and path (of several the least
    holds). A document without a site belongs to the null site, which is a host
    like any other. Texts without words get the statistics 0. Without labels
    every probability is 1/2. Extra columns are ignored; empty tables are fine.
    """

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = cut(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("double").alias("y")))
    # thinned by hash first: else every partition would send FIT_ROWS rows to the driver
    most = math.ceil((1 << 20) * min(1.0, 1.25 * FIT_ROWS / max(1, known.count())))
    thin = cut(known.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 20}) < {most}")))
    words = share(docs.sparkSession, _words(source, thin))

    def rows(x: dict) -> dict:
        return {"doc_id": x["doc_id"], "f": [features(t, i, words()) for t, i in zip(x["text"], x["doc_id"])]}

    feats = cut(map_batches(source, rows, "doc_id long, f array<double>"))
    sample = feats.join(thin, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(FIT_ROWS).collect()
    model = Classifier(np.array([r.f for r in sample]).reshape(-1, len(FEATURES)), np.array([r.y for r in sample]))
    shared = share(docs.sparkSession, model)

    def judge(x: dict) -> dict:
        return {"doc_id": x["doc_id"], "p_text": shared().probability(np.array(x["f"]).reshape(-1, len(FEATURES))).tolist()}

    scored = map_batches(feats, judge, "doc_id long, p_text double")
    place = sites.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))).alias("x")).select("doc_id", "x.*")
    each = cut(scored.join(known, "doc_id", "left").join(place, "doc_id", "left").withColumn("v", F.coalesce("y", "p_text")))
    sums = [F.count("*").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.expr("v * v")).alias("q")]
    paths = cut(each.groupBy("host", "path").agg(*sums))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    mean, k_host = _strength(hosts, None)
    above = hosts.select(F.col("host").alias("h"), F.col("n").alias("above_n"), F.col("s").alias("above_s"))
    nested = cut(paths.join(above, F.expr("host <=> h")).drop("h"))
    _, k_path = _strength(nested, "host")
    site = nested.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "above_n", "above_s")
    joined = each.join(site, F.expr("host <=> h AND path <=> p"))
    # posteriors of a site without the document itself
    joined = joined.withColumn("p_host", (F.lit(k_host * mean) + F.col("above_s") - F.col("v")) / (F.lit(k_host) + F.col("above_n") - 1))
    joined = joined.withColumn("p_path", (F.lit(k_path) * F.col("p_host") + F.col("s") - F.col("v")) / (F.lit(k_path) + F.col("n") - 1))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    odds = logit(F.col("p_text")) - F.lit(math.log(model.base / (1 - model.base))) + logit(F.col("p_path"))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "host", "path", "p_text", "p_host", "p_path", "quality", (F.col("quality") >= 0.5).alias("keep"))


#: host, and first part of the path, of a URL
HOST, PATH = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", r"^[^:]+://[^/?#]+(/[^/?#]*)"


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents; a page whose path ends in a document's number tells its host and path, else its source and language do."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    number = F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)(?:[.]html)?/?(?:[?#].*)?$', 1) AS BIGINT)")
    paged = pages.select(number.alias("doc_id"), F.lower(F.regexp_extract("url", HOST, 1)).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"))
    plain = docs.select("doc_id", F.concat(F.lit("~"), "source").alias("host"), F.concat(F.lit("~"), "lang").alias("path"))
    # "~" sorts behind every host name, so that a page's site is the least
    return score(docs.select("doc_id", "text"), labels, paged.unionAll(plain))
