"""Periodic runs of words by Kolpakov and Kucherov's algorithm.

A run of period q is a stretch of words in which words q apart are the same and
which no neighbouring word extends. The suffix automaton of a word sequence
gives its factorisation (each factor is the longest that began before, or one
new word). A run that starts before a factor and ends in it, or touches its
border, reaches back fewer than q words plus the factor before, so Main's
algorithm finds it by extending equal words from the border. Any other run lies
strictly inside a factor and is copied from that factor's earlier occurrence.

With runs of at least four periods and six words, each four words of a run
occur twice or more in the text (for period 1 six words hold three equal fours,
for period 2 eight words hold five fours in two classes, for longer periods at
least three times). Words outside of such fours are in no run, so a text is
first cut there; the cut changes no result and leaves plain prose at once.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_batches

#: Words are runs of anything but the six ASCII white spaces.
SPACES = "[\\x20\\x09-\\x0D]+"

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence: per state its longest string's length, suffix link and first end, and its transitions.

    A state's first transition is in two arrays, only branching states have a
    dictionary: some 40 bytes a word where few states branch.
    """

    def __init__(self, w: list[int]):
        self.length, self.link, self.first = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.symbol, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        length, link, symbol, target, more = self.length, self.link, self.symbol, self.target, self.more
        last = 0
        for i, c in enumerate(w):
            new = self._state(length[last] + 1, i)
            p = last
            while p >= 0:
                if symbol[p] == c or (p in more and c in more[p]):
                    break
                if symbol[p] < 0:
                    symbol[p], target[p] = c, new
                else:
                    more.setdefault(p, {})[c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
            else:
                q = target[p] if symbol[p] == c else more[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = self._state(length[p] + 1, self.first[q])
                    symbol[twin], target[twin], link[twin] = symbol[q], target[q], link[q]
                    if q in more:
                        more[twin] = more[q].copy()
                    while p >= 0:
                        if symbol[p] == c:
                            if target[p] != q:
                                break
                            target[p] = twin
                        elif p in more and more[p].get(c) == q:
                            more[p][c] = twin
                        else:
                            break
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def _state(self, length: int, first: int) -> int:
        self.length.append(length)
        self.first.append(first)
        for x in (self.link, self.symbol, self.target):
            x.append(-1)
        return len(self.length) - 1


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Start, length and an earlier start (-1 for a new word) of each factor."""
    a = Automaton(w)
    symbol, target, first, more = a.symbol, a.target, a.first, a.more
    out, i, n = [], 0, len(w)
    while i < n:
        state, k = 0, 0
        while i + k < n:
            c = w[i + k]
            to = target[state] if symbol[state] == c else more[state].get(c, -1) if state in more else -1
            if to < 0 or first[to] >= i + k:
                break
            state, k = to, k + 1
        out.append((i, max(k, 1), first[state] - k + 1 if k else -1))
        i += max(k, 1)
    return out


def extensions(x: list[int]) -> list[int]:
    """For each place of x the length of the longest common prefix of x and what begins there (0 for the first)."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(w: list[int], s: int, a: int, b: int, times: int, found: dict[tuple[int, int], int]) -> None:
    """Main's algorithm: runs that hold or touch the border at s and end in the factor of b words that begins there; a words before it are the last factor."""
    most = (a + b - 1) // (times - 1)
    if most < 1:
        return
    back = min(s, most + a)
    before, here = w[s - back : s], w[s : s + b]
    rev = before[::-1]

    def take(start: int, end: int, q: int) -> None:
        if end == s + b < len(w) and w[end] == w[end - q]:
            return  # goes on in the next factor and is found there
        if start == s - back and start > 0 and w[start - 1] == w[start - 1 + q]:
            return  # reaches farther back than a run that ends here can
        if found.get((start, end), q + 1) > q:
            found[start, end] = q

    right = min(most, b)
    if right:
        ahead = extensions(here)
        behind = extensions(rev + [-1] + here[:right][::-1] + rev)
        for q in range(1, right + 1):
            ls, lp = behind[back + 1 + right - q], ahead[q] if q < b else 0
            if ls + lp >= (times - 1) * q:
                take(s - ls, s + q + lp, q)
    left = min(most, back)
    if left:
        ahead = extensions(here + [-1] + before[back - left :] + here)
        behind = extensions(rev)
        for q in range(1, left + 1):
            ls, lp = behind[q] if q < back else 0, ahead[b + 1 + left - q]
            if ls + lp >= (times - 1) * q:
                take(s - q - ls, s + lp, q)


def runs(w: list[int], times: int = 4, least: int = 6) -> list[Run]:
    """Start, length and smallest period of all runs with ``times`` (2 or more) periods and ``least`` words at least, in order."""
    by_start: dict[int, dict[int, int]] = {}
    starts: list[int] = []

    def put(start: int, end: int, q: int) -> None:
        if end - start < least or end - start < times * q:
            return
        if start not in by_start:
            by_start[start] = {}
            insort(starts, start)
        if by_start[start].get(end, q + 1) > q:
            by_start[start][end] = q

    a = 0
    for s, b, old in [*factors(w), (len(w), 0, -1)]:
        found: dict[tuple[int, int], int] = {}
        _at_border(w, s, a, b, times, found)
        for (start, end), q in found.items():
            put(start, end, q)
        if old >= 0 and b > 2:
            at = bisect_right(starts, old)
            while at < len(starts) and starts[at] < old + b - 1:
                for end, q in list(by_start[starts[at]].items()):
                    if end < old + b:
                        put(starts[at] + s - old, end + s - old, q)
                at += 1
        a = b
    return [(start, end - start, q) for start in starts for end, q in sorted(by_start[start].items(), key=lambda x: x[1])]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def in_fours(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in four words that occur more than once in the same text; texts follow each other in ``codes``."""
    held = np.zeros(len(codes), bool)
    if len(codes) < 5:
        return held
    h = _mix(codes.astype(np.uint64) + np.uint64(1))
    key = h[:-3]
    for k in (1, 2, 3):
        key = _mix(key * np.uint64(3) + h[k : len(codes) - 3 + k])
    key = _mix(key + text[:-3].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= text[:-3] == text[3:]
    for k in range(4):
        held[k : len(held) - 3 + k] |= again
    return held


def runs_of_texts(texts: list[list], times: int = 4, least: int = 6) -> list[list[Run]]:
    """The runs of each list of words."""
    ids: dict = {}
    codes = [[ids.setdefault(x, len(ids)) for x in t] for t in texts]
    out: list[list[Run]] = [[] for _ in texts]
    if times >= 4 and least >= 6:
        flat = np.fromiter((c for t in codes for c in t), np.int64, sum(map(len, codes)))
        sizes = np.array([len(t) for t in codes], np.int64)
        text = np.repeat(np.arange(len(codes)), sizes)
        first = np.cumsum(sizes) - sizes
        held = in_fours(flat, text)
        at = np.flatnonzero(held)
        cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) > 0)) + 1 if len(at) else []
        for piece in np.split(at, cuts) if len(at) else []:
            if len(piece) >= least:
                t = int(text[piece[0]])
                shift = int(piece[0] - first[t])
                out[t] += [(s + shift, n, q) for s, n, q in runs(codes[t][shift : shift + len(piece)], times, least)]
    else:
        for t, c in enumerate(codes):
            out[t] = runs(c, times, least)
    return out


def collapse(words: list, found: list[Run]) -> list:
    """The words that no run holds after its first period."""
    gone: list[tuple[int, int]] = sorted((s + q, s + n) for s, n, q in found)
    out, at = [], 0
    for lo, hi in gone:
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:] if gone else words


def find_runs(docs: DataFrame, *keep: str, text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """The columns ``keep`` with runs (start in words from 0, length, period; by start, then period) and the collapsed text.

    Runs have ``times`` periods (2 or more) and ``least`` words at least.
    collapsed joins by one space the words that no run holds after its first
    period. A null or empty text has no words: no runs, an empty collapsed text.
    """

    def rows(x: dict) -> dict:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in x[text]]
        found = runs_of_texts(words, times, least)
        return {
            **{c: x[c] for c in keep},
            "runs": [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found],
            "collapsed": [b" ".join(collapse(w, f)).decode("utf-8", "surrogatepass") for w, f in zip(words, found)],
        }

    types = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, text]))
    made = "`runs` array<struct<start:bigint,length:bigint,period:bigint>>, `collapsed` string"
    return map_batches(docs.select(*cols), rows, ", ".join([*(f"`{c}` {types[c]}" for c in keep), made]))


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text of which, for one id in ten, the words from some place on repeat the first few of them; a null id or text stays as it is."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACES), lambda x: x != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def longest(runs: Column) -> Column:
    """Of the runs that with the greatest exact length / period, then the smallest start, then period; null if there is none."""

    def better(a: Column, b: Column) -> Column:
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(a.isNull() | (left > right) | ((left == right) & (b["start"] == a["start"]) & (b["period"] < a["period"])), b).otherwise(a)

    return F.aggregate(runs, F.expr("CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)"), better)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every whole text of documents, with the digest of all runs and of the text without their repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs, "doc_id").withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
