"""Personal data by a skip-chain conditional random field over candidate spans.

Base spans (email, ip, card, phone) come from fixed patterns, found in linear
time. Candidates are those and weaker look-alikes: digit groups without a plus
sign, failing checksums, addresses without a top-level domain. The field of a
document joins neighbouring candidates in a chain, and each candidate to the
next one with the same or a similar value (same digits, or same last nine, or
same mail name) wherever it stands: the skip edges. Loopy sum-product messages
then decide all labels of a document together. Base spans keep their label;
other candidates that end up probable enough become spans too.

The potentials are trained piecewise from counts over all documents: features
against labels with the plus sign, the checksum and the domain hidden, labels of
chain neighbours, and agreement across skip edges.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_batches, share

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])+")
_LOOSE_MAIL = re.compile(r"@[A-Za-z0-9-]+")
_CUE = re.compile(r"([^\W\d_]+)[^\w+@]*\Z")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of mail-name characters that ends at ``at`` begins, not before ``least``."""
    lo = at
    while lo > least:
        near = max(least, lo - 64)
        m = _LOCAL_END.search(text, near, lo)
        if not m:
            break
        lo = m.start()
        if lo > near:
            break
    return lo


def emails(text: str) -> list[Span]:
    """Leftmost matches; from each @ outwards, so that long words cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = _local_start(text, at, done)
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            done = m.end()
            out.append(("email", lo, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, ordered by kind and start; failing matches are dropped, not retried."""
    out = emails(text) if "@" in text else []
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if not runs:
        return out
    i = 0
    while i + 3 < len(runs):
        if all(runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == "." for j in range(i, i + 3)):
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in runs[i : i + 4]):
                out.append(("ip", runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Candidate:
    __slots__ = ("start", "end", "label", "value", "tail", "features")

    def __init__(self, text: str, start: int, end: int, label: str):
        self.start, self.end, self.label = start, end, label
        raw = text[start:end]
        if "@" in raw:
            self.value, self.tail = raw.lower(), "@" + raw.split("@")[0].lower()
            shape = ["mail"]
        else:
            digits = "".join(c for c in raw if "0" <= c <= "9")
            self.value, self.tail = digits, digits[-9:] if len(digits) >= 9 else ""
            marks = "".join(sorted({c for c in raw.lstrip("+") if not c.isdigit()}))
            parts = [len(x) for x in _DIGITS.findall(raw)]
            shape = [f"n{min(len(digits), 24)}", f"m{marks}", f"p{min(len(parts), 6)}", f"q{min(max(parts), 8)}"]
        cue = _CUE.search(text, max(0, start - 32), start)
        # cue words share 256 slots, so that the count table stays bounded
        slot = int.from_bytes(hashlib.blake2b(cue[1].lower().encode(), digest_size=1).digest(), "big") if cue else "-"
        self.features = [*shape, f"c{slot}"]


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Base spans and look-alikes that do not overlap them, by start; of overlapping base spans all stay."""
    out = [Candidate(text, s, e, k) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    free = lambda s, e: not any(a < e and s < b for a, b in taken[max(0, np.searchsorted(starts, s) - 3) : np.searchsorted(starts, e) + 1])
    starts = np.array([s for s, _ in taken])
    for m in _GROUP.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 7 and free(*m.span()):
            out.append(Candidate(text, *m.span(), ""))
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            lo = _local_start(text, at, 0)
            m = _LOOSE_MAIL.match(text, at)
            if m and lo < at and free(lo, m.end()):
                out.append(Candidate(text, lo, m.end(), ""))
            at = text.find("@", at + 1)
    return sorted(out, key=lambda c: (c.start, c.end))


def skip_edges(nodes: list[Candidate]) -> list[tuple[int, int]]:
    """Each candidate and the next one of the same or a similar value: a number of edges linear in the candidates."""
    last: dict[str, int] = {}
    out = set()
    for i, c in enumerate(nodes):
        for key in {c.value, c.tail} - {""}:
            if key in last:
                out.add((last[key], i))
            last[key] = i
    return sorted(out)


class Field:
    """Log potentials of the field, from counts; one small table."""

    def __init__(self, counts: dict[str, int]):
        label = np.array([counts.get(f"l|{x}", 0) + 1.0 for x in LABELS])
        self.prior = np.log(label / label.sum())
        names = sorted({k.split("|")[1] for k in counts if k.startswith("f|")})
        self.feature = {n: np.log(np.array([(counts.get(f"f|{n}|{x}", 0) + 0.5) / (m + 40) for x, m in zip(LABELS, label)])) for n in names}
        pair = np.array([[counts.get(f"t|{a}|{b}", 0) + 1.0 for b in LABELS] for a in LABELS])
        self.chain = np.log(pair / pair.sum() / np.outer(pair.sum(1) / pair.sum(), pair.sum(0) / pair.sum()))
        agree = math.log((counts.get("s|same", 0) + 4.0) / (counts.get("s|other", 0) + 1.0))
        self.skip = np.eye(len(LABELS)) * min(max(agree, 1.0), 5.0)

    def node(self, c: Candidate) -> np.ndarray:
        out = self.prior.copy()
        if c.label:
            out += np.where(np.array(LABELS) == c.label, 0.0, -40.0)
        for f in c.features:
            if f in self.feature:
                out += self.feature[f]
        # only what could be of a kind: letters for mail, digits for the rest
        mail = c.features[0] == "mail"
        return out + np.array([0.0, 0.0 if mail else -40.0, *([-40.0 if mail else 0.0] * 3)])


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product in logs, until messages settle: label probabilities of each node; ``pair[e, x, y]`` belongs to edge (u, v).

    Messages that swing are damped more and more from round 200 on, so that they settle too.
    """
    soft = lambda x: x - np.logaddexp.reduce(x, axis=-1, keepdims=True)
    if not len(edges):
        return np.exp(soft(unary))
    u, v = edges[:, 0], edges[:, 1]
    src, dst = np.concatenate([u, v]), np.concatenate([v, u])
    both = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
    msg = np.zeros((len(src), unary.shape[1]))
    for r in count() if rounds is None else range(rounds):
        total = unary.copy()
        np.add.at(total, dst, msg)
        new = soft(np.logaddexp.reduce((total[src] - msg[back])[:, :, None] + both, axis=1))
        step = 0.7 * min(1.0, 0.99 ** (r - 200))
        moved = np.abs(new - msg).max()
        if moved < 1e-4 or moved * step < 1e-7:
            msg = new if moved < 1e-4 else msg
            break
        msg = (1 - step) * msg + step * new
    total = unary.copy()
    np.add.at(total, dst, msg)
    return np.exp(soft(total))


def find(texts: list[str | None], field: Field, least: float = 0.9) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text; the fields of all texts are solved side by side."""
    base = [base_spans(t or "") for t in texts]
    unary, edges, pair, owner = [], [], [], []
    for i, (t, b) in enumerate(zip(texts, base)):
        if not t or not _DIGITS.search(t) and "@" not in t:
            continue
        nodes = candidates(t, b)
        if all(c.label for c in nodes):
            continue
        at = len(unary)
        unary += [field.node(c) for c in nodes]
        owner += [(i, c) for c in nodes]
        near = [(k, k + 1) for k in range(len(nodes) - 1)]
        skip = skip_edges(nodes)
        edges += [(at + a, at + b) for a, b in near + skip]
        pair += [field.chain] * len(near) + [field.skip] * len(skip)
    full = [list(b) for b in base]
    if unary:
        p = beliefs(np.array(unary), np.array(edges, np.int64).reshape(-1, 2), np.array(pair).reshape(-1, len(LABELS), len(LABELS)))
        best, sure = p.argmax(1), p.max(1)
        for (i, c), k, s in zip(owner, best, sure):
            if not c.label and k and s >= least:
                full[i].append((LABELS[k], c.start, c.end))
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, [sorted(x, key=lambda s: (rank[s[0]], s[1], s[2])) for x in full]


def _count(texts: list[str | None]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        if not t or not _DIGITS.search(t) and "@" not in t:
            continue
        nodes = candidates(t, base_spans(t))
        of = [c.label or "none" for c in nodes]
        skip = skip_edges(nodes)
        # a look-alike that a skip edge ties to a base span is unlabelled rather than "none"
        open_ = {i for a, b in skip if (of[a] == "none") != (of[b] == "none") for i in (a, b) if of[i] == "none"}
        for i, (c, x) in enumerate(zip(nodes, of)):
            if i not in open_:
                out[f"l|{x}"] += 1
                for f in c.features:
                    out[f"f|{f}|{x}"] += 1
        for i in range(len(of) - 1):
            if i not in open_ and i + 1 not in open_:
                out[f"t|{of[i]}|{of[i + 1]}"] += 1
        for a, b in skip:
            if of[a] != "none" and of[b] != "none":
                out["s|same" if of[a] == of[b] else "s|other"] += 1
    return out


def train(docs: DataFrame) -> Field:
    """Counts over all texts; features come from a fixed set of about 400 names, so what reaches the driver is bounded."""

    def rows(x: dict) -> dict:
        got = _count(x["text"])
        return {"k": list(got), "n": list(got.values())}

    counts = map_batches(docs.select(F.col("text").cast("string")), rows, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return Field({r.k: r.n for r in counts.collect()})


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, field: Field, *keep: str, text: str = "text", redact: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans.

    Offsets are code points, ends exclusive. A null text counts as empty: no
    spans, the hash of the empty string. With ``redact`` a column redacted has
    the text with each span as <KIND>, of overlapping spans the union.
    """
    shared = share(docs.sparkSession, field)

    def rows(x: dict) -> dict:
        base, full = find(x[text], shared())
        out = {c: x[c] for c in keep}
        for k in KINDS:
            out[f"n_{k}"] = [sum(s[0] == k for s in b) for b in base]
        out["base_sha256"] = [hashlib.sha256(digest(b).encode()).hexdigest() for b in base]
        out["spans"] = [digest(f) for f in full]
        if redact:
            out["redacted"] = [replace(t, f) for t, f in zip(x[text], full)]
        return out

    types = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, text]))
    made = ["n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", *["redacted string"] * redact]
    return map_batches(docs.select(*cols), rows, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *made]))


def replace(text: str | None, spans: list[Span]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, train(docs), "doc_id")
