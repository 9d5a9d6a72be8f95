"""Language identification by cross-parsing against suffix automata.

For each learned language a bounded sample of labelled text becomes a suffix
automaton. A text is parsed into phrases, each the longest match that the
automaton still accepts; the language that needs the fewest phrases, normalised
by what one phrase costs to point at (log2 of the reference length), wins.

Texts are lower-cased, and runs without letters become one separator. Long texts
are parsed in pieces side by side, one numpy step for each symbol; a piece goes on
from where the piece before it really ended, so the phrases are those of a parse
from the first symbol to the last.

A text is foreign if its phrases in the winning language, but for FREE of them,
cost over FOREIGN times what spelling its letters one by one by their frequency
does: no learned language explains it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, map_batches, share

#: The training bounds: passages of each language, and characters of a passage.
PASSAGES, CHARS = 50, 600
#: Symbols of a piece, and of the steps after which a piece looks whether it has met its earlier parse; rounds before pieces are parsed one by one.
PIECE, STEP, ROUNDS = 1024, 64, 4
#: Bytes of parsing tables that a worker keeps; beyond them the tables of further languages are made for each batch.
TABLE_BYTES = 128 << 20
WIDTH = 64
#: Random letters cost 1.5 times as much as spelled ones, texts of two languages half and half about as much.
FREE, FOREIGN = 8, 1.25
OTHER, GAP = 0, 1
#: A sample of more letters than WIDTH holds gives symbols of their own to the commonest, the others are spelled in DIGITS symbols of BITS bits.
DIGITS, BITS = 4, 5
COMMON = WIDTH - 2 - (1 << BITS)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start, and every path from it spells a substring."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def symbol_table(texts: list[str]) -> np.ndarray:
    """Code point to symbol: the letters of the sample have their own; if they are too many, rarer ones are spelled from WIDTH on, with their code point."""
    count = Counter(c for t in texts for c in t.lower() if c.isalpha())
    few = len(count) <= WIDTH - 2
    own = {c: i + 2 for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: WIDTH - 2 if few else COMMON])}
    out = np.full(0x110000, GAP, np.uint8 if few else np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            low = low if len(low) == 1 else low[0]
            out[i] = own.get(low, OTHER if few else WIDTH + ord(low))
    return out


def symbols(text: str | None, table: np.ndarray) -> np.ndarray:
    """The symbols of a text, runs of GAP as one; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint8)
    s = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = s == GAP
    if gap.all():
        return np.empty(0, np.uint8)
    s = s[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    if s.dtype == np.uint8:
        return s
    rare = s >= WIDTH
    at = np.cumsum(np.where(rare, DIGITS, 1)) - 1
    out = np.zeros(at[-1] + 1, np.uint8)
    out[at[~rare]] = s[~rare]
    for i in range(DIGITS):
        out[at[rare] - i] = COMMON + 2 + ((s[rare] - WIDTH) >> (BITS * i) & ((1 << BITS) - 1))
    return out


class CrossParser:
    """Languages, their automata as sparse rows, and the symbol table; small enough to broadcast."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.table = symbol_table([t for x in samples.values() for t in x])
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.states: list[int] = []
        self.bits: list[float] = []
        seen = np.ones(WIDTH)
        for lang in self.langs:
            ref = [x for t in samples[lang] for x in (*symbols(t, self.table).tolist(), GAP)]
            seen += np.bincount(ref, minlength=WIDTH)
            step = suffix_automaton(ref)
            flat = [(s, c, to) for s, x in enumerate(step) for c, to in x.items()]
            self.edges.append(tuple(np.array(x, np.int32) for x in zip(*flat)) if flat else (np.empty(0, np.int32),) * 3)
            self.states.append(len(step))
            self.bits.append(math.log2(len(ref) + 2))
        #: what spelling a symbol costs
        self.spell = np.minimum(-np.log2(seen / seen.sum()), math.log2(WIDTH))

    def dense(self, g: int) -> np.ndarray:
        """The table of a language: state * WIDTH + symbol gives next state * WIDTH, odd where a phrase ends. State 0 is the start."""
        s, c, to = self.edges[g]
        n = self.states[g]
        out = np.empty((n, WIDTH), np.int32 if n * WIDTH < 2**31 else np.int64)
        first = np.zeros(WIDTH, np.int64)
        root = s == 0
        first[c[root]] = to[root]
        out[:] = first * WIDTH + 1
        out[s, c] = to.astype(np.int64) * WIDTH
        return out.reshape(-1)

    def phrases(self, texts: list[np.ndarray], dense) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns); ``dense`` gives the table of a language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        lanes = Lanes(texts)
        if len(lanes.owner):
            for g in range(len(self.langs)):
                n = lanes.parse(dense(g))
                out[:, g] = np.bincount(lanes.owner, n + (lanes.before < 0), len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None], dense) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is foreign."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        syms = [symbols(t, self.table) for t in texts]
        many = self.phrases(syms, dense)
        cost = many * np.array(self.bits)
        best = cost.argmin(1)
        lead = np.exp2(np.clip(cost.min(1, keepdims=True) - cost, -1000, 0))
        score = 1 / lead.sum(1)
        none = [not len(s) for s in syms]
        spelled = np.array([np.bincount(s, minlength=WIDTH) @ self.spell for s in syms])
        foreign = cost.min(1) - FREE * np.array(self.bits)[best] > FOREIGN * spelled
        lang = ["und" if x else self.langs[b] for x, b in zip(none, best)]
        return lang, [0.0 if x else float(s) for x, s in zip(none, score)], [bool(f) and not x for x, f in zip(none, foreign)]


class Lanes:
    """The pieces of texts, the longest first, parsed side by side."""

    def __init__(self, texts: list[np.ndarray]):
        owner, pieces, before = [], [], []
        for i, s in enumerate(texts):
            if len(s):
                for k, p in enumerate(np.array_split(s, -(-len(s) // PIECE))):
                    before.append(len(pieces) - 1 if k else -1)
                    owner.append(i)
                    pieces.append(p)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-size, kind="stable")
        spot = np.empty(len(order) + 1, np.int64)
        spot[order], spot[-1] = np.arange(len(order)), -1
        self.owner, self.size = np.array(owner, np.int64)[order], size[order]
        #: the piece before, -1 at the head of a text, and the piece after
        self.before = spot[np.array(before, np.int64)[order]] if len(order) else np.empty(0, np.int64)
        self.after = np.full(len(order), -1)
        self.after[self.before[self.before >= 0]] = np.flatnonzero(self.before >= 0)
        self.grid = np.zeros((int(size.max(initial=0)), len(pieces)), np.uint8)
        for lane, at in enumerate(order):
            self.grid[: self.size[lane], lane] = pieces[at]

    def parse(self, table: np.ndarray) -> np.ndarray:
        """Phrases that end in each piece."""
        n = len(self.size)
        marks = -(-len(self.grid) // STEP)
        begin, end, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        state, ends = np.zeros((marks, n), np.int64), np.zeros((marks, n), np.int64)
        todo = np.arange(n)
        for again in range(ROUNDS):
            old = end[todo]
            self._run(table, todo, begin, end, count, state, ends, bool(again))
            moved = todo if not again else todo[end[todo] != old]
            todo = self.after[moved]
            todo = np.sort(todo[todo >= 0])
            todo = todo[begin[todo] != end[self.before[todo]]]
            if not len(todo):
                return count
            begin[todo] = end[self.before[todo]]
        # texts whose pieces never meet their earlier parse, such as long repetitions: one after another
        look = memoryview(table)
        while len(todo):
            lane = int(todo[0])
            todo = todo[1:]
            while lane >= 0:
                v, m = int(begin[lane]), 0
                for c in self.grid[: self.size[lane], lane].tolist():
                    v = look[(v & -2) + c]
                    m += v & 1
                count[lane], end[lane] = m, v & -2
                lane = int(self.after[lane])
                if lane < 0 or begin[lane] == end[self.before[lane]]:
                    break
                begin[lane] = end[self.before[lane]]
                todo = todo[todo != lane]
        return count

    def _run(self, table, which, begin, end, count, state, ends, again) -> None:
        """Parses pieces from their begin; with ``again`` no further than to where the state is that of the round before."""
        v, n, j = begin[which], np.zeros(len(which), np.int64), 0
        while len(which):
            size = self.size[which]
            stop = min(j + STEP, int(size[0]))
            live = len(which) - np.searchsorted(size[::-1], np.arange(j, stop), side="right")
            part = self.grid[j:stop][:, which]
            for row, a in zip(part, live):
                w = v[:a]
                np.bitwise_and(w, -2, out=w)
                w += row[:a]
                w[:] = table[w]
                n[:a] += w & 1
            j = stop
            done = size <= j
            end[which[done]], count[which[done]] = v[done] & -2, n[done]
            which, v, n = which[~done], v[~done], n[~done]
            k = j // STEP
            if again and len(which):
                met = state[k, which] == v & -2
                shift = n[met] - ends[k, which[met]]
                ends[k:, which[met]] += shift
                count[which[met]] += shift
                which, v, n = which[~met], v[~met], n[~met]
            if len(which):
                state[k, which], ends[k, which] = v & -2, n


def train(labelled: DataFrame) -> CrossParser:
    """From (text, lang): PASSAGES distinct passages of each language at most, whatever the table's size.

    All texts are cut into passages of CHARS characters from end to end, and those
    with the smallest hashes are taken, so that every part of every text has the
    same chance and a repeated passage counts once. They are thinned by hash to
    about four times as many before anything is shuffled, so that a language with
    most of the rows is never gathered in one task.
    """
    have = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    cuts = have.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))).alias("part")).where(F.col("part").rlike(r"\p{L}"))
    cuts = cuts.withColumn("h", F.xxhash64("part").bitwiseAND((1 << 62) - 1))
    per = cut(cuts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    limit = per.select(F.col("lang").alias("of"), F.when(F.col("n") <= 4 * PASSAGES, F.lit(1 << 62)).otherwise((F.lit(float(4 * PASSAGES << 62)) / F.col("n")).cast("long")).alias("limit"))
    thin = cuts.join(limit, F.expr("lang = of AND h <= limit")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    samples: dict[str, list[str]] = {}
    for r in thin.withColumn("r", rank).where(F.col("r") <= PASSAGES).orderBy("lang", "h").collect():
        samples.setdefault(r.lang, []).append(r.part)
    return CrossParser(samples)


def identify(docs: DataFrame, model: CrossParser, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and foreign, for the column ``text``.

    Null texts and texts without a letter are ``und`` with score 0; so are all
    texts if nothing was learned. Repeated rows stay; clashing extra columns do
    not matter, for only ``keep`` is carried along.
    """
    shared = share(docs.sparkSession, model)
    made: dict[int, np.ndarray] = {}

    def dense(g: int) -> np.ndarray:
        if g in made:
            return made[g]
        t = shared().dense(g)
        if sum(x.nbytes for x in made.values()) + t.nbytes <= TABLE_BYTES:
            made[g] = t
        return t

    def rows(x: dict) -> dict:
        lang, score, foreign = shared().predict(x[text], dense)
        return {c: x[c] for c in keep} | {"lang_pred": lang, "score": score, "foreign": foreign}

    types = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, text]))
    return map_batches(docs.select(*cols), rows, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string, score double, foreign boolean"]))


HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)"


def op3_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(F.col("doc_id").isNotNull()).where(f"NOT {HELD_OUT}").select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model, "doc_id")
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "foreign")
