"""Benchmark decontamination by template canonicalisation.

Texts become templates: lower-cased words, with numbers, units after numbers and
names as typed placeholders. Windows of the templates are hash-joined with those
of the benchmark items. A document and an item are a pair if enough windows of
the item occur in the document and the values in the slots map onto each other
consistently, one value to one value, over the document or over one occurrence:
so a question whose numbers or names were exchanged is found, and a text that
only looks alike is not. Windows are also taken with names left as words, so
that a copy in other case is found.

A capital at the start of a sentence is no name in these windows. An item that
has too few of them without such words (its sentences begin with names) is
indexed by a third form too, where they are names: slot consistency tells.

An item whose template has no window with words enough is indexed by windows
that go on to their fifth word, and an item without any of these by windows of
the values themselves, which find exact copies, and, if it has numbers and signs
of arithmetic, by windows in which the signs are words: of these 0.8 must occur
and all slots must map. An item of fewer than SHORTEST
symbols is found in documents that hold nothing else. In scripts that put no
space between words every letter is a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, slices

#: Symbols of a window; words among them at least; symbols of the shortest item that is searched within texts.
WINDOW, WORDS, SHORTEST = 8, 5, 4
#: Windows that an item needs in a document: these many, or this share if it has fewer.
NEED, SHARE, CONSISTENT = 6, 0.5, 0.75
#: Share of the windows with signs of arithmetic that an item needs.
SIGNS_SHARE = 0.8
#: Tokens by which neighbouring windows of one occurrence may shift against the item, where a name has more or fewer words.
SHIFT = 4
#: So many bytes of benchmark windows may be broadcast; beyond it everything goes through the shuffle join.
BROADCAST_BYTES = 48 << 20
#: Tokens that a worker remembers.
REMEMBERED = 150_000

# fixed values: unit and number words
UNITS = frozenset("mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph hz khz mhz ghz kb mb gb tb degree degrees".split())
NUMBERS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())

# fixed values: blocks of scripts without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han)
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|[{_DENSE}]|[^\W\d_{_DENSE}]+|[.!?\n\u3002\uff01\uff1f]")
#: Signs of arithmetic that touch no letter are tokens too.
SIGNED = re.compile(TOKEN.pattern + r"|(?<![^\W\d_])[-+*/=×÷^%<>](?![^\W\d_])")
STOPS = ".!?\n\u3002\uff01\uff1f"
WORD, NUM, UNIT, NAME, STOP, HEAD = range(6)
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOT = np.array([0, 0xA5A5_0001_1357_9BDF, 0xA5A5_0002_2468_ACE1, 0xA5A5_0003_369C_F135, 0, 0], np.uint64)


class Vocabulary(dict):
    """Token to number; classes and hashes by number."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.digest = xxh64_intdigest
        self.kind: list[int] = []
        self.hash: list[int] = []
        self.known = np.empty(0, np.int8), np.empty(0, np.uint64)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Classes and hashes; only what is new since the last call is converted."""
        n = len(self.known[0])
        if n < len(self.kind):
            self.known = np.concatenate((self.known[0], np.array(self.kind[n:], np.int8))), np.concatenate((self.known[1], np.array(self.hash[n:], np.uint64)))
        return self.known

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in STOPS:
            kind = STOP
        elif token[0].isdigit() or low in NUMBERS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif token[0].isupper() and not (len(token) > 1 and token.isupper()):
            kind = NAME
        else:
            kind = WORD
        self[token] = n = len(self.kind)
        self.kind.append(kind)
        self.hash.append(self.digest(low.encode("utf-8", "surrogatepass"), 7))
        return n


def tokens(texts: list[str | None], vocabulary: Vocabulary, pattern: re.Pattern = TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts one after another: text number, kind and value hash of each token, ends of sentences included.

    A word with a capital is a NAME, at the start of a sentence a HEAD.
    """
    ids, lengths = [], []
    look = vocabulary.__getitem__
    for t in texts:
        got = list(map(look, pattern.findall(t))) if t else []
        ids += got
        lengths.append(len(got))
    text = np.repeat(np.arange(len(texts)), lengths)
    if not ids:
        return text, np.empty(0, np.int8), np.empty(0, np.uint64)
    at = np.array(ids, np.int64)
    kind, value = (x[at] for x in vocabulary.arrays())
    new = np.concatenate(([True], text[1:] != text[:-1]))
    after = np.concatenate(([WORD], kind[:-1]))
    # a unit stands after a number
    kind = np.where((kind == NAME) & (new | (after == STOP)), HEAD, kind)
    kind = np.where((kind == UNIT) & (new | (after != NUM)), WORD, kind)
    return text, kind, value


def template(text: np.ndarray, kind: np.ndarray, value: np.ndarray, names: bool = True, heads: bool = False) -> tuple[np.ndarray, ...]:
    """text number, symbol, kind, value and token number of each symbol; without ``names`` they count as words, with ``heads`` first words of sentences as names."""
    at = np.arange(len(kind))
    kind = np.where(kind == HEAD, NAME if heads else WORD, kind)
    if names and len(kind):
        # a name of several words is one symbol
        again = (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1])
        at = np.flatnonzero(np.concatenate(([True], ~again)))
        value = np.add.reduceat(value, at)
        text, kind = text[at], kind[at]
    full = kind != STOP
    text, kind, value, at = text[full], kind[full], value[full], at[full]
    if not names:
        kind = np.where(kind == NAME, WORD, kind)
    return text, np.where(kind == WORD, value, SLOT[kind]), kind, value, at


def windows(text: np.ndarray, symbol: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``size`` symbols that lies in one text and has words enough."""
    n = len(symbol) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        h = h * MIX + symbol[j : j + n]
        h ^= h >> np.uint64(29)
    words = np.concatenate(([0], np.cumsum(kind == WORD)))
    ok = (text[:n] == text[size - 1 :]) & (words[size:] - words[:-size] >= min(WORDS, size - 1))
    at = np.flatnonzero(ok)
    return at, h[at]


def long_windows(text: np.ndarray, symbol: np.ndarray, kind: np.ndarray, all_starts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and length of each window that needs more than WINDOW symbols for its WORDS words and ends at the last of them.

    With ``all_starts`` also windows of WINDOW symbols with words enough: one from each symbol.
    """
    words = np.flatnonzero(kind == WORD)
    at = np.arange(len(kind))
    nth = np.searchsorted(words, at) + WORDS - 1
    at, nth = at[nth < len(words)], nth[nth < len(words)]
    end = words[nth]
    if all_starts:
        end = np.maximum(end, at + WINDOW - 1)
        ok = end < len(text)
        at, end = at[ok], end[ok]
    ok = ((end - at >= WINDOW) | all_starts) & (text[at] == text[end])
    at, size = at[ok], (end - at + 1)[ok]
    # a polynomial from prefix sums; the factor is odd, so its powers can be divided by
    grow = np.concatenate((np.ones(1, np.uint64), np.full(len(symbol), MIX, np.uint64))).cumprod(dtype=np.uint64)
    shrink = np.concatenate((np.ones(1, np.uint64), np.full(len(symbol), pow(int(MIX), -1, 1 << 64), np.uint64))).cumprod(dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbol * grow[:-1], dtype=np.uint64)))
    h = (total[at + size] - total[at]) * shrink[at] + size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return at, h ^ (h >> np.uint64(29)), size


def literal_windows(text: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``size`` values."""
    return windows(text, value ^ MIX, np.full(len(text), WORD), size)


def only(text: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each text that has ``size`` values and no more."""
    at, h = literal_windows(text, value, size)
    if len(at):
        whole = np.bincount(text)[text[at]] == size
        at, h = at[whole], h[whole]
    return at, h


def _matches(docs: DataFrame, sizes: list[tuple[str, int]], known: np.ndarray | None) -> DataFrame:
    """(doc_id, tie, at, h, values): windows of the documents and their token numbers, those in ``known`` if it is given."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(known) if known is not None else None
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.int64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        filt, listed = None, None
        if shared is not None:
            listed = shared.value
            filt = np.zeros(1 << 22, bool)
            filt[(listed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        vocabulary = Vocabulary()
        for batch in batches:
            for part in slices(batch):
                if len(vocabulary) > REMEMBERED:
                    vocabulary = Vocabulary()
                found = tokens(part.column("text").to_pylist(), vocabulary)
                signed = tokens(part.column("text").to_pylist(), vocabulary, SIGNED) if ("signs", 0) in sizes else None
                for (mode, size), names in product(sizes, (True, False)):
                    # only plain windows are taken both ways
                    if mode in ("long", "heads", "signs") and not names or mode in ("literal", "only") and names:
                        continue
                    read = signed if mode == "signs" else found
                    begin = np.searchsorted(read[0], np.arange(part.num_rows))
                    text, symbol, kind, value, place = template(*read, names, mode in ("heads", "signs"))
                    lengths = None
                    if mode in ("long", "heads", "signs"):
                        at, h, lengths = long_windows(text, symbol, kind, mode != "long")
                    elif mode == "literal":
                        at, h = literal_windows(text, value, size)
                    elif mode == "only":
                        at, h = only(text, value, size)
                    else:
                        at, h = windows(text, symbol, kind, size)
                    if mode == "plain" and not names:
                        # windows without a name are those of the first pass
                        named = np.concatenate(([0], np.cumsum(found[1] == NAME)))
                        own = named[place[at + size - 1] + 1] > named[place[at]]
                        at, h = at[own], h[own]
                    if filt is not None:
                        near = filt[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
                        at, h, lengths = at[near], h[near], lengths if lengths is None else lengths[near]
                        near = np.searchsorted(listed, h)
                        real = listed[np.minimum(near, len(listed) - 1)] == h if len(listed) else np.zeros(len(h), bool)
                        at, h, lengths = at[real], h[real], lengths if lengths is None else lengths[real]
                    for lo in range(0, len(at), 1 << 16):
                        a, g = at[lo : lo + (1 << 16)], h[lo : lo + (1 << 16)]
                        of = pa.array(text[a])
                        if lengths is None:
                            span = a[:, None] + np.arange(size)
                            slot = (kind[span] != WORD) & (mode == "plain")
                            ends = np.concatenate(([0], np.cumsum(slot.sum(1)))).astype(np.int32)
                            slots = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[span][slot].view(np.int64)))
                        else:
                            slots = pa.array([value[i : i + k][kind[i : i + k] != WORD].view(np.int64) for i, k in zip(a, lengths[lo : lo + (1 << 16)])], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("tie").take(of), pa.array(place[a] - begin[text[a]]), pa.array(g.view(np.int64)), slots], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, tie long, at long, h long, slots array<long>")


def _index(benchmark: DataFrame) -> DataFrame:
    """(item_id, mode, size, pos, n_windows, h, values) of all windows; an item shorter than WINDOW is one window of its own size.

    Long windows (size 0) are added where the template has no plain ones, literal
    ones where there are neither, and with these such with signs of arithmetic if
    the item has three numbers. Windows with first words as names (heads) are added
    where fewer plain ones are free of first words than an item needs. Of an item below SHORTEST symbols only
    the whole counts (mode "only").
    """
    schema = pa.schema([("item_id", pa.int64()), ("mode", pa.string()), ("size", pa.int32()), ("pos", pa.int32()), ("n_windows", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.int64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for item, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = tokens([t], vocabulary)
                held: dict[tuple, tuple] = {}
                held_long: dict[tuple, tuple] = {}
                held_literal: dict[tuple, tuple] = {}
                held_more: dict[str, dict[tuple, tuple]] = {"heads": {}, "signs": {}}
                rows_only: list[tuple] = []
                most = free = 0

                def stretch(mode: str, read: tuple) -> None:
                    text, symbol, kind, value, place = template(*read, True, True)
                    at, h, lengths = long_windows(text, symbol, kind, True)
                    for a, g, k in zip(at, h.view(np.int64), lengths):
                        held_more[mode][int(place[a]), int(g)] = (0, [int(x) for x in value[a : a + k][kind[a : a + k] != WORD].view(np.int64)])

                for names in (True, False):
                    text, symbol, kind, value, place = template(*found, names)
                    size = min(WINDOW, len(symbol))
                    if size < SHORTEST:
                        if not names and size:
                            at, h = only(text, value, size)
                            rows_only = [(item, "only", size, 0, 1, int(g), []) for g in h.view(np.int64)]
                        continue
                    at, h = windows(text, symbol, kind, size)
                    most = max(most, len(at))
                    if names:
                        first = np.concatenate(([0], np.cumsum(found[1] == HEAD)))
                        free = int((first[place[at + size - 1] + 1] == first[place[at]]).sum())
                    for a, g in zip(at, h.view(np.int64)):
                        held[int(place[a]), int(g)] = (size, [int(x) for x in value[a : a + size][kind[a : a + size] != WORD].view(np.int64)])
                    if names and not len(at):
                        at, h, lengths = long_windows(text, symbol, kind)
                        for a, g, k in zip(at, h.view(np.int64), lengths):
                            held_long[int(place[a]), int(g)] = (0, [int(x) for x in value[a : a + k][kind[a : a + k] != WORD].view(np.int64)])
                    elif not names and not held and not held_long:
                        at, h = literal_windows(text, value, size)
                        for a, g in zip(at, h.view(np.int64)):
                            held_literal[int(place[a]), int(g)] = (size, [])
                        read = tokens([t], vocabulary, SIGNED)
                        if (read[1] == NUM).sum() >= 3 and len(read[1]) > len(found[1]):
                            stretch("signs", read)
                if (found[1] == HEAD).any() and not rows_only and free < max(1, min(NEED, -(-most // 2))):
                    stretch("heads", found)
                rows = rows_only if not held else []
                rows += [(item, "plain", size, pos, most, g, slots) for (pos, g), (size, slots) in held.items()]
                rows += [(item, "long", size, pos, len(held_long), g, slots) for (pos, g), (size, slots) in held_long.items()]
                rows += [(item, mode, size, pos, len(more), g, slots) for mode, more in held_more.items() for (pos, g), (size, slots) in more.items()]
                rows += [(item, "literal", size, pos, len(held_literal), g, slots) for (pos, g), (size, slots) in held_literal.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), schema.types)], schema=schema)

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "item_id long, mode string, size int, pos int, n_windows int, h long, slots array<long>")


def matched(theirs: list, ours: list) -> float:
    """Of the distinct pairs of values, the share that one value to one value can keep: a largest matching, by augmenting paths."""
    to: dict[int, list[int]] = {}
    for a, b in zip(theirs, ours):
        to.setdefault(a, []).append(b)
    held: dict[int, int] = {}
    fit = 0
    for a in to:
        # breadth first over alternating paths from an item's value, of which there are few
        via: dict[int, int] = {}
        queue, free = [a], None
        while queue and free is None:
            x = queue.pop(0)
            for b in to[x]:
                if b not in via:
                    via[b] = x
                    if b not in held:
                        free = b
                        break
                    queue.append(held[b])
        fit += free is not None
        while free is not None:
            x = via[free]
            before = next((b for b, y in held.items() if y == x), None)
            held[free] = x
            free = before
    return fit / max(1, len(theirs))


def _fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group with windows enough, how many of the item's it has and how well their slots map."""
    # the same item may hold a window more than once; distinct positions are counted
    per = pairs.groupBy(*keys).agg(F.collect_set("pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("z"))).alias("z"))
    need = F.when(F.col("mode") == "signs", F.ceil(F.col("n_windows") * SIGNS_SHARE)).otherwise(F.least(F.lit(NEED), F.ceil(F.col("n_windows") * SHARE)))
    per = per.where(F.size("at") >= need)
    side = lambda name: F.transform("z", lambda x: x[name])
    slots = F.size("z")
    # every value with one partner: nothing to match
    plain = (F.size(F.array_distinct(side("theirs"))) == slots) & (F.size(F.array_distinct(side("slots"))) == slots)

    @F.pandas_udf("double")
    def share(theirs: pd.Series, ours: pd.Series) -> pd.Series:
        return pd.Series([1.0 if a is None else matched(list(a), list(b)) for a, b in zip(theirs, ours)], dtype=float)

    return per.select(
        *[c for c in keys if c != "n_windows"],
        F.col("n_windows").cast("long").alias("n_windows"),
        F.size("at").cast("long").alias("n_matched"),
        (F.size("at") / F.col("n_windows")).alias("coverage"),
        slots.cast("long").alias("n_slots"),
        share(F.when(~plain, side("theirs")), F.when(~plain, side("slots"))).alias("consistency"),
        F.exists("z", lambda x: x["theirs"] != x["slots"]).alias("reparameterised"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document (doc_id, tie = xxhash64 of its text) and benchmark item that it holds.

    Columns: doc_id, item_id, n_windows of the item, n_matched of them, coverage,
    n_slots compared, consistency (share of slot pairs in a largest one-to-one mapping) and
    reparameterised (some value differs); where the occurrences of an item
    contradict each other, the figures are those of the best one. Null and empty texts hold nothing;
    an item without a symbol matches nothing, one of fewer than SHORTEST symbols
    only a document that is nothing else. Repeated rows give
    one row, ties none; extra columns are ignored; empty tables give no rows.
    """
    index = cut(_index(benchmark))
    sizes = sorted(map(tuple, index.select("mode", "size").distinct().collect()))
    few = (index.agg(F.sum(F.size("slots") * 8 + 96)).first()[0] or 0) <= BROADCAST_BYTES
    known = np.sort(np.array([r.h for r in index.select("h").distinct().collect()], np.int64).view(np.uint64)) if few else None
    found = _matches(docs, sizes, known)
    right = index.select(F.col("h").alias("g"), "item_id", "mode", "pos", "n_windows", F.col("slots").alias("theirs"))
    both = found.join(F.broadcast(right) if few else right, F.col("h") == F.col("g"))
    keys = ["doc_id", "tie", "item_id", "mode", "n_windows"]
    pairs = cut(both.select(*keys, "pos", (F.col("at") - F.col("pos")).alias("off"), F.arrays_zip("theirs", "slots").alias("z")))
    whole = cut(_fit(pairs, keys))
    fits = F.col("consistency") >= F.when(F.col("mode") == "signs", 1.0).otherwise(CONSISTENT)
    # several variants in one document contradict each other: each occurrence, windows at one offset, is looked at by itself
    lost = whole.where(~fits).select(*[F.col(c).alias(f"w_{c}") for c in keys[:4]])
    mine = pairs.join(lost, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("tie") == F.col("w_tie")) & F.col("item_id").eqNullSafe(F.col("w_item_id")) & (F.col("mode") == F.col("w_mode")), "left_semi")
    order = Window.partitionBy(*keys).orderBy("off")
    mine = mine.withColumn("new", F.when(F.col("off") - F.lag("off").over(order) > SHIFT, 1).otherwise(0)).withColumn("occurrence", F.sum("new").over(order))
    one = _fit(mine, [*keys, "occurrence"]).where(fits)
    best = one.groupBy(*keys).agg(F.max(F.struct("consistency", "n_matched", "coverage", "n_slots", "reparameterised")).alias("x")).select(*keys, "x.*")
    # an item may have both plain and long windows: plain ones count first
    found = whole.where(fits).unionByName(best)
    columns = ["n_windows", "n_matched", "coverage", "n_slots", "consistency", "reparameterised"]
    return found.groupBy("doc_id", "tie", "item_id").agg(F.max_by(F.struct(*columns), "mode").alias("x")).select("doc_id", "tie", "item_id", "x.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("tie")
