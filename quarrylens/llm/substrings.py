"""Removal of long repeated byte strings with sharded suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere
else. Windows are dealt to shards by content: the least hashed ``GRAM``-gram of
a window (leftmost of equals) is its anchor, the same wherever the window
stands. Neighbouring windows with one anchor form a strip. Only strips whose
anchor occurs twice can hold repeats:

* strips that are equal in full are repeats in full;
* of unequal strips with one anchor, each distinct one is fetched once. Shards
  of strips get suffix arrays (Larsson-Sadakane refinement: groups of equal
  prefixes split by the rank at twice the depth) and common prefix lengths
  (Kasai's scan, all strips of a shard side by side). A window repeats if it
  shares ``WINDOW`` bytes with a neighbour in the array;
* an anchor with very many distinct strips is split over shards, and the sorted
  window keys of those are merged across shards by binary search. Each shard
  sends a key once, so that a common passage gathers no more rows than shards.

Texts travel compressed, and only to rows that need them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, slices

WINDOW, GRAM = 200, 32
#: Bytes of text handled at once; bytes of a shard; strips of one anchor in a shard.
CHUNK, SHARD, STRIPS = 128 << 10, 1 << 20, 4096
#: Spans that are merged at once.
SPANS = 1 << 18
POS_BITS = 23
BASE = 0x9E3779B97F4A7C55
NONE = -(1 << 63)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


_KNOWN: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers; a task keeps the most that it has needed."""
    if len(_KNOWN.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        p[0] = 1
        _KNOWN[base] = np.multiply.accumulate(p)
    return _KNOWN[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end], from sums of byte values times powers."""
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _powers(len(raw), BASE), dtype=np.uint64)))
    back = _powers(len(raw) + 1, pow(BASE, -1, 1 << 64))
    return _mix((pre[end] - pre[start]) * back[start] + (end - start).astype(np.uint64))


def strips(raw: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor hash and content hash of each strip in texts that stand one after another in ``raw``."""
    n = len(raw)
    begins = np.concatenate(([0], ends[:-1]))
    count = np.maximum(ends - begins - window + 1, 0)
    if n < window or not count.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    h, size = _BYTES[raw], 1
    while size * 2 <= gram:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    if size < gram:
        h = h[: len(h) - gram + size] * _power(gram - size) + h[gram - size :]
    h = _mix(h)
    low = np.uint64((1 << POS_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - width + have], least[width - have :])
    starts = np.repeat(begins - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    anchor = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    many = np.diff(np.concatenate((first, [len(anchor)])))
    s = starts[first]
    return s, many, h[anchor[first]], span_hashes(raw, s, s + many + window - 1)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of bytes; a suffix that ends comes before those that go on.

    Groups of suffixes with equal first ``h`` bytes hold the rank of their first;
    each round sorts only groups of two and more, by the rank ``h`` on.
    """
    n, h = len(symbols), 8
    padded = np.concatenate((symbols, np.zeros(h, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = key << np.uint64(8) | padded[j : j + n]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    todo, key = np.arange(n), key[sa]
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(new, todo, 0))
        rank[sa[todo]] = group
        alone = new & np.concatenate((new[1:], [True]))
        todo = todo[~alone]
        if not len(todo):
            return sa, rank
        at = sa[todo]
        # beyond the end the shorter suffix comes first
        over = at + h - n
        key = (rank[at] << 32) + np.where(over < 0, rank[np.minimum(at + h, n - 1)], -1 - over)
        order = np.argsort(key)
        sa[todo], key = at[order], key[order]
        h *= 2


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """For each suffix its common prefix with the one before it in the array, ``most`` and its string's length at most: Kasai's scan, strips side by side."""
    out = np.zeros(len(symbols), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    have = np.zeros(len(starts), np.int64)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -j, side="left"))
        at = starts[:live] + j
        before = sa[np.maximum(rank[at] - 1, 0)]
        n = np.maximum(have[:live] - 1, 0)
        n[rank[at] == 0] = 0
        going = np.flatnonzero(rank[at] > 0)
        while len(going):
            mine = symbols[at[going] + n[going]]
            # a string's end is no part of a prefix
            same = (n[going] < most) & (mine != 0) & (mine == symbols[before[going] + n[going]])
            going = going[same]
            n[going] += 1
        have[:live] = n
        out[at] = n
    return out


def repeats(parts: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Over the windows of all strings one after another: whether the window occurs elsewhere among them."""
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    # 0 ends each string; UTF-8 has no byte above 244, so that all others can move up by one
    symbols = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
    sa, rank = suffix_array(symbols)
    shared = common_prefixes(symbols, starts, size, sa, rank, window)
    after = np.concatenate((shared[sa[1:]], [0]))
    twice = (shared >= window) | (after[rank] >= window)
    count = np.maximum(size - window + 1, 0)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return twice[at]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, ends exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _key(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find_strips(docs: DataFrame) -> DataFrame:
    """(k, doc_id, anchor, digest, s, n): the strips of all texts; k is from the text's SHA-256."""
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])

    def flush(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        ends = np.cumsum([len(x[3]) for x in held])
        s, n, anchor, digest = strips(raw, ends)
        of = np.searchsorted(ends, s, side="right")
        offset = np.array([x[2] for x in held], np.int64) - np.concatenate(([0], ends[:-1]))
        cols = [np.array([x[0] for x in held], np.int64)[of], np.array([x[1] for x in held], np.int64)[of], anchor.view(np.int64), digest.view(np.int64), s + offset[of], n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = _bytes(text)
                    if len(raw) < WINDOW:
                        continue
                    k = _key(raw)
                    # very long texts in pieces, each with the bytes that its last windows reach
                    for lo in range(0, len(raw) - WINDOW + 1, CHUNK):
                        piece = raw[lo : lo + CHUNK + WINDOW - 1]
                        held.append((k, doc, lo, piece))
                        total += len(piece)
                        if total >= CHUNK:
                            yield flush(held)
                            held, total = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "k long, doc_id long, anchor long, digest long, s long, n int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(k, doc_id, n_bytes, z): texts as compressed bytes."""
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("z", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for part in slices(batch):
                raw = [_bytes(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_key(r) for r in raw], pa.int64()), part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw])], schema=schema)

    return docs.mapInArrow(run, "k long, doc_id long, n_bytes long, z binary")


def _unpack(z: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(z, n, asbytes=True)


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted strips (k, doc_id, anchor, digest, s, n, shard, big)."""
    per = wanted.groupBy(F.col("k").alias("wk"), F.col("doc_id").alias("wd")).agg(F.collect_list(F.struct("anchor", "digest", "s", "n", "shard", "big")).alias("w"))
    both = texts.join(per, F.expr("k = wk AND doc_id = wd")).select("k", "doc_id", "n_bytes", "z", "w").dropDuplicates(["k", "doc_id"])
    names = ["k", "doc_id", "anchor", "digest", "s", "n", "shard", "big", "body"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.bool_(), pa.binary()])))

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        for batch in batches:
            for row in range(batch.num_rows):
                k, doc, n_bytes, z = (batch.column(c)[row].as_py() for c in ("k", "doc_id", "n_bytes", "z"))
                raw = _unpack(z, n_bytes)
                w = batch.column("w")[row].values
                for x in zip(*(w.field(c).to_pylist() for c in ("anchor", "digest", "s", "n", "shard", "big"))):
                    held.append((k, doc, *x, raw[x[2] : x[2] + x[3] + WINDOW - 1]))
                    size += len(held[-1][-1])
                    if size >= CHUNK * 8:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return both.mapInArrow(run, "k long, doc_id long, anchor long, digest long, s long, n int, shard long, big boolean, body binary")


def _search(bodies: DataFrame, crowded: bool) -> DataFrame:
    """(k, doc_id, a, b): runs of repeated windows as bytes [a, b), by one suffix array for each shard."""
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
    bodies = cut(bodies) if crowded else bodies

    def run(table: pa.Table) -> pa.Table:
        # equal order in every attempt
        table = table.sort_by([("anchor", "ascending"), ("digest", "ascending")])
        body = table["body"].to_pylist()
        k, d, s, n = (table[c].to_numpy() for c in ("k", "doc_id", "s", "n"))
        flags = repeats(body)
        # runs of repeated windows within a strip
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        first = np.flatnonzero(flags & np.concatenate(([True], ~flags[:-1] | (of[1:] != of[:-1]))))
        last = np.flatnonzero(flags & np.concatenate((~flags[1:] | (of[1:] != of[:-1]), [True])))
        o = of[first]
        out = [pa.table([k[o], d[o], s[o] + place[first], s[o] + place[last] + WINDOW, pa.nulls(len(o), pa.int64())], schema=schema)]
        told: set[int] = set()
        for i in np.flatnonzero(table["big"].to_numpy(zero_copy_only=False)):
            # keys of all windows go on: an undecided one stands once in its shard, of those that are known to repeat one witness goes for all
            left = np.arange(n[i])
            keys = span_hashes(np.frombuffer(body[i], np.uint8), left, left + WINDOW).view(np.int64)
            mine = flags[np.searchsorted(of, i) : np.searchsorted(of, i, side="right")]
            new = ~mine
            for j in np.flatnonzero(mine):
                new[j] = keys[j] not in told
                told.add(keys[j])
            left, mine, keys = left[new], mine[new], keys[new]
            out.append(pa.table([np.full(len(left), k[i]), np.full(len(left), d[i]), pa.array(s[i] + left, mask=mine), s[i] + left + WINDOW, keys], schema=schema))
        return pa.concat_tables(out)

    found = bodies.groupBy("shard").applyInArrow(run, "k long, doc_id long, a long, b long, key long")
    if not crowded:
        return found.select("k", "doc_id", "a", "b")
    found = cut(found)
    open_ = found.where("key IS NOT NULL")
    ways = max(1, -(-open_.count() // 500_000))

    def merge(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        order = np.sort(key)
        twice = (np.searchsorted(order, key, side="right") - np.searchsorted(order, key, side="left") > 1) & table["a"].is_valid().to_numpy()
        return table.filter(pa.array(twice)).select(["k", "doc_id", "a", "b"])

    merged = open_.select("k", "doc_id", "a", "b", "key", F.expr(f"pmod(shiftrightunsigned(key, 32), {ways})").alias("way")).groupBy("way").applyInArrow(merge, "k long, doc_id long, a long, b long")
    return found.where("key IS NULL").select("k", "doc_id", "a", "b").unionAll(merged)


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, doc_id, spans): byte spans of each text that are covered by repeated windows; those that meet in a task are merged."""
    found = cut(find_strips(docs))
    # written down: both sides of the join then come from exchanges, and a crowded anchor can be split
    anchors = cut(found.groupBy("anchor").agg(F.count("*").alias("m"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("m > 1").select(F.col("anchor").alias("again"), (F.col("lo") != F.col("hi")).alias("unequal")))
    hits = cut(found.join(anchors, F.col("anchor") == F.col("again")).select("k", "doc_id", "anchor", "digest", "s", "n", "unequal"))
    whole = lambda df: df.select("k", "doc_id", F.col("s").alias("a"), (F.col("s") + F.col("n") + (WINDOW - 1)).alias("b"))
    unequal = hits.where("unequal")
    kinds = cut(unequal.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(F.struct("k", "doc_id", "s", "n")).alias("x")))
    # written down: with its size known the small side is broadcast at once, or both sides come from exchanges
    equal = unequal.join(cut(kinds.where("c > 1").select("anchor", "digest")), ["anchor", "digest"], "left_semi")
    # one of each kind is searched; a strip that stands alone is its own only place
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.expr(f"x.n + {WINDOW}")).alias("size"))
    total = many.agg(F.sum("size"), F.max("kinds")).first()
    shards, crowded = max(1, -(-(total[0] or 0) // SHARD)), (total[1] or 0) > STRIPS
    named = kinds.select("anchor", "digest", "c", "x.*").join(many.where(F.col("kinds") > STRIPS).select(F.col("anchor").alias("hot"), "kinds"), F.expr("anchor = hot"), "left")
    deal = F.expr(f"pmod(xxhash64(anchor, CASE WHEN kinds IS NULL THEN 0 ELSE pmod(digest, CAST(ceil(kinds / {STRIPS}) AS BIGINT)) END), {shards})")
    wanted = named.select("k", "doc_id", "anchor", "digest", "s", "n", deal.alias("shard"), F.col("kinds").isNotNull().alias("big"))
    parts = _search(_fetch(texts, wanted), crowded)
    spans = whole(hits.where("NOT unequal")).unionAll(whole(equal)).unionAll(parts)
    # a text of a short period has a span for almost every byte: merged where they are before they are gathered
    return merge_batches(spans).groupBy("k", "doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merge_batches(spans: DataFrame) -> DataFrame:
    """Spans (k, doc_id, a, b) with those of one text that overlap or touch merged, within SPANS rows of a partition."""
    schema = pa.schema([(c, pa.int64()) for c in ("k", "doc_id", "a", "b")])

    def merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        k, d, a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(4))
        order = np.lexsort((a, d, k))
        k, d, a, b = k[order], d[order], a[order], b[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
        # texts are set apart, so that one running maximum serves all
        shift = (np.cumsum(new) - 1) * (int(b.max()) + 1)
        reach = np.maximum.accumulate(b + shift) - shift
        first = np.flatnonzero(np.concatenate(([True], new[1:] | (a[1:] > reach[:-1]))))
        last = np.concatenate((first[1:], [len(a)])) - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[first], d[first], a[first], reach[last])], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SPANS:
                yield merge(held)
                held, n = [], 0
        if n:
            yield merge(held)

    return spans.select("k", "doc_id", "a", "b").mapInArrow(run, "k long, doc_id long, a long, b long")


def merged(spans: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the unions of spans that overlap or touch, from structs (a, b) in any order."""
    if spans is None or not len(spans):
        return (np.empty(0, np.int64),) * 2
    a, b = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate(([True], a[1:] > reach[:-1]))
    return a[first], reach[np.concatenate((first[1:], [True]))]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text), and the kept bytes.

    A null text is empty; texts shorter than WINDOW keep everything. Repeated
    rows are documents of their own, so both lose what they share. Extra columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = packed_texts(docs)
    spans = repeated_spans(docs, texts).withColumnsRenamed({"k": "sk", "doc_id": "sd"})
    joined = texts.join(spans, F.expr("k = sk AND doc_id = sd"), "left").select("doc_id", "n_bytes", "z", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i in range(part.num_rows):
                    doc, n_bytes, z = (part.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "z"))
                    raw = _unpack(z, n_bytes)
                    a, b = merged(part.column("spans")[i].values)
                    ends = np.concatenate(([0], b))
                    body = b"".join(raw[x:y] for x, y in zip(ends.tolist(), [*a.tolist(), len(raw)]))
                    rows.append((None if doc == NONE else doc, len(raw), int((b - a).sum()), len(a), hashlib.sha256(body).hexdigest(), body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")
