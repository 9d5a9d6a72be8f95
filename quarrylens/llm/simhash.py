"""SimHash near-duplicate groups by deletion-variant signatures.

Documents become 64-bit fingerprints of their word shingles. Two fingerprints
that differ in at most ``2`` bits are found by cutting them into only two
segments of 32 bits, so that one segment differs in at most one bit. Each
segment is indexed under 32 variants, each with one bit taken out; fingerprints
that share a variant meet in an equality join and are then verified.

Work is on distinct fingerprints, so copies cost nothing. Where more than
``bucket`` fingerprints share a segment, its variants are not paired up: those
fingerprints meet by whole-fingerprint variants with one bit flipped instead.
Two values within two bits share such a variant, any two that share one are
within two bits, and a variant holds at most 65 fingerprints, so every link is
found without listing all pairs of a large group.

Near copies at a similarity of 0.8 (``keep_one``) use the same index over another
signature. Two texts that similar differ in 15 % of the bits of a fingerprint, so
that no segment long enough to tell texts apart would differ in one bit at most.
Their least hashes differ in 20 % of the places only, and each place has 64 bits:
segments of five, with one place left out of each variant, equality join, and
verification by the exact similarity of the shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import components, cut, map_batches

#: bytes 0-255 with A-Z lowered
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one shingle, one without words none."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        parts = [b" ".join(w)]
    elif words == 3:
        parts = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:])]
    else:
        parts = list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    h = xxhash.xxh64_intdigest
    return np.array([h(p, seed) for p in parts], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp: long) for each row; a null text counts as empty, without words the fingerprint is 0."""

    def rows(x: dict) -> dict:
        return {"doc_id": x["doc_id"], "fp": [signed(majority(shingle_hashes(t, words))) for t in x["text"]]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, fp long")


def near_links(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """(src, dst) over distinct fingerprints ``fp``: enough links to connect all that differ in at most 2 bits.

    Joins are told to sort: Spark takes what is exploded for no more rows than before, and would send it through the driver.
    """
    segment = [F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v")), F.struct(F.lit(1).alias("s"), F.shiftrightunsigned("fp", 32).alias("v"))]
    segs = fps.select("fp", F.explode(F.array(*segment)).alias("x")).select("fp", "x.s", "x.v")
    dense = segs.groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    # the variants that a dense segment value belongs to are those of its own and of values one bit away
    bit = F.explode(F.sequence(F.lit(0), F.lit(31)))
    own = dense.select("s", "v", F.lit((1 << 32) - 1).cast("long").alias("mask"))
    side = dense.select("s", "v", bit.alias("p")).select("s", F.expr("v ^ shiftleft(1L, p)").alias("v"), F.expr("shiftleft(1L, p)").alias("mask"))
    masks = own.unionAll(side).groupBy("s", "v").agg(F.expr("bit_or(mask)").alias("mask"))
    segs = cut(segs.join(masks.hint("merge"), ["s", "v"], "left").select("fp", "s", "v", F.coalesce("mask", F.lit(0)).alias("mask")))

    # equal segments: one bucket; segments one bit apart: the variant without that bit, 0 on one side and 1 on the other
    plain = segs.where(F.col("mask") != (1 << 32) - 1)
    near = F.expr("bit_count(a.fp ^ b.fp) <= 2")
    same = plain.alias("a").join(plain.alias("b").hint("merge"), ["s", "v"]).where(F.expr("a.fp < b.fp") & near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    # one long holds segment, bit and the value without the bit
    variants = plain.select("fp", "s", "v", "mask", bit.alias("p")).where("(shiftright(mask, p) & 1) = 0")
    variants = variants.select("fp", F.expr("(shiftright(v, p) & 1) = 1").alias("one"), F.expr("shiftleft(CAST(s * 32 + p AS BIGINT), 32) | (v & ~shiftleft(1L, p))").alias("k"))
    zero, one = variants.where("NOT one").select("fp", "k"), variants.where("one").select("fp", "k")
    differ = zero.alias("a").join(one.alias("b").hint("merge"), "k").where(near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))

    crowded = segs.where("mask <> 0").select("fp").distinct()
    flips = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.expr(f"fp ^ shiftleft(1L, {i})") for i in range(64)])).alias("z"))
    centre = flips.groupBy("z").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").select("z", "dst")
    star = flips.join(centre.hint("merge"), "z").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return same.unionAll(differ).unionAll(star).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, bucket: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and group_size for each row of ``docs`` (doc_id, text).

    Null and blank texts share fingerprint 0 and are linked like any other; a
    component of rows without a doc_id has a null component_id. Repeated rows
    stay repeated; an empty table gives an empty result; extra columns are ignored.
    """
    each = cut(fingerprints(docs, words))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(near_links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    comp = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    of = cut(rooted.join(comp.hint("merge"), "root").select("fp", "component_id", "group_size"))
    return each.join(of.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


#: Near copies: exact similarity of shingle sets; candidates agree in all but at most one of the ROWS least hashes of one of SEGMENTS segments.
SIMILAR, SEGMENTS, ROWS = 0.8, 5, 5
#: Sets are similar if the sum of their sizes is this many times their symmetric difference at least; their sizes then fit.
RATIO = round((1 + SIMILAR) / (1 - SIMILAR))
FITS = f"least(l.n, r.n) >= {SIMILAR} * greatest(l.n, r.n)"
#: Sets that a crowd's reference is made of; classes of partners; rounds in which crowds of one popular set are merged, and after which they may grow, so that they end.
REFERENCE, CLASSES, MERGED, ROUNDS = 15, 10, 2, 12
#: Counters for each element of a crowd's sets, and in all at most; elements that one task counts; counters that are summed at once.
PLACES, MOST_PLACES, PIECE, FAN = 16, 1 << 22, 1 << 19, 32
LISTED = pa.schema([("c", pa.int64()), ("id", pa.int64()), *((n, pa.int32()) for n in ("n", "a", "size")), ("asks", pa.bool_()), ("cls", pa.int32()), ("r", pa.int32()), ("key", pa.int64()), ("j", pa.int32())])
_rng = np.random.default_rng(20)
FACTORS, SHIFTS = _rng.integers(0, 1 << 63, (2, SEGMENTS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(shingle_hashes(text, words))


def variant_keys(h: np.ndarray) -> list[int]:
    """The signature of a set is SEGMENTS segments of ROWS least hashes; one key for each segment and place that is left out."""
    import xxhash

    least = np.full(SEGMENTS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1 << 12):
        part = h[at : at + (1 << 12)]
        for i in range(SEGMENTS * ROWS):
            x = (part ^ SHIFTS[i]) * FACTORS[i]
            x ^= x >> np.uint64(32)
            least[i] = min(least[i], (x * FACTORS[i]).min())
    return [signed(xxhash.xxh64_intdigest(np.delete(least[i * ROWS : (i + 1) * ROWS], j).tobytes(), i * ROWS + j)) for i in range(SEGMENTS) for j in range(ROWS)]


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst, j): the Jaccard similarity of the sets (id, h) of each pair."""
    end = lambda e: sets.select(F.col("id").alias(e), F.col("h").alias(f"h_{e}"))
    both = pairs.join(end("src"), "src").join(end("dst"), "dst").withColumn("m", F.size(F.array_intersect("h_src", "h_dst")))
    total = F.size("h_src") + F.size("h_dst") - F.col("m")
    return both.select("src", "dst", F.when(total == 0, 1.0).otherwise(F.col("m") / total).alias("j"))


def near_copy_links(keys: DataFrame, sets, bucket: int = 24) -> DataFrame:
    """(src, dst) over (id, n, k: the variant keys): enough verified links to connect all candidates of similarity SIMILAR.

    ``sets`` gives (id, h) for a frame of ids. Two sets of similarity s differ in
    at most one place of a segment with a probability of p = s^5 + 5 s^4 (1 - s)
    and share a variant with one of 1 - (1 - p)^5: 0.9987 at 0.8. Pairs that
    share a key are verified. Where more than ``bucket`` sets share a key, they are
    a crowd (see ``crowd_links``). No pair that shares a key is left out.
    """
    each = keys.select("id", "n", F.explode("k").alias("k"))
    # told to sort, as in near_links
    each = cut(each.join(each.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").hint("merge"), "k"))
    few = each.where(F.col("m") <= bucket).select("id", "n", "k")
    pairs = cut(few.alias("l").join(few.alias("r").hint("merge"), "k").where(F.expr(f"l.id < r.id AND {FITS}")).select(F.col("l.id").alias("src"), F.col("r.id").alias("dst")).distinct())
    members = merged_crowds(each.where(F.col("m") > bucket).select("k", "id"))
    members = cut(merged_crowds(members.select(F.col("c").alias("k"), "id")))
    have = cut(sets(pairs.select(F.col("src").alias("id")).unionAll(pairs.select("dst")).unionAll(members.select("id")).distinct()))
    links = similar(pairs, have).where(F.col("j") >= SIMILAR).select("src", "dst")
    for more in crowd_links(members, have, bucket):
        links = links.unionAll(more)
    return links


def crowds(crowded: DataFrame) -> DataFrame:
    """(c, id) of keys (k, id): keys that the same sets hold are one crowd."""
    same = crowded.groupBy("k").agg(F.xxhash64(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).alias("c"))
    return crowded.join(same, "k").select("c", "id").distinct()


def merged_crowds(crowded: DataFrame) -> DataFrame:
    """(c, id) of keys (k, id): keys of one group of near copies have nearly the same sets; those with the same most popular set are one crowd."""
    popular = crowded.groupBy("id").agg(F.count("*").alias("p"))
    centre = crowded.join(popular, "id").groupBy("k").agg(F.max(F.struct("p", "id")).alias("x")).select("k", F.col("x.id").alias("c"))
    return crowded.join(centre, "k").select("c", "id").distinct()


def crowd_links(members: DataFrame, have: DataFrame, bucket: int):
    """Links of crowds (c, id) over the sets (id, h), one frame after another; no similar pair of a crowd stays unconnected.

    A crowd has a reference: the elements that most of a few of its sets hold. D is
    what a set has more or less than it. Two sets are similar if their symmetric
    difference is a ninth of their sizes' sum at most, so surely if |D| + |D'| is;
    with a = 9 |D| - n this is a + a' <= 0. Sets that it ties to the one of least a
    hang on that. Any other one has a + a' > 0 with every set, and those that are
    similar share (a + a') / 18 elements of D at least. Of the others, and one more,
    the rarest elements are keys: a similar pair meets in one. As this depends on
    the partner, sets have one key for each class of partners. Keys that many hold
    are crowds again, about a reference that has what they share, so that no group
    is compared pair by pair and each crowd is smaller than the one it comes from.
    """
    rounds = 0
    while not members.isEmpty():
        some = members.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("id"), "id"))).where(F.col("r") <= REFERENCE)
        some = some.join(some.groupBy("c").agg(F.count("*").alias("m")), "c").join(have, "id")
        middle = some.select("c", "m", F.explode("h").alias("x")).groupBy("c", "x").agg(F.count("*").alias("f"), F.first("m").alias("m")).where("2 * f > m")
        middle = cut(middle.groupBy("c").agg(F.collect_list("x").alias("v")))
        x = members.join(have, "id").join(middle, "c", "left").withColumn("v", F.coalesce("v", F.array().cast("array<long>")))
        # an element that is lost has another key than one that is extra
        d = F.concat(F.array_except("h", "v"), F.transform(F.array_except("v", "h"), lambda e: F.xxhash64(e)))
        x = x.select("c", "id", F.size("h").alias("n"), F.size("v").alias("nv"), d.alias("d")).withColumn("a", F.expr(f"{RATIO} * size(d) - n"))
        x = cut(x)
        least = x.groupBy("c").agg(F.min(F.struct("a", "id")).alias("s"), F.sum(F.size("d")).alias("total")).select("c", "total", F.col("s.a").alias("least"), F.col("s.id").alias("dst"))
        x = x.join(least, "c").withColumn("asks", F.expr("a + least > 0 AND id <> dst"))
        yield x.where("NOT asks AND id <> dst").select(F.col("id").alias("src"), "dst")
        x = x.join(x.where("asks").select("c").distinct(), "c", "left_semi")
        # classes of a; a partner's is that of its class at least, and one of a set that asks, for a set that does not
        x = x.withColumn("wide", F.expr("greatest(1, nv) / 2")).withColumn("cls", F.expr(f"CAST(least({CLASSES} - 1, floor((a - least) / wide)) AS INT)")).withColumn("size", F.size("d"))
        held = needed_keys(x)
        held = cut(held.withColumn("key", F.xxhash64("key", F.least("cls", "j"), F.greatest("cls", "j"))))
        size = held.groupBy("c", "key").agg(F.count_if("asks").alias("many"), F.count("*").alias("p")).where("many > 0 AND p > 1")
        held = held.join(size, ["c", "key"])
        small = F.col("many") * F.col("p") <= bucket * bucket
        # the first element that two sets share is followed by no more of them than are left of either
        can = f"l.id <> r.id AND l.j = r.cls AND {FITS} AND least(l.size - l.r, r.size - r.r) + 1 >= (l.a + r.a) / {2 * RATIO}"
        pairs = held.where(small & F.col("asks")).alias("l").join(held.where(small).alias("r"), ["c", "key"]).where(F.expr(can))
        pairs = cut(pairs.select(F.least("l.id", "r.id").alias("src"), F.greatest("l.id", "r.id").alias("dst")).distinct())
        yield similar(pairs, have).where(F.col("j") >= SIMILAR).select("src", "dst")
        members = cut((merged_crowds if rounds < MERGED else crowds)(held.where(~small).select(F.xxhash64("c", "key").alias("k"), "id")))
        rounds += 1
        if rounds > ROUNDS:
            bucket *= 2


def _slots(d: np.ndarray, size: int) -> np.ndarray:
    x = d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def needed_keys(x: DataFrame) -> DataFrame:
    """(c, id, n, a, size, asks, cls, r, key, j): of each set's D the elements that it needs as keys for a class j of partners.

    How many sets of the crowd hold an element is counted by its hash, in counters
    of which a crowd has PLACES for each element: never too low, so what counts
    once is held by no other set, and elements come in one order for all sets of
    the crowd, the rarest first. Counters are made for pieces of PIECE elements,
    summed, and sent to the pieces again: elements that no partner shares are not
    listed at all.
    """
    x = x.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("total") / PIECE))).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    x = cut(x.withColumn("places", F.least(F.lit(MOST_PLACES), F.greatest(F.lit(64), F.col("total") * PLACES))))

    def count(part: pa.Table) -> pa.Table:
        size = part["places"][0].as_py()
        many, asked = np.zeros(size, np.int64), np.zeros(size, bool)
        for batch in part.to_batches():
            for d, asks in zip(batch["d"], batch["asks"].to_pylist()):
                at = _slots(np.asarray(d.values), size)
                many += np.bincount(at, minlength=size)
                if asks:
                    asked[at] = True
        return counters(part["c"][0].as_py(), part["to"][0].as_py(), many, asked)

    def counters(c: int, to: int, many: np.ndarray, asked: np.ndarray) -> pa.Table:
        both = np.minimum(many, 127).astype(np.uint8) | (asked.astype(np.uint8) << 7)
        return pa.table({"c": [c], "to": [to], "counts": [both.tobytes()]}, schema=pa.schema([("c", pa.int64()), ("to", pa.int64()), ("counts", pa.binary())]))

    def add(part: pa.Table) -> pa.Table:
        all_ = [np.frombuffer(b.as_py(), np.uint8) for b in part["counts"]]
        return counters(part["c"][0].as_py(), part["to"][0].as_py(), sum((b & 127).astype(np.int64) for b in all_), np.bitwise_or.reduce(all_) > 127)

    made = "c long, to long, counts binary"
    counts = x.select("c", "piece", "places", "asks", "d", F.floor(F.col("piece") / FAN).alias("to")).groupBy("c", "piece").applyInArrow(count, made)
    most = x.agg(F.max("pieces")).first()[0] or 1
    while most > 1:
        # pieces' counters are summed by FAN at once, however many there are
        most = -(-most // FAN)
        counts = counts.groupBy("c", F.col("to").alias("piece")).applyInArrow(add, made).withColumn("to", F.floor(F.col("to") / FAN))
    of = x.select("c", "piece").distinct().join(counts.select("c", "counts"), "c").select(F.col("c").alias("of"), F.col("piece").alias("part"), "counts")

    def choose(sets: pa.Table, counted: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in LISTED}
        if sets.num_rows:
            both = np.frombuffer(counted["counts"][0].as_py(), np.uint8)
            for row in sets.to_batches():
                cols = {n: row[n].to_pylist() for n in ("c", "id", "n", "a", "size", "asks", "cls", "least", "wide")}
                for i, d in enumerate(row["d"]):
                    v = {n: x[i] for n, x in cols.items()}
                    d = np.asarray(d.values)
                    f = both[_slots(d, len(both))]
                    order = np.lexsort((d, f & 127))
                    d, f = d[order], f[order]
                    shared = int(((f & 127) > 1).sum())
                    can = ((f & 127) > 1) & (f > 127)
                    for j in range(CLASSES):
                        partner = v["least"] + j * v["wide"]
                        if not v["asks"]:
                            partner = max(partner, -v["least"])
                        need = max(1, math.ceil((v["a"] + partner) / (2 * RATIO) - 1e-9))
                        # no more than what others of the crowd have too, nor than the D of such a partner can have
                        if need > shared or j < CLASSES - 1 and need > (v["least"] + (j + 1) * v["wide"] + v["n"] / SIMILAR) / RATIO:
                            continue
                        at = np.flatnonzero(can[: max(0, v["size"] + 1 - need)])
                        for n in ("c", "id", "n", "a", "size", "asks", "cls"):
                            out[n] += [v[n]] * len(at)
                        out["r"] += (at + 1).tolist()
                        out["key"] += d[at].tolist()
                        out["j"] += [j] * len(at)
        return pa.table(out, schema=LISTED)

    ddl = "c long, id long, n int, a int, size int, asks boolean, cls int, r int, key long, j int"
    sets = x.select("c", "piece", "id", "n", "a", "size", "asks", "cls", F.col("least").alias("least"), F.col("wide").cast("double").alias("wide"), "d")
    return sets.groupBy("c", "piece").cogroup(of.groupBy("of", "part")).applyInArrow(choose, ddl)


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` without near copies (similarity of 5-word shingle sets of 0.8 and more): of each group the least doc_id stays.

    Null ids count as greater than any; of equal ids the least text hash stays,
    of repeated rows one. Texts without words are copies of each other. Columns
    stay as they are.
    """
    import xxhash

    def rows(x: dict) -> dict:
        got = [shingle_set(t, words) for t in x["text"]]
        digest = lambda seed: [signed(xxhash.xxh64_intdigest(h.tobytes(), seed)) for h in got]
        return {"doc_id": x["doc_id"], "tie": x["tie"], "a": digest(1), "b": digest(2), "n": [len(h) for h in got], "k": [variant_keys(h) for h in got]}

    def hashes(x: dict) -> dict:
        return {"id": x["id"], "h": [shingle_set(t, words).view(np.int64) for t in x["text"]]}

    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    source = docs.select(last.alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    each = cut(map_batches(source, rows, "doc_id long, tie long, a long, b long, n long, k array<long>"))
    # sets that are equal are one
    distinct = cut(each.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.first("k").alias("k")).withColumn("id", F.monotonically_increasing_id()))

    def sets(ids: DataFrame) -> DataFrame:
        of = distinct.join(ids, "id").select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie"))
        return map_batches(source.join(of, ["doc_id", "tie"]).dropDuplicates(["id"]).select("id", "text"), hashes, "id long, h array<long>")

    roots = components(near_copy_links(distinct.select("id", "n", "k"), sets))
    first = distinct.join(roots, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias("keep_id"), F.col("x.tie").alias("keep_tie"))
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), last.alias("keep_id"), F.xxhash64("text").alias("keep_tie"))
    return keyed.join(cut(first), ["keep_id", "keep_tie"]).dropDuplicates(["keep_id", "keep_tie"]).select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, fingerprints within 2 bits linked."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
