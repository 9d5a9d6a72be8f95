"""Passes over a whole system: resolving, merging, folding, inferring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut, scratch


def resolve_calls(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """Calls (call_id, callee, kind) bound by lower-cased name to procedures (id, name): one candidate binds,
    more make the call UNRESOLVED, none leaves it; EXTERNAL calls stay unbound."""
    names = procedures.groupBy(F.lower("name").alias("lname")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    # a dotted callee is resolved by its last part
    leaf = F.lower(F.element_at(F.split("callee", r"\."), -1))
    j = calls.join(names, leaf == F.col("lname"), "left")
    own = F.col("kind") != "EXTERNAL"
    return j.select("call_id", "callee", F.when(own & (F.col("n") == 1), F.col("id")).alias("callee_id"), F.when(own & (F.col("n") > 1), "UNRESOLVED").otherwise(F.col("kind")).alias("kind"), F.when(own, F.coalesce("n", F.lit(0))).otherwise(0).alias("candidates"))


def infer_types(declared: DataFrame, assigned: DataFrame) -> DataFrame:
    """(var, type): the types (var, type) that variables are declared with or given, and those of what is assigned (var, source) to them.

    Only what was new in the last round meets the assignments in the next, until
    nothing is; cycles of assignments end.
    """
    with scratch(declared.sparkSession) as kept:
        steps = cut(assigned.where("var <> source").select("var", "source").distinct())
        known = new = cut(declared.where("var IS NOT NULL AND type IS NOT NULL").select("var", "type").distinct())
        while not new.isEmpty():
            passed = new.select(F.col("var").alias("source"), "type").join(steps, "source").select("var", "type").distinct()
            new = cut(passed.join(known, ["var", "type"], "left_anti"))
            known = known.unionByName(new)
        out = cut(known)
        kept.append(out)
    return out


def resolve_typed(calls: DataFrame, procedures: DataFrame, types: DataFrame) -> DataFrame:
    """resolve_calls for calls with a receiver (call_id, callee, kind, receiver): a procedure (id, component, name) of one of its types comes first.

    If exactly one answers, the call is bound to it; several make it UNRESOLVED;
    only if none does is it resolved by its bare name.
    """
    leaf = F.lower(F.element_at(F.split("callee", r"\."), -1))
    own = calls.where("kind <> 'EXTERNAL' AND receiver IS NOT NULL").select("call_id", "receiver", leaf.alias("lname"))
    # equal questions are asked once
    asked = own.select("receiver", "lname").distinct().join(types.select(F.col("var").alias("receiver"), F.lower("type").alias("lcomponent")).distinct(), "receiver")
    of = procedures.select(F.lower("component").alias("lcomponent"), F.lower("name").alias("lname"), "id")
    answer = asked.join(of, ["lcomponent", "lname"]).groupBy("receiver", "lname").agg(F.countDistinct("id").alias("typed"), F.min("id").alias("typed_id"))
    typed = own.join(answer, ["receiver", "lname"]).select("call_id", "typed", "typed_id")
    bare = resolve_calls(calls.select("call_id", "callee", "kind"), procedures)
    j = bare.join(typed, "call_id", "left")
    by_type = F.col("typed").isNotNull()
    return j.select(
        "call_id", "callee",
        F.when(by_type, F.when(F.col("typed") == 1, F.col("typed_id"))).otherwise(F.col("callee_id")).alias("callee_id"),
        F.when(by_type & (F.col("typed") > 1), "UNRESOLVED").when(by_type, "TYPED").otherwise(F.col("kind")).alias("kind"),
        F.coalesce("typed", "candidates").alias("candidates"),
    )


def merge_objects(seen: DataFrame) -> DataFrame:
    """Observations (object_id, order, seen_in, proven, ref) as one row for each object: first place, best status, sorted references."""
    per = seen.groupBy("object_id").agg(F.count("*").alias("n_seen"), F.min_by("seen_in", "order").alias("first_seen"), F.bool_or("proven").alias("ok"), F.array_sort(F.collect_set("ref")).alias("refs"))
    return per.select("object_id", "n_seen", "first_seen", F.when(F.col("ok"), "OK").otherwise("PARTIAL").alias("status"), "refs")


def fold_declarations(declared: DataFrame, components: DataFrame) -> DataFrame:
    """Declared names, with or without .frm, and the component each stands for; without one it is an orphan."""
    key = F.lower(F.regexp_replace("declared", r"(?i)[.]frm$", ""))
    j = declared.join(components.select("name", F.lower("name").alias("k")), key == F.col("k"), "left")
    return j.select("declared", F.col("name").alias("component"), F.col("name").isNull().alias("orphan"))


def inferred_transitions(writes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """From each written value to the next different one of its group; with a column ``domain`` only within a domain or an UNKNOWN one, and in the one that is known."""
    w = Window.partitionBy(group).orderBy(*order)
    out = writes.withColumn("from_state", F.col("value")).withColumn("to_state", F.lead("value").over(w))
    if "domain" in writes.columns:
        nxt = F.lead("domain").over(w)
        out = out.withColumn("_next", nxt).where("domain = _next OR domain = 'UNKNOWN' OR _next = 'UNKNOWN'")
        out = out.withColumn("domain", F.when(F.col("_next") != "UNKNOWN", F.col("_next")).otherwise(F.col("domain"))).drop("_next")
    return out.where("to_state <> from_state")


def state_names(transitions: DataFrame) -> DataFrame:
    """All states that are known by name."""
    names = transitions.select(F.explode(F.array("from_state", "to_state")).alias("name"))
    return names.where("name IS NOT NULL AND name <> '' AND name <> 'UNKNOWN'").distinct()


#: Runs of letters and digits, and runs of anything else: every character belongs to one token. Needles of up to FEW may be found by their ends.
FEW = 5
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def _grams(text: str, size: int) -> Column:
    """The distinct pieces of ``size`` characters, in linear time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def token_keys(needles: DataFrame, vocabulary: DataFrame, gram: int = 3) -> DataFrame:
    """(_k, needle, tok): tokens of the vocabulary (tok, df) of which every text that holds the needle has one.

    A token with others on both sides stands whole in such texts: of these the one
    in the fewest texts is the key. A needle of one or two tokens may begin and end
    inside of longer ones: the vocabulary's tokens that hold such a piece are found
    by the piece's rarest gram, and of two pieces the one whose tokens are in fewer
    texts counts. Of a needle of a few more tokens the first and the last are such
    pieces too, since all that stands between may be a space: what is in the fewest
    texts counts. Needles without a key are in no text.
    """
    known = cut(needles.where("needle <> ''").select("_k", "needle", _tokens("needle").alias("t")))
    inner = known.where("size(t) > 2").select("_k", "needle", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("tok"))
    inner = inner.join(vocabulary, "tok", "left").groupBy("_k", "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok")).alias("x"))
    ends = F.array_distinct(F.array(F.element_at("t", 1), F.element_at("t", -1)))
    pieces = known.where(f"size(t) <= {FEW}").select("_k", "needle", F.explode(ends).alias("piece"))
    asked = cut(pieces.select("*", F.explode(F.when(F.length("piece") >= gram, _grams("piece", gram)).otherwise(F.array("piece"))).alias("g")))
    sizes = F.array_distinct(F.flatten(F.array(*[_grams("tok", n) for n in range(1, gram + 1)])))
    held = vocabulary.select("tok", "df", F.explode(sizes).alias("g"))
    held = cut(held.join(asked.select("g").distinct(), "g", "left_semi"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "g", "left").groupBy("_k", "needle", "piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x"))
    met = cut(rarest.select("_k", "needle", "piece", F.col("x.g").alias("g")).join(held, "g").where(F.contains(F.col("tok"), F.col("piece"))))
    cost = pieces.join(met.groupBy("_k", "needle", "piece").agg(F.sum("df").alias("cost")), ["_k", "needle", "piece"], "left")
    cost = cost.select("_k", "needle", F.coalesce("cost", F.lit(0)).alias("cost"), "piece").unionAll(inner.select("_k", "needle", "x.df", F.lit("")))
    best = cost.groupBy("_k", "needle").agg(F.min(F.struct("cost", "piece")).alias("x")).where("x.cost > 0").select("_k", "needle", "x.piece")
    whole = inner.join(best.where("piece = ''"), ["_k", "needle"], "left_semi").select("_k", "needle", "x.tok")
    return whole.unionByName(met.join(best, ["_k", "needle", "piece"]).select("_k", "needle", "tok"))


#: Bytes of needles that every task can be given; characters of a text that are coded at once.
GIVEN, CODED = 2 << 20, 1 << 20


def _present(text: str, wanted: np.ndarray, maybe: np.ndarray, sizes: set[int]) -> np.ndarray:
    """The places in ``wanted``, which is in order, of the text's grams of these sizes; ``maybe`` tells by 16 bits of a hash which can be there."""
    found = []
    for start in range(0, len(text), CODED):
        x = np.frombuffer(text[start : start + CODED + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        for size in sizes:
            code = x[: max(0, len(x) - size + 1)]
            for j in range(1, size):
                code = (code << np.uint64(21)) | x[j : len(x) - size + 1 + j]
            code = code[maybe[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)]]
            at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            found.append(at[wanted[at] == code])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _code(gram: str) -> int:
    code = 0
    for c in gram:
        code = code << 21 | ord(c) + 1
    return code


def _asked(codes: Iterable[int]) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """What _present() looks for."""
    wanted = np.array(sorted(codes), np.uint64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(wanted * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True
    return wanted, maybe, {1 + (c.bit_length() - 1) // 21 for c in wanted.tolist()}


def _met_in_tasks(needles: list[str], fragments: DataFrame, order: str) -> DataFrame:
    """(needle, _first, n): the first fragment of all that hold a needle, and their number.

    Tasks are given the needles and shuffle one row for each at most. A needle is
    looked for in texts that hold the one of its grams of three characters (of its
    one or two) that is in the fewest texts.
    """
    spark = fragments.sparkSession
    texts = fragments.where(F.col("text").isNotNull() & F.col(order).isNotNull()).select(F.col(order).alias("_o"), "text")
    grams = [{_code(s[i : i + 3]) for i in range(max(1, len(s) - 2))} for s in needles]
    every = spark.sparkContext.broadcast(_asked(set().union(*grams)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, maybe, sizes = every.value
        n = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for text in batch["text"]:
                n[_present(text.as_py(), wanted, maybe, sizes)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[at].view(np.int64)), pa.array(n[at])], names=["g", "n"])

    df = needles and {r.g: r.n for r in texts.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    by: dict[int, list[tuple[int, str]]] = {}
    for i, mine in enumerate(grams):
        rarest = min(mine, key=lambda g: (df.get(g, 0), g))
        if rarest in df:
            by.setdefault(rarest, []).append((i, needles[i]))
    rows = "i int, _o " + texts.schema["_o"].dataType.simpleString()
    few = spark.sparkContext.broadcast((*_asked(by), [by[g] for g in sorted(by)]))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, maybe, sizes, asked = few.value
        for batch in batches:
            at, found = [], []
            for row, value in enumerate(batch["text"] if len(wanted) else ()):
                text = value.as_py()
                hits = [i for g in _present(text, wanted, maybe, sizes) for i, needle in asked[g] if needle in text]
                found += hits
                at += [row] * len(hits)
                if len(at) > 1 << 17 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch["_o"].take(pa.array(at, pa.int64()))], names=["i", "_o"])
                    at, found = [], []

    hits = texts.mapInArrow(meet, rows).groupBy("i").agg(F.min("_o").alias("_first"), F.count("*").alias("n"))
    return hits.join(spark.createDataFrame(list(enumerate(needles)), "i int, needle string"), "i").select("needle", "_first", "n")


def attribute(needles: DataFrame, fragments: DataFrame, key: str, order: str) -> DataFrame:
    """The first fragment (by ``order``) whose text holds the needle, else the first fragment.

    Tasks look for needles of up to GIVEN bytes in their own texts, which are not
    shuffled. Texts and more needles meet by equality of one rare token each,
    whatever the needle (see ``token_keys``), and what meets is compared. A null
    needle is in no text, an empty one in every text that is not null.
    """
    named = needles.select(F.col(key).alias("_k"), "needle").distinct()
    with scratch(needles.sparkSession) as kept:
        some = named.where("needle <> ''").select("needle").distinct()
        size = some.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
        if size <= GIVEN:
            hits = named.join(_met_in_tasks(sorted(r.needle for r in some.collect()), fragments, order), "needle")
            hits = hits.groupBy("_k").agg(F.min("_first").alias("_first"), F.sum("n").alias("n_docs"))
        else:
            held = fragments.select(F.col(order).alias("_o"), F.explode(F.array_distinct(_tokens("text"))).alias("tok"))
            vocabulary = cut(held.groupBy("tok").agg(F.count("*").alias("df")))
            keys = cut(token_keys(named, vocabulary))
            met = held.join(keys, "tok").select("_o", "_k", "needle").distinct()
            hits = fragments.join(met, F.col(order) == F.col("_o")).where(F.contains(F.col("text"), F.col("needle"))).groupBy("_k").agg(F.min(order).alias("_first"), F.count("*").alias("n_docs"))
        every = fragments.where("text IS NOT NULL").agg(F.min(order).alias("_first"), F.count("*").alias("n_docs")).where("n_docs > 0")
        hits = cut(hits.unionByName(named.where("needle = ''").select("_k").distinct().crossJoin(F.broadcast(every))))
        kept.append(hits)
    default = fragments.agg(F.min(order).alias("_default"))
    out = needles.join(hits, F.col(key) == F.col("_k"), "left").crossJoin(F.broadcast(default))
    return out.select(key, F.coalesce("_first", "_default").alias(order), F.col("_first").isNotNull().alias("attributed"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
