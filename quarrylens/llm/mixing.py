"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target of words. Dividing it by the source's size gives a rate
of at most 2: every document is taken floor(rate) times, and once more for a
sample with inclusion probability rate - floor(rate). The sample is balanced on
document count and words: the flight phase moves the probabilities of three
documents at a time along the direction that leaves both totals unchanged, until
one of them is 0 or 1. It runs over blocks of a source in parallel; what stays
undecided in a block (two documents at most) goes on to the next round, where
blocks are merged, until a source has one block. The landing phase decides its
last two documents by trying all outcomes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut
from quarrylens.operators.graph import numbered

#: Documents of a block; blocks merged in one.
BLOCK, MERGE = 4096, 1024
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most, sums of p and of p * size as before."""
    p = p.astype(float)
    active: list[int] = []
    draws = iter(())
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            x, y, z = float(size[a]), float(size[b]), float(size[c])
            u = (z - y, x - z, y - x)
            if x == y == z:
                u = (1.0, -1.0, 0.0)
            q = (p[a], p[b], p[c])
            up = min((1 - q[k]) / u[k] if u[k] > 0 else -q[k] / u[k] for k in range(3) if u[k])
            down = min(q[k] / u[k] if u[k] > 0 else (q[k] - 1) / u[k] for k in range(3) if u[k])
            draw = next(draws, None)
            if draw is None:
                draws = iter(rnd.random(1024).tolist())
                draw = next(draws)
            step = up if draw * (up + down) < down else -down
            for k, j in enumerate(active):
                v = q[k] + step * u[k]
                p[j] = 0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v
            active = [j for j in active if 0 < p[j] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The outcome for the undecided that misses the word total least, then the count."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want, many = float(p[open_] @ size[open_]), float(p[open_].sum())
    best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda x: (abs(np.dot(x, size[open_]) - want), abs(sum(x) - many), x))
    p = p.copy()
    p[open_] = best
    return p


def _seed(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size: long, n_docs: long, target: double) from (source, size); n_docs counts documents with words.

    Sources by code point, null last, get the weights in turn. A source's target
    stops at ``most`` times its size; the excess goes to the others by weight
    until none is above. Windows run over one row for each source.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    # those that stop at their cap are the first by cap / weight
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(all_) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    # the level that holds is that of the first source below its cap
    held = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap") / F.col("w"))).over(all_)
    return per.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(held, F.lit(0.0)) * F.col("w"))).alias("target"))


def _fly(df: DataFrame, land: bool) -> DataFrame:
    """One flight in each (source, block); ``land`` adds the landing."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "size", "tie"], kind="stable", na_position="last")
        size = x["size"].to_numpy(float)
        p = flight(x["p"].to_numpy(float), size, _seed(None if pd.isna(key[0]) else key[0], int(key[1]), len(x)))
        return x.assign(p=landing(p, size) if land else p)

    schema = "row long, tie long, doc_id long, source string, size long, p double, block long"
    return df.select("row", "tie", "doc_id", "source", "size", "p", "block").groupBy("source", "block").applyInPandas(run, schema)


def mix(docs: DataFrame, *keep: str, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The columns ``keep`` of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    Null texts have size 0; documents without words are never taken. A null
    source is a source of its own, the last. Repeated rows are documents of
    their own. Reruns agree: blocks, order and random numbers depend on the rows
    alone. Where nothing has words, targets are 0. Extra columns, clashing names
    included, are carried only if in ``keep``. Of a document, 2 copies at most.
    """
    carried = [F.col(c).alias(f"k_{c}") for c in keep]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    # row only tells rows of this written table apart
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    goal = targets(sized.select("source", "size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = cut(goal.select(F.col("source").alias("g"), "source_size", "n_docs", "target", rate.alias("rate")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK))
    units = sized.where("size > 0").join(goal, F.expr("source <=> g")).where(f"rate - floor(rate) > {EPS}")
    # a block is BLOCK rows that follow each other in the order of a hash; equal rows are told apart by their place, so that any number of them is split
    placed = cut(numbered(units.select("row", "tie", "doc_id", "source", "size", "rate"), "place", F.col("source").asc_nulls_last(), "tie", F.col("doc_id").asc_nulls_last(), "row"))
    first = placed.groupBy(F.col("source").alias("f")).agg(F.min("place").alias("begin"))
    placed = placed.join(first, F.expr("source <=> f")).withColumn("block", F.expr(f"(place - begin) DIV {BLOCK}"))
    state = cut(_fly(placed.withColumn("p", F.expr("rate - floor(rate)")), False))
    decided = [state.where("p = 0 OR p = 1").select("row", "p")]
    left = goal.agg(F.max(blocks)).first()[0] or 1
    while True:
        left = -(-left // MERGE)
        state = cut(_fly(state.where("p > 0 AND p < 1").withColumn("block", F.expr(f"block DIV {MERGE}")), left == 1))
        decided.append(state.where("p = 0 OR p = 1").select("row", "p"))
        if left == 1:
            break
    once = decided[0]
    for d in decided[1:]:
        once = once.unionAll(d)
    out = sized.join(goal, F.expr("source <=> g")).join(once.where("p = 1").select(F.col("row").alias("chosen")), F.col("row") == F.col("chosen"), "left")
    copies = F.when(F.col("size") > 0, F.floor(F.col("rate") + EPS) + F.col("chosen").isNotNull().cast("long")).otherwise(0).cast("int")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources weigh 3, 1, 2 in turn and share 150 % of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies")
