"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; a segment has a mean and a deviation. Two vectors
are at least as far apart, squared, as the sum over segments of length times
((mean difference)^2 + (deviation difference)^2). With the norms, which are
known, that lower bound on the distance is an upper bound on the inner product.
Bounds are tried from few segments to many against the k-th best score already
known, and only what survives is scored exactly.

Queries are a stated set (every ``every``-th id). Rows are put into blocks of
neighbours: by the signs of their coarse segment means, then by norm. A block is
known by its greatest norm and the range of each statistic, a block of queries
also by the least score that its queries have to beat, which SAMPLE rows of the
greatest norms give. Only rows of blocks that can win are sent to each other;
such pairs meet in tasks of bounded size, and each task returns k rows for each
query. Rows that are equal count as one row with a number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, share
from quarrylens.operators.graph import numbered

#: Queries and candidates that meet in one group; queries that are scored at once; partitions for the groups at most.
QUERY_BLOCK, CANDIDATE_BLOCK, AT_ONCE, PARTITIONS = 8192, 4096, 1024, 20_000
#: Segments that blocks are known by; rows that give each query a score to beat; blocks of candidates that tasks hold at once.
COARSE, SAMPLE, ENVELOPES = 8, 2048, 50_000


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of each segment; their inner products bound those of the rows."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [root * part.mean(1), root * part.std(1)]
    return np.stack(out, 1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, counters: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of the k best of each query, ties to the smaller id; components are whole numbers in doubles."""
    width = queries.shape[1]
    if not width:
        queries, rows, width = np.zeros((len(queries), 1)), np.zeros((len(rows), 1)), 1
    # single precision is exact while no sum of products can reach 2^24
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * width
    kind = np.float32 if top < 1 << 23 else np.float64
    x, y = queries.astype(kind), rows.astype(kind)
    slack = (1e-5 if kind is np.float32 else 1e-9) * np.sqrt((queries**2).sum(1).max(initial=0) * (rows**2).sum(1).max(initial=0)) + 1e-3
    # all rows of a query's own id are struck out
    by_id = np.argsort(row_ids, kind="stable")
    lo, hi = (np.searchsorted(row_ids[by_id], query_ids, side) for side in ("left", "right"))
    oq = np.repeat(np.arange(len(query_ids)), hi - lo)
    oc = by_id[np.arange(len(oq)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
    cols = np.arange(len(row_ids))
    floor = np.full(len(queries), -np.inf, kind)
    alive = None
    for m in [m for m in (2, 8, 24) if m < width] or [1]:
        # |q|^2 + |c|^2 - 2 * bound is the lower bound of the squared distance, so bound is the upper one of the product
        bound = (statistics(queries, m).astype(kind) @ statistics(rows[cols], m).astype(kind).T) + kind(slack)
        if alive is None:
            here = np.searchsorted(cols, oc)
            bound[oq, here] = -np.inf
            if len(cols) > k:
                # the likeliest of each query, scored exactly, set the score to beat
                likely = np.argpartition(bound, len(cols) - k, axis=1)[:, -k:]
                floor = np.matmul(y[likely], x[:, :, None])[:, :, 0]
                floor = np.where(np.isneginf(np.take_along_axis(bound, likely, 1)), -np.inf, floor).min(1)
            alive = bound >= floor[:, None]
            alive[oq, here] = False
        else:
            alive &= bound >= floor[:, None]
        some = alive.any(0)
        if counters is not None:
            counters.setdefault("alive", []).append(int(alive.sum()))
        if not some.all():
            cols, alive = cols[some], alive[:, some]
    # exact scores of the survivors: one by one if they are few, else as one product of which the others are struck out
    if alive.sum() * 50 < alive.size:
        q, c = np.nonzero(alive)
        score = np.empty(len(q), np.float64)
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            score[s] = np.einsum("nd,nd->n", queries[q[s]], rows[cols[c[s]]])
    else:
        full = x @ y[cols].T
        full[~alive] = -np.inf
        if len(cols) > k:
            last = np.partition(full, len(cols) - k, axis=1)[:, -k]
            alive &= full >= last[:, None]
        q, c = np.nonzero(alive)
        score = full[q, c].astype(np.float64)
    c = cols[c]
    order = np.lexsort((row_ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k if len(q) else np.zeros(0, bool)
    return q[keep], c[keep], score[keep].astype(np.int64)


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v: array of floor(scale * x)); ids or vectors that are null or hold null or non-finite components are out."""
    x = "transform(embedding, x -> CAST(x AS DOUBLE))"
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('Infinity'))"
    return df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform({x}, x -> CAST(floor({scale} * x) AS DOUBLE))").alias("v"))


def summarised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, m, d) with norm, s (means and deviations of COARSE segments) and the signs of the means as code; written down."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            d = batch.column("d").to_numpy()
            norm, code, stats = np.zeros(len(d)), np.zeros(len(d), np.int64), [None] * len(d)
            for width in np.unique(d):
                at = np.flatnonzero(d == width)
                if not width:
                    for i in at:
                        stats[i] = []
                    continue
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
                norm[at] = np.sqrt((x**2).sum(1))
                s = statistics(x, COARSE)
                code[at] = (s[:, ::2] > 0) @ (1 << np.arange(s.shape[1] // 2))
                for i, row in zip(at, s):
                    stats[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "v", "m", "d")] + [pa.array(norm), pa.array(code), pa.array(stats, pa.list_(pa.float64()))], names=["vec_id", "v", "m", "d", "norm", "code", "s"])

    return cut(vectors.mapInArrow(run, "vec_id long, v array<double>, m long, d int, norm double, code long, s array<double>"))


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with the number of their block: ``size`` rows that follow each other by length, code and norm, whatever their ids."""
    order = ("d", "code", F.col("norm").desc(), "vec_id", F.xxhash64("v"))
    return cut(numbered(vectors, "_place", *order).withColumn(name, F.expr(f"_place DIV {size}")).drop("_place"))


def with_floor(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Queries with floor: the k-th best score over SAMPLE rows of great norms, which its own k best reach too; without so many rows none."""
    some = vectors.orderBy(F.col("norm").desc(), "vec_id", F.xxhash64("v")).limit(SAMPLE).select("vec_id", "v", "d").collect()
    by_width: dict[int, tuple] = {}
    for width in {r.d for r in some}:
        rows = [r for r in some if r.d == width]
        by_width[width] = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], float).reshape(len(rows), width)
    shared = share(vectors.sparkSession, by_width)

    def run(batches):
        for batch in batches:
            d, ids = batch.column("d").to_numpy(), batch.column("vec_id").to_numpy()
            floor = np.full(len(d), -np.inf)
            for width in np.unique(d):
                if width not in shared() or len(shared()[width][0]) < k:
                    continue
                theirs, rows = shared()[width]
                at = np.flatnonzero(d == width)
                for lo in range(0, len(at), AT_ONCE):
                    i = at[lo : lo + AT_ONCE]
                    x = batch.column("v").take(pa.array(i)).flatten().to_numpy(zero_copy_only=False).reshape(len(i), width)
                    score = x @ rows.T
                    score[ids[i][:, None] == theirs[None, :]] = -np.inf
                    floor[i] = np.partition(score, len(theirs) - k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return queries.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in queries.dtypes) + ", floor double")


def envelopes(rows: DataFrame, name: str) -> DataFrame:
    """(d, block, norm: the greatest, lo, hi: of each statistic, floor: the least) of each block."""
    with_ = rows.withColumn("floor", F.lit(0.0))
    if "floor" in rows.columns:
        # per unit of a query's length, so that short queries do not lower what long ones have to beat; a null vector takes part everywhere
        own = F.when(F.col("norm") > 0, F.col("norm"))
        with_ = rows.withColumns({"floor": F.coalesce(F.col("floor") / own, F.lit(float("-inf"))), "s": F.transform("s", lambda x: F.coalesce(x / own, F.lit(0.0))), "norm": F.lit(1.0)})

    def run(part: pa.Table) -> pa.Table:
        s = np.array(part["s"].to_pylist(), float).reshape(part.num_rows, -1)
        lo, hi = (s.min(0), s.max(0)) if s.shape[1] else (np.empty(0),) * 2
        return pa.table({"d": part["d"][:1], name: part[name][:1], "norm": [max(part["norm"].to_pylist())], "lo": [lo], "hi": [hi], "floor": [min(part["floor"].to_pylist())]})

    return cut(with_.select("d", name, "norm", "s", "floor").groupBy("d", name).applyInArrow(run, f"d int, {name} long, norm double, lo array<double>, hi array<double>, floor double"))


def can_win(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(d, qb, cb): blocks of which a candidate may reach the score that a query has to beat, by norms and ranges.

    Candidates' blocks go to the tasks ENVELOPES at a time: some 300 bytes each.
    """
    spark = queries.sparkSession
    last = candidates.agg(F.max("cb")).first()[0]
    out = spark.createDataFrame([], "d int, qb long, cb long")
    for lo in range(0, -1 if last is None else last + 1, ENVELOPES):
        held: dict[int, tuple] = {}
        part = candidates.where(f"cb >= {lo} AND cb < {lo + ENVELOPES}").toArrow()
        d = part["d"].to_numpy()
        for width in np.unique(d):
            at = np.flatnonzero(d == width)
            rows = part.take(pa.array(at))
            held[int(width)] = rows["cb"].to_numpy(), rows["norm"].to_numpy(), *(np.array(rows[x].to_pylist(), float).reshape(len(at), -1) for x in ("lo", "hi"))
        shared = share(spark, held)

        def run(batches, shared=shared):
            for batch in batches:
                got: list[list] = [[], [], []]
                for r in batch.to_pylist():
                    if r["d"] not in shared():
                        continue
                    cb, norm, low, high = shared()[r["d"]]
                    a, b = np.array(r["lo"]), np.array(r["hi"])
                    top = np.maximum(np.maximum(a * low, a * high), np.maximum(b * low, b * high)).sum(1) if len(a) else np.zeros(len(cb))
                    slack = 1e-9 * r["norm"] * norm + 1e-3
                    win = cb[np.minimum(top, r["norm"] * norm) + slack >= r["floor"]].tolist()
                    got = [g + x for g, x in zip(got, ([r["d"]] * len(win), [r["qb"]] * len(win), win))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.int32(), pa.int64(), pa.int64()))], names=["d", "qb", "cb"])

        out = out.unionByName(queries.select("d", "qb", "norm", "lo", "hi", "floor").mapInArrow(run, "d int, qb long, cb long"))
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score over (vec_id, v), for ids divisible by ``every`` against all others.

    No row of a query's own id is a candidate. Rows that repeat both id and vector
    are candidates and queries as often as they stand there; rows that share an id
    only are rows of their own, and all queries of one id share its k places. Only
    vectors of equal length are compared; those of length 0 score 0. Ties go to
    the smaller vec_id.
    """
    vectors = summarised(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("m"), F.size(F.first("v")).alias("d")))
    is_query = F.col("vec_id") % every == 0
    c = blocks(vectors, CANDIDATE_BLOCK, "cb")
    q = blocks(with_floor(vectors.where(is_query), vectors, k), QUERY_BLOCK, "qb")
    pairs = cut(can_win(envelopes(q, "qb"), envelopes(c, "cb")))
    groups = pairs.count()
    row = ["role", "d", "vec_id", "v", "m", "qb", "cb"]
    both = q.withColumn("role", F.lit(0)).join(pairs, ["d", "qb"]).select(*row).unionAll(c.withColumn("role", F.lit(1)).join(pairs, ["d", "cb"]).select(*row))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids, many = table["vec_id"].to_numpy(), table["m"].to_numpy()
        width = table["d"][0].as_py()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(a) or not len(b):
            return schema.empty_table()
        out = []
        for lo in range(0, len(a), AT_ONCE):
            at = a[lo : lo + AT_ONCE]
            i, j, score = best(v[at], ids[at], v[b], ids[b], k)
            out.append(pa.table([ids[at][i], ids[b][j], score, np.minimum(many[at][i] * many[b][j], k)], schema=schema))
        return pa.concat_tables(out)

    # a fixed number of partitions, which adaptive execution does not merge into one task; more than groups, so that few share one
    spread = both.repartition(max(1, min(4 * groups, PARTITIONS)), "d", "qb", "cb")
    near = spread.groupBy("d", "qb", "cb").applyInArrow(run, "query_id long, vec_id long, score long, n long")
    near = near.withColumn("_", F.explode(F.expr("sequence(1L, n)")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every vec_id divisible by 20."""
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
