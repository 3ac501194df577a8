"""Operator 4: exact top-k by inner product over norm-sorted vectors.

Vectors are integers, floor(SCALE * x). Rows are put into bands of descending
length; the top band is searched first and gives each query a threshold, the k-th
best score so far. Inside a cell rows run by descending length in chunks: a query
is done once |q| * |c| of the chunk's longest row is under its threshold; otherwise
the partial product over the first HEAD axes of an SVD rotation plus the
Cauchy-Schwarz bound of the residuals, |q_rest| * |c_rest|, prunes single rows, and
the rest are scored exactly in integers. The rotation is fitted on a bounded sample
(SAMPLE rows by hash); any rotation gives the same result, only less pruning.

Cells hold about CELL rows of one band by hash of the id (so equal vectors spread),
queries come in blocks of about QUERIES: each task has one block and one cell.

Products whose size can reach 2^52 are summed in 64-bit integers, those that can reach 2^62
in Python's, so that every finite vector keeps its exact score. A component over 2^62 after
scaling, or a score that is no long, is an error, as the result could not hold it.

Cases: vectors that are null or hold null or non-finite components, and rows without id take
no part; vectors of different lengths are never compared. An id names one vector: a row
with the query's id is the query's own, so repeated rows are candidates of other queries
each, but make one query per id (the smallest vector, if they differ), and never candidates of
their own id; ties go to the smaller id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphward.llm.common import materialize, maybe_broadcast, ship, table

ship(__name__)

SCALE, K, EVERY = 256, 5, 50
CELL, QUERIES, CHUNK, HEAD = 4096, 2048, 512, 16
SAMPLE = 4096
#: Shares of rows above each band's lower edge, longest first.
BANDS = (0.95, 0.7, 0.4)
_LIMIT = float(1 << 62)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of int), dim and norm2 of the rows that take part."""
    x = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    large = F.exists("embedding", lambda x: F.abs(F.lit(float(SCALE)) * x.cast("double")) >= _LIMIT)
    v = F.when(large, F.raise_error(F.lit("a vector component is over 2^62 after scaling")).cast("array<long>")).otherwise(x)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select("vec_id", v.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension met in the sample, right singular vectors, strongest first."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", "norm2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "v").limit(2 * SAMPLE).collect()
    found: dict[int, list] = {}
    for r in sample:
        found.setdefault(r.dim, []).append(r.v)
    return {d: np.linalg.svd(np.array(v, float), full_matrices=True)[2].T for d, v in found.items() if d}


def products(q: np.ndarray, c: np.ndarray, norm_q: np.ndarray, norm_c: float, asked: np.ndarray) -> np.ndarray:
    """Exact inner products (long) of the rows of q and of c, where asked; norm_c: the longest of c."""
    out = np.empty((len(q), len(c)), np.int64)
    bound = norm_q * norm_c * 1.001
    for kind, rows in ((float, bound < 2**52), (np.int64, (bound >= 2**52) & (bound < 2**62)), (object, bound >= 2**62)):
        if rows.any():
            s = q[rows].astype(kind) @ c.astype(kind).T
            if kind is object and (np.where(asked[rows], abs(s), 0) >= 2**63).any():
                raise OverflowError("an inner product does not fit a long")
            out[rows] = (np.where(asked[rows], s, 0) if kind is object else s).astype(np.int64)
    return out


def search_cell(q_ids, q, floor, c_ids, c, rotation, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of at most k best candidates of each query that reach its floor."""
    none = (np.array([], np.int64),) * 3
    if not len(q) or not len(c):
        return none
    d = q.shape[1]
    norm_c = np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-norm_c, kind="stable")
    c, c_ids, norm_c = c[order], c_ids[order], norm_c[order]
    norm_q = np.sqrt((q.astype(float) ** 2).sum(1))
    r = rotation if rotation is not None else np.eye(d)
    head = min(HEAD, d)
    q_head, c_head = q @ r[:, :head], c @ r[:, :head]
    q_rest, c_rest = (np.sqrt(np.maximum(0, n**2 - (h**2).sum(1))) for n, h in ((norm_q, q_head), (norm_c, c_head)))
    floor = floor.astype(float).copy()
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(c), CHUNK):
        end = min(at + CHUNK, len(c))
        slack = 1e-6 * norm_q * norm_c[at] + 1e-3  # for rounding in the rotated sums
        active = np.flatnonzero(norm_q * norm_c[at] + slack >= floor)
        if not len(active):
            break
        bound = q_head[active] @ c_head[at:end].T + q_rest[active, None] * c_rest[None, at:end]
        alive = bound + slack[active, None] >= floor[active, None]
        cols, rows = np.flatnonzero(alive.any(0)), np.flatnonzero(alive.any(1))
        if not len(cols):
            continue
        a = active[rows]
        ok = alive[np.ix_(rows, cols)] & (c_ids[at + cols][None, :] != q_ids[a][:, None])
        s = products(q[a], c[at + cols], norm_q[a], norm_c[at], ok)
        ranked = np.where(ok, s.astype(float), -np.inf)
        if ranked.shape[1] >= k:
            kth = -np.partition(-ranked, k - 1, axis=1)[:, k - 1]
            floor[a] = np.maximum(floor[a], kth - np.abs(kth) * 1e-12)
        i, j = np.nonzero(ok & (ranked >= floor[a][:, None]))
        out_q.append(a[i])
        out_c.append(c_ids[at + cols[j]])
        out_s.append(s[i, j])
    if not out_q:
        return none
    i, ids, s = np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)
    best = np.lexsort((ids, -s, i))
    i, ids, s = i[best], ids[best], s[best]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    keep = rank < k
    return q_ids[i[keep]], ids[keep], s[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    n = len(flat)
    return np.asarray(flat.flatten()).astype(np.int64).reshape(n, -1)


def _pass(queries: DataFrame, cells: DataFrame, pairs: DataFrame, shared, k: int) -> DataFrame:
    """Top k of each query in every cell that its block meets (pairs: dim, block, cell)."""
    key = ["dim", "block", "cell"]
    pairs = maybe_broadcast(materialize(pairs.select(*key)))
    left = queries.join(pairs, ["dim", "block"]).select(*key, "vec_id", "v", "floor")
    right = cells.join(pairs, ["dim", "cell"]).select(*key, "vec_id", "v")

    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        found = (np.array([], np.int64),) * 3
        if q.num_rows and c.num_rows:
            found = search_cell(q.column("vec_id").to_numpy(), _matrix(q.column("v")), q.column("floor").to_numpy(), c.column("vec_id").to_numpy(), _matrix(c.column("v")), shared.value.get(key[0].as_py()), k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query."""
    spark = vectors.sparkSession
    rows = materialize(integers(vectors))
    edges = rows.agg(F.percentile_approx("norm2", F.array(*map(F.lit, BANDS)), 1000)).first()[0] or [0] * len(BANDS)
    shared = spark.sparkContext.broadcast(rotations(rows))
    band = sum(((F.col("norm2") < e).cast("int") for e in edges), F.lit(0))
    rows = rows.withColumn("band", band)
    sizes = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"))
    cells = rows.join(maybe_broadcast(sizes), ["dim", "band"]).withColumn("cell", F.concat_ws(":", "band", F.pmod(F.xxhash64("vec_id"), F.col("n"))))
    queries = rows.filter(is_query).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    queries = materialize(queries.join(maybe_broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("norm", norm).drop("blocks"))
    tops = cells.groupBy("dim", "band", "cell").agg(F.sqrt(F.max("norm2")).alias("top"))

    def pairs(asked, bands):
        """Blocks of queries and cells that may hold a candidate for one of them, by the cell's longest vector."""
        need = F.min(F.when(F.col("norm") > 0, F.col("floor") * (1 - 1e-6) / F.col("norm")).otherwise(-float("inf")))
        return asked.groupBy("dim", "block").agg(need.alias("need")).join(maybe_broadcast(tops.filter(bands)), "dim").filter(F.col("top") >= F.col("need"))

    top, rest = F.col("band") == 0, F.col("band") > 0
    start = queries.withColumn("floor", F.lit(-float("inf")))
    first = materialize(_best(_pass(start, cells.filter(top), pairs(start, top), shared, k), k).drop("rank"))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    later = queries.join(floors, queries.vec_id == floors.query_id, "left").select("vec_id", "dim", "v", "block", "norm", F.coalesce("floor", F.lit(-float("inf"))).alias("floor"))
    found = first.unionByName(_pass(later, cells.filter(rest), pairs(later, rest), shared, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
