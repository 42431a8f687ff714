"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Components that a block of vectors holds at most.
BLOCK_COMPONENTS = 1 << 23
#: Squared norm of integer vectors, in doubles, below which no inner product leaves 64 bits.
MOST_NORM = float(1 << 63) * (1 - 1e-9)


def quantize(vector: Column, scale: float = 256.0) -> Column:
    """Integer components floor(scale * x); null where the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the longest."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def score_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Top k of one candidate block for each query of one query block.

    The block is inverted into one posting list per dimension; each query's non-zero terms
    scatter their weighted postings into that query's dense score array, and a partition
    selection keeps the k best (ties to the smaller id).
    """
    ids, block, asked = candidates["id"].to_numpy(), _matrix(candidates["v"]), _matrix(queries["v"])
    # Terms beyond the block's longest vector meet no posting.
    width = min(block.shape[1], asked.shape[1])
    postings = []
    for t in range(width):
        at = np.flatnonzero(block[:, t])
        # A full list is addressed as a slice, which numpy scatters without an index.
        postings.append((slice(None) if len(at) == len(ids) else at, block[at, t]))
    out_q, out_id, out_s = [], [], []
    scores = np.empty(len(ids), np.int64)
    for qid, q in zip(queries["id"].to_numpy(), asked, strict=True):
        scores[:] = 0
        for t in np.flatnonzero(q[:width]):
            at, weight = postings[t]
            scores[at] += int(q[t]) * weight
        keep = np.flatnonzero(ids != qid)
        if len(keep) > k:
            own = scores[keep]
            floor = np.partition(own, len(own) - k)[len(own) - k]
            keep = keep[own >= floor]
            keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
        out_q.append(np.full(len(keep), qid))
        out_id.append(ids[keep])
        out_s.append(scores[keep])
    cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.table({"query_id": cat(out_q), "vec_id": cat(out_id), "score": cat(out_s)})


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 256.0, query_block: int = 8192, candidate_block: int = 4096,
) -> DataFrame:
    """The k highest integer inner products of every query row against all other rows.

    Returns query_id, rank, vec_id, score. Rows that repeat id and vector are counted first and
    at most ``k`` copies of one are compared, since more can't enter a result; what is left is
    dealt into blocks by a hash of id, vector and copy. Every (query block, candidate block)
    pair is one group of bounded size, and the blocks' winners are merged per query. A candidate
    is sent once for every ``query_block`` queries, a query once for every ``candidate_block``
    candidates.

    Every row is a candidate, rows that repeat an id too, but those with the query's own id;
    equal scores go by the smaller id, and rows that repeat an id are listed once for each row.
    Query rows that repeat id and vector are one query; those of one id with different vectors
    are ranked together under it. Vectors that are null or hold null or non-finite components,
    and rows without id, take no part; shorter vectors count as zero beyond their end; an empty
    table gives an empty result; other columns are not read. Scores are exact 64-bit integers:
    vectors so long that a score may not fit one (by the product of the largest norms) are
    refused with a ValueError before any work is done.
    """
    integers = quantize(F.col(vector_col), scale)
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    n, nq, width, longest = named.agg(F.count("*"), F.count_if("q"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if longest >= MOST_NORM:
        raise ValueError("scores of these vectors do not fit 64 bits; give a smaller scale")
    rows = named.groupBy("id", "v").agg(F.max("q").alias("q"), F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    # Blocks of very long vectors hold fewer of them, so that a group stays bounded in bytes.
    most = max(1, BLOCK_COMPONENTS // max(1, width))
    query_block, candidate_block = min(query_block, most), min(candidate_block, most)
    cb, qb = max(1, -(-n // candidate_block)), max(1, -(-nq // query_block))
    block = lambda m, *by: F.pmod(F.xxhash64("id", "v", *by, F.lit(7)), F.lit(m)).cast("int")
    # Columns are named anew, as both sides stem from one table.
    each = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    cand = each.select(F.col("id").alias("id"), F.col("v").alias("v"), block(cb, "copy").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    quer = rows.where("q").select(F.col("id").alias("id"), F.col("v").alias("v"), block(qb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("cb"))
    found = (
        quer.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb"))
        .applyInArrow(lambda q, c: score_block(q, c, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Top 5 of every vector whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(rows, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
