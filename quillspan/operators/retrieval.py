"""Lexical, dense and hybrid retrieval over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quillspan.functions.text import tokenize

K1, B = 1.2, 0.75
PREFETCH, DENSE_FLOOR, PER_SECTION = 50, 0.60, 2
#: Rank constant of the fusion with ranks from 0.
FUSION_K = 2
#: Ranks follow scores rounded to this many digits, so that float noise can't reorder ties.
DIGITS = 6


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, dl: one row for each distinct term of each document."""
    terms = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("t"))
    exploded = terms.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return exploded.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of documents and mean length in terms (blank ones included)."""
    return docs.select(F.size(tokenize(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_weights(index: DataFrame, stats: DataFrame) -> DataFrame:
    """BM25 document side: id, term, weight."""
    norm = 1 - B + B * F.col("dl") / F.col("avgdl")
    return index.join(F.broadcast(stats)).select("id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("weight"))  # stats is one row


#: Distinct query terms up to which they are broadcast.
BROADCAST_TERMS = 200_000


def asked_postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dl, term, tf for terms of a one-column table; and one row with a null term for every document.

    The documents are tokenised once; only the asked terms keep rows of their own.
    """
    few = terms.count() <= BROADCAST_TERMS
    asked = terms.select(F.col("term").alias("asked"))
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("t"))
    # The leading null stands for the document itself.
    each = tokens.select("id", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("t", F.array().cast("array<string>")))).alias("token"))
    met = each.join(F.broadcast(asked) if few else asked, F.col("token") == F.col("asked"), "left")
    return met.groupBy("id", "dl", F.col("asked").alias("term")).agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, *, query_id: str, query_text: str, doc_id: str, doc_text: str) -> DataFrame:
    """query_id, doc_id, score: inner join of query terms and weighted postings.

    Each distinct query term counts once, weighted by its inverse document frequency over the
    collection. One pass over the documents keeps the postings of asked terms and the
    documents' lengths; frequencies, statistics and scores are made from that. Terms too
    frequent to be selective are split by adaptive skew handling of the join.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term"))
    index = asked_postings(docs, asked.select("term").distinct(), doc_id, doc_text).persist(StorageLevel.MEMORY_AND_DISK)
    stats = index.where("term is null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    index = index.where("term is not null")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats is one row
    hits = asked.join(idf, "term").join(document_weights(index, stats), "term")
    return hits.groupBy("q", "id").agg(F.sum(F.col("idf") * F.col("weight")).alias("score")).select(F.col("q").alias(query_id), F.col("id").alias(doc_id), "score")


def top_k(scored: DataFrame, group: str, item: str, k: int, score: str = "score") -> DataFrame:
    """Best k per group with rank from 1; ties go to the smaller item."""
    w = Window.partitionBy(group).orderBy(F.desc(F.round(score, DIGITS)), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column; vectors shorter than the longest end in zeros, null ones are zero."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    # Row after row, so that values go to the places below each row's size.
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = pc.list_flatten(vectors).to_numpy()
    out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)
    return out


#: Queries of a block that are scored at a time: with 4096 vectors eight megabytes of scores.
ROWS = 256


def _scores(queries: pa.Table, vectors: pa.Table):
    """(slice, cosines) of ROWS of a block's queries with a block of vectors; a vector's own and null ones' are nan."""
    a, b = _units(queries["v"]), _units(vectors["v"])
    n = min(a.shape[1], b.shape[1])
    qid, vid = queries["id"].to_numpy(), vectors["id"].to_numpy()
    no_q, no_v = (side["v"].is_null().to_numpy() for side in (queries, vectors))
    for begin in range(0, len(qid), ROWS):
        part = slice(begin, begin + ROWS)
        out = a[part, :n] @ b[:, :n].T
        out[qid[part, None] == vid[None, :]] = np.nan
        out[no_q[part]] = np.nan
        out[:, no_v] = np.nan
        yield part, out


def _blocked(queries: DataFrame, vectors: DataFrame, run, schema: str, block: int) -> DataFrame:
    """Apply ``run`` to every pair of a query block and a vector block, dealt by a hash of the id."""
    nq, n = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    to = lambda m: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Columns are named anew, as both sides may stem from one table.
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    left = anew(queries).withColumn("qb", to(nq)).withColumn("vb", every(n))
    right = anew(vectors).withColumn("vb", to(n)).withColumn("qb", every(nq))
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(run, schema)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, *, floor: float | None = None, other_label: bool = False, block: int = 4096) -> DataFrame:
    """q, id, score, rank, ql, label: the k nearest vectors of every query by cosine.

    ``queries`` and ``vectors``: id, v and label. Every query block meets every vector block
    once, as two matrices of bounded size, and only each block's k best are merged. A vector
    never answers itself; null vectors take no part; ``floor`` drops weak pairs;
    ``other_label`` keeps only pairs of different labels.
    """

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.take(pc.sort_indices(v["id"]))  # so that a stable sort by score leaves ties to smaller ids
        qid, ids, ql, vl = q["id"].to_numpy(), v["id"].to_numpy(), q["label"].to_numpy(), v["label"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for part, s in _scores(q, v):
            if other_label:
                s[ql[part, None] == vl[None, :]] = np.nan
            s[np.isnan(s) | (s < (-2 if floor is None else floor))] = -np.inf
            for i, r in enumerate(np.round(s, DIGITS), part.start):
                # All that are as good as the k-th best, ties included, and of these the first k.
                near = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k]) if k < len(r) else np.arange(len(r))
                at = near[np.argsort(-r[near], kind="stable")[:k]]
                at = at[r[at] > -np.inf]
                found.append((np.full(len(at), i), at, s[i - part.start, at]))
        row, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"q": qid[row], "ql": ql[row], "id": ids[at], "label": vl[at], "score": score})

    kind = vectors.schema["label"].dataType.simpleString()
    found = _blocked(queries, vectors, run, f"q long, ql {kind}, id long, label {kind}, score double", block)
    return top_k(found, "q", "id", k)


def dense_counts(queries: DataFrame, vectors: DataFrame, floor: float, block: int = 4096) -> DataFrame:
    """q, best, above, scored: of all vectors of every query, counted block by block."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        best, above, scored = np.full(len(q), -np.inf), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for part, s in _scores(q, v):
            seen = ~np.isnan(s)
            best[part] = np.where(seen, s, -np.inf).max(1, initial=-np.inf)
            above[part], scored[part] = (np.where(seen, s, -2) >= floor).sum(1), seen.sum(1)
        return pa.table({"q": q["id"].to_numpy(), "best": best, "above": above, "scored": scored})

    found = _blocked(queries, vectors, run, "q long, best double, above long, scored long", block)
    return found.groupBy("q").agg(F.max("best").alias("best"), F.sum("above").alias("above"), F.sum("scored").alias("scored"))


def fuse(legs: list[DataFrame], group: str, item: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of legs that carry rank from 1."""
    both = None
    for leg in legs:
        part = leg.select(group, item, (1.0 / (FUSION_K + F.col("rank") - 1)).alias("part"))
        both = part if both is None else both.unionByName(part)
    return top_k(both.groupBy(group, item).agg(F.sum("part").alias("score")), group, item, k)


def diversify(ranked: DataFrame, group: str, section: str, k: int, per_section: int = PER_SECTION) -> DataFrame:
    """Keep at most ``per_section`` hits of a section in rank order, then backfill up to k."""
    inner = Window.partitionBy(group, section).orderBy("rank")
    out = Window.partitionBy(group).orderBy("spare", "rank")
    marked = ranked.withColumn("spare", (F.row_number().over(inner) > per_section).cast("int"))
    return marked.withColumn("delivered", F.row_number().over(out)).where(F.col("delivered") <= k)


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """recall@1, recall@5 and MRR over rows with a nullable ``rank``."""
    return ranks.agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))), 6).alias("recall_at_1"),
        F.round(F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))), 6).alias("recall_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def where_lost(dense_rank: Column, sparse_rank: Column, fused_rank: Column, delivered: Column, prefetch: int, k: int) -> Column:
    """Stage of hybrid retrieval at which a target was lost; null if it was delivered."""
    seen = (F.coalesce(dense_rank, F.lit(1 << 30)) <= prefetch) | (F.coalesce(sparse_rank, F.lit(1 << 30)) <= prefetch)
    return (
        F.when(delivered.isNotNull() & (delivered <= k), None).when(~seen, "prefetch")
        .when(fused_rank.isNull() | (fused_rank > prefetch), "fusion").otherwise("diversify")
    )


# Cumulative probabilities of the Poisson distribution of mean 1.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def poisson_draw(item: str, turn: str, seed: int) -> Column:
    """How often an item is in the sample of a round: Poisson of mean 1, by a hash of both."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", item, turn, F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def bootstrap_margin(ranks: DataFrame, rounds: int = 400, seed: int = 7) -> DataFrame:
    """Population deviation of resampled mean reciprocal ranks (``q``, ``rr``).

    Every (question, round) draws how often the question is in that round's sample from a
    Poisson distribution of mean 1, by a hash; so rounds need neither an index nor a join.
    """
    drawn = ranks.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    times = poisson_draw("q", "round", seed)
    means = drawn.withColumn("times", times).groupBy("round").agg((F.sum(F.col("times") * F.col("rr")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    return means.agg(F.count("*").alias("rounds"), F.round(F.stddev_pop("m"), 6).alias("margin"))
