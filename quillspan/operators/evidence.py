"""From hits to evidence: hydration, graph expansion, claims, citations, and whole searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import retrieval as R

#: Nearest hits that an off-topic question still shows.
NEARBY = 3


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, library, tenant) -> DataFrame:
    """Hits with text and title, of one library and tenant only.

    A chunk without an owning document can't be attributed, and goes.
    """
    owned = documents.where((F.col("library_id") == library) & (F.col("tenant_id") == tenant)).select("document_id", "title")
    return hits.join(chunks, "chunk_id").join(owned, "document_id")


def expand(vector_hits: DataFrame, graph_hits: DataFrame, k: int) -> DataFrame:
    """q, chunk_id, source, place: vector hits by rank, then graph hits that are no repeats, k of a question.

    Both sides: q, chunk_id, rank. A graph hit is only topically adjacent, so it never comes
    before a vector hit.
    """
    both = vector_hits.select("q", "chunk_id", "rank", F.lit(0).alias("route")).unionByName(graph_hits.select("q", "chunk_id", "rank", F.lit(1).alias("route")))
    first = both.groupBy("q", "chunk_id").agg(F.min(F.struct("route", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("at", "chunk_id"))
    out = first.withColumn("place", place).where(F.col("place") <= k)
    return out.select("q", "chunk_id", F.when(F.col("at.route") == 0, "vector").otherwise("graph").alias("source"), "place")


def attach_claims(evidence: DataFrame, claims: DataFrame, floor: float, per_chunk: int) -> DataFrame:
    """Claims of each question's evidence (q, chunk_id): first the most confident ``per_chunk`` times
    the chunks of the question, then at most ``per_chunk`` of a chunk.

    ``claims``: chunk_id, claim_id, confidence. The first cut is over the whole question, so
    that a heavily annotated chunk can spend the budget of others but not exceed its own.
    """
    j = evidence.select("q", "chunk_id").distinct().withColumn("chunks", F.count("*").over(Window.partitionBy("q"))).join(claims.where(F.col("confidence") >= floor), "chunk_id")
    best = [F.desc("confidence"), "chunk_id", "claim_id"]
    cut = j.withColumn("_g", F.row_number().over(Window.partitionBy("q").orderBy(*best))).where(F.col("_g") <= F.col("chunks") * per_chunk)
    cut = cut.withColumn("place", F.row_number().over(Window.partitionBy("q", "chunk_id").orderBy(*best)))
    return cut.where(F.col("place") <= per_chunk).drop("_g", "chunks")


def verify_citations(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed citations (q, pos, chunk_id, claim) with ``verdict``: kept, invented, unlocated or repeated.

    Invented names a chunk that was not retrieved for the question; unlocated one without a
    locator; of equal (chunk, claim) pairs the first stays.
    """
    known = evidence.select("q", "chunk_id", "locator", F.lit(True).alias("known")).dropDuplicates(["q", "chunk_id"])
    j = claimed.withColumn("claim", F.trim("claim")).join(known, ["q", "chunk_id"], "left")
    usable = F.col("known").isNotNull() & (F.coalesce("locator", F.lit("")) != "")
    nth = F.row_number().over(Window.partitionBy("q", "chunk_id", "claim").orderBy("pos"))
    verdict = F.when(F.col("known").isNull(), "invented").when(~usable, "unlocated").when(nth > 1, "repeated").otherwise("kept")
    return j.withColumn("verdict", verdict).drop("known")


def search(near: DataFrame, lexical: DataFrame, section: Column, k: int, *, floor: float = R.DENSE_FLOOR, oversample: int = 1) -> DataFrame:
    """q, id, place, verdict: a whole search from both ranked legs (q, id, score, rank).

    A question whose best dense score is under the floor is ``off_corpus`` and gets its
    ``NEARBY`` nearest; others are ``answered`` by both legs fused (the floor cuts the dense
    leg only), ``oversample`` times k wide, at most two of a section before backfill.
    """
    best = near.groupBy("q").agg((F.max("score") >= floor).alias("on"))
    fused = R.fuse([near.where(F.col("score") >= floor), lexical], "q", "id", max(k * oversample, k))
    told = R.diversify(fused.withColumn("section", section), "q", "section", k).select("q", "id", F.col("delivered").alias("place"))
    told = told.join(best, "q", "left").where(F.coalesce("on", F.lit(False))).select("q", "id", "place", F.lit("answered").alias("verdict"))
    off = near.join(best, "q").where(~F.col("on") & (F.col("rank") <= NEARBY))
    return told.unionByName(off.select("q", "id", F.col("rank").alias("place"), F.lit("off_corpus").alias("verdict")))


def diagnose(ranked: DataFrame, section: Column) -> DataFrame:
    """Best and last score and the distinct sections of each question's hits (q, rank, score)."""
    return ranked.withColumn("_s", section).groupBy("q").agg(F.max("score").alias("best"), F.min("score").alias("last"), F.countDistinct("_s").alias("sections"))


def literal_rank(ranked: DataFrame, has_term: Column) -> DataFrame:
    """Rank of the first hit of each question that holds its literal term; null if none does."""
    return ranked.groupBy("q").agg(F.min(F.when(has_term, F.col("rank"))).alias("rank"))


def build_index(chunks: DataFrame, vectors: DataFrame, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(points, refused): chunks (document_id, index, key) with their vectors (key, model, v).

    A point needs a vector of the index's own space; what has none, or one of another model
    or width, is refused with the reason, so that spaces never mix.
    """
    j = chunks.join(vectors.select("key", F.col("model").alias("_model"), F.col("v").alias("vector")), "key", "left")
    reason = F.when(F.col("vector").isNull(), "missing").when(F.col("_model") != model, "model").when(F.size("vector") != dims, "width")
    j = j.withColumn("reason", reason)
    return j.where("reason is null").drop("reason", "_model"), j.where("reason is not null").drop("vector", "_model")


def embedding_bill(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: texts, hits, misses, and characters to embed. Equal texts (by ``key``) are embedded once."""
    each = texts.groupBy("key").agg(F.count("*").alias("n"), F.max("chars").alias("chars")).join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left")
    missed = F.col("hit").isNull()
    return each.agg(F.sum("n").alias("texts"), F.count_if(~missed).alias("hits"), F.count_if(missed).alias("misses"), F.coalesce(F.sum(F.when(missed, F.col("chars"))), F.lit(0)).alias("chars"))
