"""Registered retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions.text import fnv1a, tokenize
from quillspan.operators import lexical_index as L
from quillspan.operators import retrieval as R
from quillspan.plans.lexical import document_index
from quillspan.plans.sqltext import tokens
from quillspan.registry import query
from quillspan.sources.tables import table

INDEX = f"""
tok AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term, n),
w AS (SELECT doc_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM post, st),
ask AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM benchmark),
score AS (SELECT item_id, doc_id, sum(idf * weight) AS score FROM ask JOIN df USING (term) JOIN w USING (term) GROUP BY ALL)
"""


def lexical(spark, sf_dir, k):
    """Best documents of every benchmark text, from the stored index."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    scored = L.search(document_index(spark, sf_dir), items, query_id="item_id", query_text="text")
    return R.top_k(scored.withColumnRenamed("id", "doc_id"), "item_id", "doc_id", k)


@query("bm25_topk", f"WITH {INDEX} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM score) WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """Ten best documents for every benchmark text."""
    return lexical(spark, sf_dir, 10).select("item_id", "rank", "doc_id", F.round("score", 5).alias("score"))


@query("token_stats", f"SELECT lang, count(*) AS docs, round(avg(len(t)), 4) AS avg_tokens, max(len(t)) AS max_tokens, sum(len(list_distinct(t))) AS distinct_sum FROM (SELECT lang, {tokens('text')} AS t FROM documents) GROUP BY lang")
def token_stats(spark, sf_dir):
    """Average document length and vocabulary use by language."""
    t = table(spark, sf_dir, "documents", "lang", "text").select("lang", tokenize(F.col("text")).alias("t"))
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg(F.size("t")), 4).alias("avg_tokens"), F.max(F.size("t")).cast("long").alias("max_tokens"), F.sum(F.size(F.array_distinct("t"))).alias("distinct_sum"))


@query("term_document_frequency", f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_document_frequency(spark, sf_dir):
    """Document and collection frequency of every index term."""
    index = R.postings(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("term_ids")
def term_ids(spark, sf_dir):
    """32-bit FNV-1a id of every distinct term (checked against Python in the tests)."""
    t = table(spark, sf_dir, "documents", "text").select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    return t.select("term", fnv1a(F.col("term")).alias("term_id"))


VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), pr AS (SELECT q.vec_id AS q, q.label AS ql, c.vec_id AS id, c.label AS label, list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0)"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS rank FROM pr)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def nearest(spark, sf_dir, k, **kw):
    """The stated query vectors (every twentieth) and their best of all others."""
    v = vectors(spark, sf_dir)
    return R.dense_top(v.where("id % 20 = 0"), v, k, **kw)


def counts(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.dense_counts(v.where("id % 20 = 0"), v, R.DENSE_FLOOR)


@query("dense_topk", f"WITH {VEC}, {RANKED} SELECT q, CAST(rank AS INTEGER) AS rank, id, round(score, 5) AS score FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """Ten nearest vectors by cosine."""
    return nearest(spark, sf_dir, 10).select("q", "rank", "id", F.round("score", 5).alias("score"))


@query("topicality_gate", f"WITH {VEC} SELECT q, round(max(score), 5) AS best, max(score) >= 0.6 AS on_topic FROM pr GROUP BY q")
def topicality_gate(spark, sf_dir):
    """Whether any vector is near enough for a query to be on topic."""
    return counts(spark, sf_dir).select("q", F.round("best", 5).alias("best"), (F.col("best") >= R.DENSE_FLOOR).alias("on_topic"))


@query("noise_floor", f"WITH {VEC} SELECT round(max(score), 5) AS noise_floor, count(DISTINCT q) AS probes FROM pr WHERE ql <> label")
def noise_floor(spark, sf_dir):
    """Best score of a probe outside its topic."""
    return nearest(spark, sf_dir, 1, other_label=True).agg(F.round(F.max("score"), 5).alias("noise_floor"), F.count("q").alias("probes"))


@query("dense_floor_count", f"WITH {VEC} SELECT q, count_if(score >= 0.6) AS above, count(*) AS scored FROM pr GROUP BY q")
def dense_floor_count(spark, sf_dir):
    """Vectors above the dense floor for each query."""
    return counts(spark, sf_dir).select("q", "above", "scored")


DIV = "d AS (SELECT *, CAST(row_number() OVER (PARTITION BY q, label ORDER BY rank) > 2 AS INTEGER) AS spare FROM r WHERE rank <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY spare, rank) AS delivered FROM d)"


@query("diversify_per_section", f"WITH {VEC}, {RANKED}, {DIV} SELECT q, CAST(delivered AS INTEGER) AS delivered, id, label, spare FROM o WHERE delivered <= 10")
def diversify_per_section(spark, sf_dir):
    """Ten hits with at most two of a section before backfill."""
    ranked = nearest(spark, sf_dir, R.PREFETCH)
    return R.diversify(ranked, "q", "label", 10).select("q", "delivered", "id", "label", "spare")


FIRST = "f AS (SELECT v.vec_id AS q, (SELECT min(rank) FROM r WHERE r.q = v.vec_id AND r.ql = r.label AND r.rank <= 10) AS rank FROM v WHERE v.vec_id % 20 = 0)"


def first_hits(spark, sf_dir):
    """Rank of the first hit with the query's own label, or null."""
    ranked = nearest(spark, sf_dir, 10)
    return ranked.groupBy("q").agg(F.min(F.when(F.col("ql") == F.col("label"), F.col("rank"))).alias("rank"))


@query("recall_mrr", f"WITH {VEC}, {RANKED}, {FIRST} SELECT count(*) AS questions, round(avg(coalesce(CAST(rank = 1 AS DOUBLE), 0)), 6) AS recall_at_1, round(avg(coalesce(CAST(rank <= 5 AS DOUBLE), 0)), 6) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM f")
def recall_mrr(spark, sf_dir):
    """recall@1, recall@5 and MRR@10 of dense retrieval, a hit being a vector of the same label."""
    return R.rank_metrics(first_hits(spark, sf_dir))


DRAWS = "dr AS (SELECT q, round, rr, CAST('0x' || substr(md5(q || ':' || round || ':7'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT q, coalesce(1.0 / rank, 0) AS rr, unnest(generate_series(0, 399)) AS round FROM f))"
TIMES = " + ".join(f"CAST(u >= {p} AS INTEGER)" for p in R.POISSON)


@query("bootstrap_margin", f"WITH {VEC}, {RANKED}, {FIRST}, {DRAWS}, m AS (SELECT round, sum(({TIMES}) * rr) / nullif(sum({TIMES}), 0) AS m FROM dr GROUP BY round) SELECT count(*) AS rounds, round(stddev_pop(m), 6) AS margin FROM m")
def bootstrap_margin(spark, sf_dir):
    """Noise margin of the mean reciprocal rank over 400 resamples."""
    return R.bootstrap_margin(first_hits(spark, sf_dir).select("q", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr")))


HYB = f"WITH {INDEX}, v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), dn AS (SELECT * FROM (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.vec_id) AS rank FROM v q JOIN v c ON q.vec_id <> c.vec_id JOIN benchmark b ON b.item_id = q.vec_id) WHERE rank <= 50), lx AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM score) WHERE rank <= 50), fu AS (SELECT item_id, doc_id, sum(1.0 / (1 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM dn UNION ALL SELECT item_id, doc_id, rank FROM lx) GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM fu)"


def legs(spark, sf_dir):
    """Dense and lexical legs for the benchmark items; vector ids stand for document ids."""
    v = vectors(spark, sf_dir)
    asked = v.join(table(spark, sf_dir, "benchmark", "item_id"), F.col("item_id") == F.col("id"), "left_semi")
    near = R.dense_top(asked, v, R.PREFETCH).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")
    return near, lexical(spark, sf_dir, R.PREFETCH)


@query("hybrid_rrf", HYB + " SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM fr WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    """Both legs fused by reciprocal rank."""
    return R.fuse(list(legs(spark, sf_dir)), "item_id", "doc_id", 10).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("retrieval_probe", HYB + " SELECT item_id, dn.rank AS dense_rank, lx.rank AS sparse_rank, fr.rank AS fused_rank, CASE WHEN fr.rank <= 10 THEN NULL WHEN coalesce(dn.rank, 1000000) > 50 AND coalesce(lx.rank, 1000000) > 50 THEN 'prefetch' WHEN fr.rank IS NULL OR fr.rank > 50 THEN 'fusion' ELSE 'diversify' END AS lost_at FROM benchmark b LEFT JOIN dn USING (item_id) LEFT JOIN lx USING (item_id, doc_id) LEFT JOIN fr USING (item_id, doc_id) WHERE dn.rank IS NOT NULL")
def retrieval_probe(spark, sf_dir):
    """Where each dense candidate of an item ends up in hybrid retrieval."""
    near, lex = legs(spark, sf_dir)
    fused = R.fuse([near, lex], "item_id", "doc_id", 2 * R.PREFETCH)
    r = lambda df, name: df.select("item_id", "doc_id", F.col("rank").alias(name))
    j = r(near, "dense_rank").join(r(lex, "sparse_rank"), ["item_id", "doc_id"], "left").join(r(fused, "fused_rank"), ["item_id", "doc_id"], "left")
    return j.select("item_id", "dense_rank", "sparse_rank", "fused_rank", R.where_lost(F.col("dense_rank"), F.col("sparse_rank"), F.col("fused_rank"), F.col("fused_rank"), R.PREFETCH, 10).alias("lost_at"))


@query("leakage_gap", f"WITH {VEC}, {RANKED}, {FIRST} SELECT round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, round(avg(CASE WHEN rank > 1 THEN 1.0 / rank ELSE 0 END), 4) AS mrr_below_first, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END) > 0.02 AS leaky FROM f")
def leakage_gap(spark, sf_dir):
    """Scores to four digits and whether first ranks alone make a gap of 0.02."""
    f = first_hits(spark, sf_dir)
    return f.agg(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(F.when(F.col("rank") > 1, 1.0 / F.col("rank")).otherwise(0.0)), 4).alias("mrr_below_first"), (F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)) > 0.02).alias("leaky"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':20260726'), doc_id) AS k, (SELECT count(DISTINCT lang) FROM documents) AS kinds FROM documents) WHERE k <= greatest(1, 40 // kinds)")
def stratified_sample(spark, sf_dir):
    """Seeded sample of 40 documents, an equal share of each language (a sampling operator)."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang")
    kinds = d.select("lang").distinct().count()
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":20260726")), 256), "doc_id")
    return d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(1, 40 // kinds)).select("doc_id", "lang")
