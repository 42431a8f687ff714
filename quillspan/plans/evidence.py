"""Registered evidence queries: orders stand for questions, line items for hits and claims,
parts for chunks, suppliers for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import evidence as E
from quillspan.operators import mutations as K
from quillspan.plans.retrieval import HYB, RANKED, VEC, legs, nearest
from quillspan.registry import query
from quillspan.sources.tables import table


@query("hydrated_hits", "SELECT o_orderkey AS q, l_partkey AS chunk_id, s_suppkey AS document_id, p_name AS text, s_name AS title FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = p_partkey % 150 WHERE s_nationkey = 3 AND s_suppkey % 2 = 1")
def hydrated_hits(spark, sf_dir):
    """Hits of one library and tenant with text and title; chunks without a document go."""
    hits = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("q"), F.col("l_partkey").alias("chunk_id"))
    p, s = table(spark, sf_dir, "part", "p_partkey", "p_name"), table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    chunks = p.select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 150).alias("document_id"), F.col("p_name").alias("text"))
    documents = s.select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("library_id"), (F.col("s_suppkey") % 2).alias("tenant_id"))
    return E.hydrate(hits, chunks, documents, 3, 1).select("q", "chunk_id", "document_id", "text", "title")


HITS = "h AS (SELECT l_orderkey AS q, l_partkey AS chunk_id, min(l_linenumber) FILTER (WHERE l_returnflag <> 'A') AS v, min(l_linenumber) FILTER (WHERE l_returnflag = 'A') AS g FROM lineitem GROUP BY ALL), x AS (SELECT q, chunk_id, CASE WHEN v IS NULL THEN 'graph' ELSE 'vector' END AS source, row_number() OVER (PARTITION BY q ORDER BY v IS NULL, coalesce(v, g), chunk_id) AS place FROM h), ev AS (SELECT * FROM x WHERE place <= 3)"


def expanded(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    h = li.select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    return E.expand(h.where("l_returnflag <> 'A'"), h.where("l_returnflag = 'A'"), 3)


@query("graph_expansion", f"WITH {HITS} SELECT q, chunk_id, source, CAST(place AS INTEGER) AS place FROM ev")
def graph_expansion(spark, sf_dir):
    """Three pieces of evidence of every question: vector hits, then graph hits."""
    return expanded(spark, sf_dir)


CLAIMS = "cl AS (SELECT DISTINCT l_partkey AS chunk_id, l_suppkey * 10 + l_linenumber AS claim_id, round(1 - 4 * l_discount, 6) AS confidence FROM lineitem)"


@query("evidence_claims", f"WITH {HITS}, {CLAIMS}, e AS (SELECT q, chunk_id, count(*) OVER (PARTITION BY q) AS n FROM ev), j AS (SELECT e.q, e.n, cl.*, row_number() OVER (PARTITION BY e.q ORDER BY confidence DESC, chunk_id, claim_id) AS g FROM e JOIN cl USING (chunk_id) WHERE confidence >= 0.7), c AS (SELECT *, row_number() OVER (PARTITION BY q, chunk_id ORDER BY confidence DESC, claim_id) AS place FROM j WHERE g <= 2 * n) SELECT q, chunk_id, claim_id, CAST(place AS INTEGER) AS place FROM c WHERE place <= 2")
def evidence_claims(spark, sf_dir):
    """At most two claims of each piece of evidence, from a budget of the whole question."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    claims = li.select(F.col("l_partkey").alias("chunk_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.round(1 - 4 * F.col("l_discount"), 6).alias("confidence")).distinct()
    return E.attach_claims(expanded(spark, sf_dir), claims, 0.7, 2).select("q", "chunk_id", "claim_id", "place")


@query("verified_citations", f"WITH {HITS}, cc AS (SELECT DISTINCT l_orderkey AS q, l_linenumber * 1000000 + l_partkey AS pos, l_partkey AS chunk_id, l_linestatus AS claim FROM lineitem), j AS (SELECT cc.*, ev.chunk_id IS NOT NULL AS known, row_number() OVER (PARTITION BY cc.q, cc.chunk_id, claim ORDER BY pos) AS nth FROM cc LEFT JOIN ev ON ev.q = cc.q AND ev.chunk_id = cc.chunk_id) SELECT q, pos, chunk_id, CASE WHEN NOT known THEN 'invented' WHEN chunk_id % 11 = 0 THEN 'unlocated' WHEN nth > 1 THEN 'repeated' ELSE 'kept' END AS verdict FROM j")
def verified_citations(spark, sf_dir):
    """Verdict on every claimed citation against the question's evidence."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    claimed = li.select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("chunk_id"), F.col("l_linestatus").alias("claim")).distinct()
    located = expanded(spark, sf_dir).withColumn("locator", F.when(F.col("chunk_id") % 11 != 0, "p. 1"))
    return E.verify_citations(claimed, located).select("q", "pos", "chunk_id", "verdict")


@query("composed_search", HYB + ", best AS (SELECT q.vec_id AS item_id, max(round(list_cosine_similarity(q.e, c.e), 12)) >= 0.6 AS is_on FROM v q JOIN v c ON q.vec_id <> c.vec_id JOIN benchmark b ON b.item_id = q.vec_id GROUP BY 1), dn2 AS (SELECT item_id, doc_id, rank FROM dn JOIN v q ON q.vec_id = item_id JOIN v c ON c.vec_id = doc_id WHERE list_cosine_similarity(q.e, c.e) >= 0.6), f2 AS (SELECT item_id, doc_id, sum(1.0 / (1 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM dn2 UNION ALL SELECT item_id, doc_id, rank FROM lx) GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f2), m2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, doc_id % 5 ORDER BY rank) > 2 AS INTEGER) AS spare FROM r2 WHERE rank <= 40), d2 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY spare, rank) AS place FROM m2) SELECT item_id AS q, doc_id AS id, CAST(place AS INTEGER) AS place, 'answered' AS verdict FROM d2 JOIN best USING (item_id) WHERE place <= 8 AND is_on UNION ALL SELECT item_id, doc_id, CAST(rank AS INTEGER), 'off_corpus' FROM dn JOIN best USING (item_id) WHERE rank <= 3 AND NOT is_on")
def composed_search(spark, sf_dir):
    """Whole searches: gate, both legs, five times oversampled fusion, two of a section."""
    near, lex = (df.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "score", "rank") for df in legs(spark, sf_dir))
    return E.search(near, lex, F.col("id") % 5, 8, oversample=5)


@query("search_diagnostics", f"WITH {VEC}, {RANKED} SELECT q, round(max(score), 5) AS best, round(min(score), 5) AS last, count(DISTINCT label) AS sections, CAST(min(CASE WHEN id % 3 = 0 THEN rank END) AS INTEGER) AS literal FROM r WHERE rank <= 10 GROUP BY q")
def search_diagnostics(spark, sf_dir):
    """Best and last score, sections, and rank of the first hit with a planted term, of ten hits."""
    ranked = nearest(spark, sf_dir, 10)
    d = E.diagnose(ranked, F.col("label")).select("q", F.round("best", 5).alias("best"), F.round("last", 5).alias("last"), "sections")
    return d.join(E.literal_rank(ranked, F.col("id") % 3 == 0).withColumnRenamed("rank", "literal"), "q")


@query("index_points", "WITH j AS (SELECT d.doc_id, d.source, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 10 = 0 THEN 'model' WHEN e.vec_id % 10 = 1 THEN 'width' ELSE 'indexed' END AS verdict FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) SELECT source, verdict, count(*) AS n FROM j GROUP BY ALL")
def index_points(spark, sf_dir):
    """Chunks that become points of the index's vector space, and why others do not."""
    d, v = table(spark, sf_dir, "documents", "doc_id", "source"), table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    chunks = d.select("source", F.col("doc_id").alias("key"), F.col("doc_id").alias("document_id"), F.lit(0).alias("index"))
    width = F.when(F.col("vec_id") % 10 == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    vectors = v.select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 10 == 0, "other").otherwise("own").alias("model"), width.alias("v"))
    points, refused = E.build_index(chunks, vectors, "own", 64)
    both = points.select("source", F.lit("indexed").alias("verdict")).unionByName(refused.select("source", F.col("reason").alias("verdict")))
    return both.groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query("embedding_bill", "WITH t AS (SELECT text, count(*) AS n, max(n_chars) AS chars, min(doc_id) % 3 = 0 AS hit FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS texts, count_if(hit) AS hits, count_if(NOT hit) AS misses, CAST(coalesce(sum(chars) FILTER (WHERE NOT hit), 0) AS BIGINT) AS chars FROM t")
def embedding_bill(spark, sf_dir):
    """What embedding all documents would cost in texts and characters, with a third of contents cached."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select("doc_id", F.sha2("text", 256).alias("key"), F.col("n_chars").alias("chars"))
    cache = d.groupBy("key").agg(F.min("doc_id").alias("first")).where("first % 3 = 0")
    return E.embedding_bill(d, cache)


@query("filtered_count", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def filtered_count(spark, sf_dir):
    """Exact count by an equality filter."""
    c = table(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey")
    return c.where(K.equality({"c_nationkey": 7, "c_mktsegment": "BUILDING"})).agg(F.count("*").alias("n"))
