"""Registered queries over the stored inverted index: build, delta, compaction, weights, scoped search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import lexical_index as L
from quillspan.operators import retrieval as R
from quillspan.plans.sqltext import tokens
from quillspan.registry import query
from quillspan.sources import store
from quillspan.sources.tables import table


def texts(spark, sf_dir):
    """Documents as the index takes them; the language is the scope."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.coalesce("lang", F.lit("")).alias("scope"), F.col("doc_id").cast("long").alias("id"), "text", "source")


def document_index(spark, sf_dir) -> L.LexicalIndex:
    """The stored index of all documents; the first caller builds it."""
    docs = texts(spark, sf_dir)
    path = f"{store.shared_dir(spark)}/lexical-{L.FORMAT}-{store.fingerprint(table(spark, sf_dir, 'documents'))}"
    index = L.LexicalIndex(spark, path)
    return index if index.segments() else L.build(docs.drop("source"), path)


def changed_index(spark, sf_dir) -> L.LexicalIndex:
    """An index of three segments: all languages but English; English added; src1 removed and src2 replaced."""
    docs = texts(spark, sf_dir)
    path = f"{store.shared_dir(spark)}/lexical-changed-{L.FORMAT}-{store.fingerprint(table(spark, sf_dir, 'documents'))}"
    index = L.LexicalIndex(spark, path)
    if len(index.segments()) != 3:
        source = F.coalesce("source", F.lit(""))
        index = L.build(docs.where("scope <> 'en'").drop("source"), path)
        L.delta(index, docs.where("scope = 'en'").drop("source"))
        anew = docs.where(source == "src2").withColumn("text", F.concat("text", F.lit(" replaced "), "source"))
        L.delta(index, anew.drop("source"), docs.where(source.isin("src1", "src2")).select("id"))
    return index


ALL = f"tok AS (SELECT coalesce(lang, '') AS scope, doc_id AS id, {tokens('text')} AS t FROM documents)"
NOW = f"""tok AS (SELECT coalesce(lang, '') AS scope, doc_id AS id, {tokens("CASE WHEN source = 'src2' THEN text || ' replaced ' || source ELSE text END")} AS t FROM documents WHERE source IS NULL OR source <> 'src1')"""
POST = "post AS (SELECT scope, id, dl, term, count(*) AS tf FROM (SELECT scope, id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL)"


@query("index_build", f"WITH {ALL}, {POST} SELECT scope, term, count(*) AS df FROM post GROUP BY ALL")
def index_build(spark, sf_dir):
    """Document frequency of every term in every language, as the stored index has it."""
    return document_index(spark, sf_dir).frequencies()


@query("index_totals", f"WITH {ALL} SELECT scope, count(*) AS n, count(t) AS measured, coalesce(sum(len(t)), 0) AS terms FROM tok GROUP BY ALL")
def index_totals(spark, sf_dir):
    """Documents and terms of every language, as the stored index has them."""
    return document_index(spark, sf_dir).totals()


@query("index_delta", f"WITH {NOW}, {POST} SELECT scope, term, count(*) AS df, count(*) AS counted, sum(tf) AS cf FROM post GROUP BY ALL")
def index_delta(spark, sf_dir):
    """After additions, removals and replacements: kept-up frequencies beside those counted from live postings."""
    index = changed_index(spark, sf_dir)
    counted = index.postings().where("bucket >= 0").groupBy("scope", "term").agg(F.count("*").alias("counted"), F.sum("tf").alias("cf"))
    return index.frequencies().join(counted, ["scope", "term"], "full")


@query("index_delta_totals", f"WITH {NOW} SELECT scope, count(*) AS n, count(t) AS measured, coalesce(sum(len(t)), 0) AS terms, max(len(t)) AS longest FROM tok GROUP BY ALL")
def index_delta_totals(spark, sf_dir):
    """After the same changes: totals kept up, and the longest live document."""
    index = changed_index(spark, sf_dir)
    return index.totals().join(index.documents().groupBy("scope").agg(F.max("dl").cast("long").alias("longest")), "scope", "full")


@query("index_compacted", f"WITH {NOW}, {POST} SELECT scope, id, len(t) AS dl, coalesce(n, 0) AS distinct_terms, coalesce(tf, 0) AS tf FROM tok LEFT JOIN (SELECT scope, id, count(*) AS n, sum(tf) AS tf FROM post GROUP BY ALL) USING (scope, id)")
def index_compacted(spark, sf_dir):
    """Documents of the index once its segments are made one."""
    index = changed_index(spark, sf_dir)
    path = f"{index.path}-compacted"
    whole = L.LexicalIndex(spark, path)
    whole = whole if whole.segments() else L.compact(index, path)
    held = whole.postings().where("bucket >= 0").groupBy("scope", "id").agg(F.count("*").alias("distinct_terms"), F.sum("tf").alias("tf"))
    out = whole.documents().join(held, ["scope", "id"], "left")
    return out.select("scope", "id", F.col("dl").cast("long").alias("dl"), F.coalesce("distinct_terms", F.lit(0)).alias("distinct_terms"), F.coalesce("tf", F.lit(0)).alias("tf"))


MEAN = "av AS (SELECT scope, avg(len(t)) AS avgdl FROM tok GROUP BY scope)"


@query("sparse_rebuild", f"WITH {NOW}, {POST}, {MEAN} SELECT id, count(*) AS terms, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS weight FROM post JOIN av USING (scope) GROUP BY id")
def sparse_rebuild(spark, sf_dir):
    """Sparse vectors of all live documents anew from stored postings, mean lengths by language."""
    index = changed_index(spark, sf_dir)
    side = L.weights(index, index.postings().where("bucket >= 0"), by_scope=True)
    return side.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


SCOPED = f"""tok AS (SELECT doc_id AS id, {tokens('text')} AS t FROM documents WHERE lang = 'en'), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term, n),
ask AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM benchmark),
score AS (SELECT item_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM ask JOIN df USING (term) JOIN post USING (term), st GROUP BY ALL)"""


@query("scoped_bm25", f"WITH {SCOPED} SELECT item_id, CAST(rank AS INTEGER) AS rank, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, id) AS rank FROM score) WHERE rank <= 5")
def scoped_bm25(spark, sf_dir):
    """Five best English documents of every benchmark text, by English statistics."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    scored = L.search(document_index(spark, sf_dir), items, query_id="item_id", query_text="text", scope="en")
    return R.top_k(scored, "item_id", "id", 5).select("item_id", "rank", "id", F.round("score", 5).alias("score"))
