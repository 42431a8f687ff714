"""Registered rule, profile, semantic, source and extra window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import chunking as C
from quillspan.operators import rules as L
from quillspan.operators import semantics as M
from quillspan.plans.chunking import PARA, paras
from quillspan.registry import query
from quillspan.sources import files as S
from quillspan.sources.tables import table


@query("kind_pattern_check", f"WITH {PARA} SELECT doc_id, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0 END), 6) AS ratio, round(avg(CASE WHEN regexp_matches(text, '[0-9]') THEN CASE WHEN contains(text, '%') THEN 1.0 ELSE 0 END END), 6) AS purity FROM p GROUP BY doc_id")
def kind_pattern_check(spark, sf_dir):
    """Hit ratio and purity of a pattern (digits) by an independent signal (percent signs)."""
    g = L.kind_pattern_check(paras(spark, sf_dir), "[0-9]", F.col("text").contains("%"))
    return g.select("doc_id", F.round("ratio", 6).alias("ratio"), F.round("purity", 6).alias("purity"))


@query("heading_pattern_check", f"WITH {PARA} SELECT doc_id, count(*) AS paragraphs, count_if(regexp_matches(text, '^(?:[A-Z][a-z]+ [a-z]+\\.)')) AS hits, count_if(regexp_matches(text, '^(?:[A-Z][a-z]+ [a-z]+\\.)') AND length(text) > 120) AS too_long FROM p GROUP BY doc_id")
def heading_pattern_check(spark, sf_dir):
    """Matches of a pattern for unnumbered headings, by document."""
    return L.heading_pattern_check(paras(spark, sf_dir), r"[A-Z][a-z]+ [a-z]+\.").select("doc_id", "paragraphs", "hits", "too_long")


@query("heading_sequence_check")
def heading_sequence_check(spark, sf_dir):
    """Order of level-1 numbers, by document (none in this corpus; planted ones in the tests)."""
    return L.heading_sequence_check(paras(spark, sf_dir))


@query("correction_batches")
def correction_batches(spark, sf_dir):
    """Paragraphs in batches of at most 24,000 characters, in order."""
    b = L.correction_batches(paras(spark, sf_dir))
    return b.groupBy("doc_id").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("paragraphs"))


@query("resolve_profiles", "WITH d AS (SELECT doc_id, lang || '-' || source AS fingerprint, list_distinct(string_split(text, ' ')) AS t FROM documents), p AS (SELECT fingerprint, arg_max(doc_id, doc_id) AS profile_id, arg_max(t, doc_id) AS pt FROM d WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, fingerprint, profile_id, round(CASE WHEN profile_id IS NOT NULL THEN len(list_intersect(t, pt)) / len(list_distinct(list_concat(t, pt))) END, 6) AS overlap FROM d LEFT JOIN p USING (fingerprint)")
def resolve_profiles(spark, sf_dir):
    """Newest profile of each document's fingerprint; even documents stand for stored profiles."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").select("doc_id", F.concat_ws("-", "lang", "source").alias("fingerprint"), F.array_distinct(F.split("text", " ")).alias("tokens"))
    p = d.where("doc_id % 2 = 0").select("fingerprint", F.col("doc_id").alias("profile_id"), "tokens", F.col("doc_id").alias("learned_at"))
    return L.resolve_profiles(d, p).withColumn("overlap", F.round("overlap", 6))


def model_output(spark, sf_dir):
    """Turns as chunks, with a stand-in for model output made of their own words."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text", "role")
    w = F.split("text", r"[\s.,]+")
    concept = F.struct(F.get(w, 0).alias("name"), F.col("role").alias("type"), F.get(w, 1).alias("description"))
    claim = F.struct(F.concat_ws(" ", F.get(w, 0), F.get(w, 1)).alias("text"), F.col("role").alias("status"), F.split("text", "[.\n]")[0].alias("quote"), F.get(w, 0).alias("about"), F.array(F.get(w, 1), F.get(w, 0)).alias("involves"))
    return M.parse_output(c.withColumn("payload", F.to_json(F.struct(F.array(concept).alias("concepts"), F.array(claim).alias("claims")))))


@query("semantic_concepts")
def semantic_concepts(spark, sf_dir):
    """Concepts folded over all chunks by canonical name."""
    return M.concepts(model_output(spark, sf_dir))


@query("semantic_claims")
def semantic_claims(spark, sf_dir):
    """Claims with closed status, located quote and relations."""
    return M.claims(model_output(spark, sf_dir), ["user", "assistant"])


@query("verified_quotes", "SELECT role, count(*) AS claims, count_if(contains(text, regexp_split_to_array(text, '[.\\n]')[1])) AS verified FROM conversations GROUP BY role")
def verified_quotes(spark, sf_dir):
    """Quotes that stand in their text, by role."""
    c = table(spark, sf_dir, "conversations", "role", "text").withColumn("q", F.split("text", "[.\n]")[0])
    return c.groupBy("role").agg(F.count("*").alias("claims"), F.count_if((F.col("q") == "") | F.coalesce(T.quote_still_locates(F.col("q"), F.col("text")), F.lit(False))).alias("verified"))


@query("page_text")
def page_text(spark, sf_dir):
    """Readable text of every page."""
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", S.page_text(F.col("html")).alias("text"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_titles(spark, sf_dir):
    """Title and number of links of every page."""
    h = table(spark, sf_dir, "pages", "page_id", "html")
    return h.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("tumbling_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """Hourly counts by type (an extra: the batch form of the streaming window)."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", F.unix_micros("w.start").alias("start_us"), "events", "total")


@query("clock_locators", r"SELECT conv_id, turn, printf('%d:%02d:%02d', turn * 1000 // 3600, turn * 1000 % 3600 // 60, turn * 1000 % 60) AS clock, concat_ws(' · ', role, 'p. ' || turn, '[' || turn || ':' || (turn + 1) || ']') AS locator FROM conversations")
def clock_locators(spark, sf_dir):
    """Clock time and citation locator of every turn."""
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    return c.select("conv_id", "turn", T.clock(F.col("turn") * 1000).alias("clock"), T.locator(F.col("role"), F.col("turn"), none, none, none, F.col("turn"), F.col("turn") + 1).alias("locator"))


@query("embed_texts", f"WITH {PARA}, h AS (SELECT doc_id, idx, coalesce(first_value(text) OVER (PARTITION BY doc_id ORDER BY idx), '') AS head, text FROM p) SELECT doc_id, CAST(idx AS INTEGER) AS idx, sha256(concat_ws(chr(10) || chr(10), nullif(head, ''), text)) AS digest FROM h")
def embed_texts(spark, sf_dir):
    """What would be embedded: each paragraph under the first of its document."""
    from pyspark.sql import Window

    p = paras(spark, sf_dir).withColumn("head", F.first("text").over(Window.partitionBy("doc_id").orderBy("idx")))
    return p.select("doc_id", "idx", F.sha2(C.embed_text(F.col("head"), F.lit(""), F.lit(""), F.col("text")), 256).alias("digest"))


@query("vector_cache_lookup", "SELECT count(*) AS asked, count(label) AS hits, count_if(label IS NULL) AS misses FROM (SELECT DISTINCT sha256(text) AS k, min(doc_id) AS d FROM documents GROUP BY text) LEFT JOIN embeddings ON vec_id = d AND len(embedding) = 64")
def vector_cache_lookup(spark, sf_dir):
    """Texts that a content-addressed vector cache holds; a wrong length is a miss."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("d"))
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").where(F.size("embedding") == 64)
    return d.join(v, F.col("vec_id") == F.col("d"), "left").agg(F.count("*").alias("asked"), F.count("label").alias("hits"), F.count_if(F.col("label").isNull()).alias("misses"))


@query("cost_estimate", "SELECT source, CAST(sum(ceil(n_chars / 3.6)) AS BIGINT) AS tokens, round(sum(ceil(n_chars / 3.6)) / 1000000.0 * 1.5, 6) AS low, round(sum(ceil(n_chars / 3.6)) / 1000000.0 * 9.0, 6) AS high FROM documents GROUP BY source")
def cost_estimate(spark, sf_dir):
    """Projected tokens and cost range of every source."""
    t = F.sum(F.ceil(F.col("n_chars") / 3.6))
    return table(spark, sf_dir, "documents", "source", "n_chars").groupBy("source").agg(t.cast("long").alias("tokens"), F.round(T.price(F.lit(1.5), t), 6).alias("low"), F.round(T.price(F.lit(9.0), t), 6).alias("high"))
