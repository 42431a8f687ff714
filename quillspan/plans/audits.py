"""Registered projections and audits. Suppliers stand for versions, nations for documents'
folders, line items for chunks and mentions, conversations for timed transcripts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import audit as A
from quillspan.operators import chunking as C
from quillspan.operators import projection as P
from quillspan.operators.catalog import one_row
from quillspan.plans.chunking import PARA
from quillspan.plans.graph import MENTIONS, mentions
from quillspan.registry import query
from quillspan.sources.tables import table

CHUNKS = "ch AS (SELECT o_custkey % 300 AS document_id, o_custkey AS version_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS section, CASE WHEN o_orderkey % 5 > 0 THEN 'p. ' || o_orderkey END AS locator FROM orders)"


def chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("index")
    return o.select((F.col("o_custkey") % 300).alias("document_id"), F.col("o_custkey").alias("version_id"), at, F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("section"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("p. "), F.col("o_orderkey").cast("string"))).alias("locator"))


@query("project_structure", f"WITH {CHUNKS} SELECT 'document' AS what, count(DISTINCT document_id) AS n FROM ch UNION ALL SELECT 'version', count(DISTINCT version_id) FROM ch UNION ALL SELECT 'section', count(*) FROM (SELECT DISTINCT version_id, section FROM ch WHERE section IS NOT NULL) UNION ALL SELECT 'chunk', count(*) FROM ch UNION ALL SELECT 'citation', count(locator) FROM ch UNION ALL SELECT 'HAS_VERSION', count(*) FROM (SELECT DISTINCT document_id, version_id FROM ch) UNION ALL SELECT 'HAS_SECTION', count(*) FROM (SELECT DISTINCT version_id, section FROM ch WHERE section IS NOT NULL) UNION ALL SELECT 'HAS_CHUNK', count(*) FROM ch UNION ALL SELECT 'IN_SECTION', count(section) FROM ch UNION ALL SELECT 'NEXT', count(*) - count(DISTINCT version_id) FROM ch UNION ALL SELECT 'CITES', count(locator) FROM ch")
def project_structure(spark, sf_dir):
    """Nodes and edges by kind after projecting all chunks twice."""
    c = chunks(spark, sf_dir)
    nodes, edges = P.project_structure(c.unionByName(c))
    return nodes.groupBy(F.col("label").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")))


@query("prune_citations", "SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS locator FROM orders")
def prune_citations(spark, sf_dir):
    """Citations after every third chunk was projected again with a new one."""
    o = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("chunk_id"))
    made = lambda df, s: df.withColumn("locator", F.lit(s)).withColumn("id", F.concat_ws(":", "chunk_id", "locator"))
    new = made(o.where("chunk_id % 3 = 0"), "new")
    return P.prune_citations(made(o, "old").unionByName(new), new).select("chunk_id", "locator")


PRUNED = f"{MENTIONS}, d AS (SELECT DISTINCT version_id, chunk_id, concept_id FROM m), kept AS (SELECT * FROM d WHERE NOT (version_id % 4 = 0 AND (chunk_id % 3 <> 0 OR concept_id % 2 = 0)))"


def pruned(spark, sf_dir):
    held = mentions(spark, sf_dir).select("version_id", "chunk_id", "concept_id").distinct()
    again = held.where("version_id % 4 = 0")
    return held, P.prune_semantics(held, again.where("chunk_id % 3 = 0 and concept_id % 2 = 1"), again.select("version_id"), ["chunk_id", "concept_id"])


@query("prune_semantics", f"WITH {PRUNED} SELECT version_id, count(*) AS held, (SELECT count(*) FROM kept k WHERE k.version_id = d.version_id) AS kept FROM d GROUP BY version_id")
def prune_semantics(spark, sf_dir):
    """Mentions of every version before and after a quarter of the versions was extracted anew."""
    held, kept = pruned(spark, sf_dir)
    n = lambda df, name: df.groupBy("version_id").agg(F.count("*").alias(name))
    return n(held, "held").join(n(kept, "kept"), "version_id", "left").fillna(0, ["kept"])


@query("pruned_orphans", f"WITH {PRUNED} SELECT DISTINCT concept_id FROM d WHERE version_id % 4 = 0 AND concept_id NOT IN (SELECT concept_id FROM kept) AND concept_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def pruned_orphans(spark, sf_dir):
    """Concepts that this pruning leaves without mention and claim."""
    held, kept = pruned(spark, sf_dir)
    claims = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size > 40").select(F.col("p_partkey").alias("concept_id"))
    return P.orphans(held.where("version_id % 4 = 0"), [kept, claims])


@query("condensed_descriptions", "SELECT p_partkey AS concept_id, CASE WHEN p_size > 25 THEN 'about ' || p_brand ELSE p_name END AS description FROM part")
def condensed_descriptions(spark, sf_dir):
    """Descriptions after the condensed ones are set."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").withColumnRenamed("p_partkey", "concept_id")
    new = p.where("p_size > 25").select("concept_id", F.concat(F.lit("about "), F.col("p_brand")).alias("description"))
    return P.set_descriptions(p.select("concept_id", F.col("p_name").alias("description")), new)


@query("duplicate_links", "SELECT doc_id AS document_id, first_holder FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_holder FROM documents) WHERE doc_id <> first_holder")
def duplicate_links(spark, sf_dir):
    """Documents whose content another document holds already."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.substring(F.sha2("text", 256), 1, 24).alias("version_id"))
    return P.link_duplicates(d, d.select("version_id").distinct()).select("document_id", "first_holder")


@query("stamped_payloads", "SELECT c_custkey, 'tenant-a' AS tenant_id, c_nationkey AS library_id FROM customer")
def stamped_payloads(spark, sf_dir):
    """Points under the server's tenant and library, whatever they came with."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumn("tenant_id", F.lit("forged"))
    return P.stamp(c, F.lit("tenant-a"), F.col("c_nationkey")).select("c_custkey", "tenant_id", "library_id")


@query("sparse_drift", "SELECT l_orderkey AS doc_id, count_if(l_partkey % 7 = 0) AS only_stored, count_if(l_partkey % 7 = 1) AS only_rebuilt, count_if(l_partkey % 7 = 2) AS changed FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey % 7 < 3 GROUP BY 1")
def sparse_drift(spark, sf_dir):
    """Planted differences of stored and rebuilt sparse vectors."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").distinct().select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"))
    stored = t.where("term % 7 <> 1").withColumn("weight", F.lit(0.5))
    rebuilt = t.where("term % 7 <> 0").withColumn("weight", F.when(F.col("term") % 7 == 2, 0.6).otherwise(0.5))
    return P.sparse_drift(stored, rebuilt)


@query("chosen_streams", f"WITH {PARA} SELECT doc_id AS id, 'raw' AS chosen, count(*) AS verified, TRUE AS unanimous FROM p GROUP BY doc_id")
def chosen_streams(spark, sf_dir):
    """Which of three texts the paragraphs of every document index."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    spans = C.paragraphs(d, "\n").select(F.col("doc_id").alias("id"), F.col("offset").alias("begin"), (F.col("offset") + F.octet_length("text")).alias("end"), "text")
    stream = lambda label, c: d.select(F.col("doc_id").alias("id"), F.lit(label).alias("label"), c.alias("content"))
    streams = stream("raw", F.col("text")).unionByName(stream("shifted", F.concat(F.lit("§"), F.col("text")))).unionByName(stream("upper", F.upper("text")))
    return A.choose_stream(spans, streams)


TIMES = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx, text FROM conversations), n AS (SELECT conv_id, max(idx) AS top FROM t GROUP BY 1), c AS (SELECT conv_id, unnest(generate_series(0, top // 2)) AS i FROM n), k AS (SELECT c.conv_id, i, CASE WHEN i = 3 THEN 7 ELSE 2 * i END AS a, 2 * i + 1 AS b, top FROM c JOIN n USING (conv_id)), f AS (SELECT *, CASE WHEN b < a THEN 'backwards' WHEN a > top OR b > top THEN 'outside' END AS fault FROM k)"


def times(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = c.select("conv_id", (F.row_number().over(w) - 1).alias("idx"), "text").withColumn("start_s", F.col("idx") * 10.0).withColumn("end_s", F.col("idx") * 10.0 + 9)
    n = t.groupBy("conv_id").agg(F.max("idx").alias("top"))
    i = n.select("conv_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("top") / 2).cast("int"))).alias("index"))
    return t, i.select("conv_id", "index", F.when(F.col("index") == 3, 7).otherwise(2 * F.col("index")).alias("para_from"), (2 * F.col("index") + 1).alias("para_to"))


@query("chunk_times", f"WITH {TIMES} SELECT conv_id, CAST(i AS INTEGER) AS \"index\", CASE WHEN fault IS NULL THEN a * 10.0 END AS start_s, CASE WHEN fault IS NULL THEN b * 10.0 + 9 END AS end_s, fault FROM f")
def chunk_times(spark, sf_dir):
    """Time spans of chunks of two turns; ranges that run out of the table or backwards are faults."""
    t, c = times(spark, sf_dir)
    return A.chunk_times(c, t, "conv_id").select("conv_id", "index", "start_s", "end_s", "fault")


@query("time_report", f"WITH {TIMES}, g AS (SELECT *, CASE WHEN fault IS NULL THEN a * 10.0 END AS s, CASE WHEN fault IS NULL THEN b * 10.0 + 9 END AS e FROM f), h AS (SELECT *, s < lag(s) OVER (PARTITION BY conv_id ORDER BY i) AS back FROM g) SELECT conv_id, count(*) AS chunks, count(fault) AS faults, count(*) FILTER (WHERE back) AS back, count_if(s > e) AS inverted, count_if(e > 25) AS past_duration FROM h GROUP BY conv_id")
def time_report(spark, sf_dir):
    """Order and bounds of those spans for every conversation, with a duration of 25 seconds."""
    t, c = times(spark, sf_dir)
    return A.time_report(A.chunk_times(c, t, "conv_id"), t.select("conv_id").distinct().withColumn("duration_s", F.lit(25.0)), "conv_id")


@query("uncovered_paragraphs", f"WITH {TIMES} SELECT conv_id, CAST(idx AS INTEGER) AS idx FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = t.conv_id AND t.idx BETWEEN a AND b AND i % 2 = 0)")
def uncovered_paragraphs(spark, sf_dir):
    """Turns that the even chunks leave out."""
    t, c = times(spark, sf_dir)
    return A.uncovered(c.where("index % 2 = 0"), t, "conv_id")


@query("alignment", f"WITH {TIMES} SELECT conv_id, count(*) AS paragraphs, count(*) - CAST(conv_id % 5 = 0 AS INTEGER) AS timed, count_if(idx = 1 AND conv_id % 7 = 0) AS blank, conv_id % 5 <> 0 AND count_if(idx = 1 AND conv_id % 7 = 0) = 0 AS aligned FROM t GROUP BY conv_id")
def alignment(spark, sf_dir):
    """Paragraphs against timed groups, with planted blanks and gaps."""
    t, _ = times(spark, sf_dir)
    blanked = t.withColumn("text", F.when((F.col("idx") == 1) & (F.col("conv_id") % 7 == 0), " \n").otherwise(F.concat(F.lit("x"), F.col("text"))))
    return A.alignment(blanked, t.where("not (conv_id % 5 = 0 and idx = 0)"), "conv_id")


@query("shared_ranges", "SELECT l_suppkey AS version_id, l_linenumber AS para_from, l_linenumber + l_partkey % 3 AS para_to, count(*) AS chunks FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def shared_ranges(spark, sf_dir):
    """Ranges of paragraphs that several chunks of a version report."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_partkey")
    c = li.select(F.col("l_suppkey").alias("version_id"), F.col("l_linenumber").alias("para_from"), (F.col("l_linenumber") + F.col("l_partkey") % 3).alias("para_to"))
    return A.shared_ranges(c, "version_id")


@query("claim_status_fold", "WITH s AS (SELECT l_suppkey AS version_id, coalesce(nullif(l_returnflag, 'N'), 'sin_estado') AS status, count(*) AS claims, count_if(l_linestatus = 'O') AS with_quote FROM lineitem GROUP BY ALL) SELECT * FROM s UNION ALL SELECT version_id, NULL, CAST(sum(claims) AS BIGINT), CAST(sum(with_quote) AS BIGINT) FROM s GROUP BY version_id")
def claim_status_fold(spark, sf_dir):
    """Claims and quotes of every version by status and in all."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = li.groupBy(F.col("l_suppkey").alias("version_id"), F.nullif("l_returnflag", F.lit("N")).alias("status")).agg(F.count("*").alias("claims"), F.count_if(F.col("l_linestatus") == "O").alias("with_quote"))
    return A.status_fold(rows, "version_id")


@query("stage_ledger", "SELECT l_linestatus || l_returnflag AS stage, count(*) AS calls, CAST(sum(l_linenumber % 2) AS BIGINT) AS retries, CAST(sum(CAST(l_linenumber = 7 AS INTEGER)) AS BIGINT) AS failures, CAST(sum(l_partkey % 3) AS BIGINT) AS cache_hits, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, round(sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber < 6 THEN l_extendedprice END), 2) AS usd, count_if(l_returnflag = 'R' OR l_linenumber >= 6) AS unpriced FROM lineitem GROUP BY 1")
def stage_ledger(spark, sf_dir):
    """Calls, retries, failures, cache hits, tokens and money by stage."""
    li = table(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    calls = li.select(F.concat("l_linestatus", "l_returnflag").alias("stage"), (F.col("l_linenumber") % 2).alias("retries"), (F.col("l_linenumber") == 7).cast("int").alias("failures"), (F.col("l_partkey") % 3).alias("cache_hits"), F.col("l_quantity").cast("long").alias("tokens"), F.when((F.col("l_returnflag") != "R") & (F.col("l_linenumber") < 6), F.col("l_extendedprice")).alias("usd"))
    return A.ledger(calls)


@query("heading_disagreement", "SELECT o_custkey AS version_id, count(DISTINCT o_orderpriority) AS numbered, count(DISTINCT nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '')) AS learned, count(DISTINCT o_orderpriority) <> count(DISTINCT nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, '')) AS disagree FROM orders GROUP BY 1")
def heading_disagreement(spark, sf_dir):
    """Chapters of every version under two rule sets."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").withColumnRenamed("o_custkey", "version_id")
    return A.heading_disagreement(o, "version_id", {"numbered": F.col("o_orderpriority"), "learned": F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))})


def _diff(what: str, key: str, produced: str, held: str) -> str:
    p, h = f"(SELECT DISTINCT {key} AS k FROM lineitem WHERE {produced})", f"(SELECT DISTINCT {key} AS k FROM lineitem WHERE {held})"
    return f"SELECT '{what}' AS what, (SELECT count(*) FROM {p}) AS produced, (SELECT count(*) FROM {h}) AS in_store, (SELECT count(*) FROM {p} JOIN {h} USING (k)) AS converged, (SELECT count(*) FROM {h} ANTI JOIN {p} USING (k)) AS left_behind, (SELECT count(*) FROM {p} ANTI JOIN {h} USING (k)) AS missing, round((SELECT count(*) FROM {h} ANTI JOIN {p} USING (k)) / (SELECT count(*) FROM {h}), 6) AS stale_share"


DIFFS = {"claims": ("l_orderkey || ' ' || l_linenumber", "l_returnflag <> 'A'", "l_returnflag <> 'R'"), "concepts": ("CAST(l_partkey AS VARCHAR)", "l_linenumber < 3", "l_linenumber > 1"), "mentions": ("l_suppkey || ' ' || l_partkey", "l_linestatus = 'O'", "l_linenumber > 2")}


@query("semantic_diff", " UNION ALL ".join(_diff(k, *v) for k, v in DIFFS.items()))
def semantic_diff(spark, sf_dir):
    """Claims, concepts and mentions of a run against those of the graph."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    side = lambda i: {k: li.where(v[i]).select(F.expr(v[0].replace("VARCHAR", "STRING")).alias("k")) for k, v in DIFFS.items()}
    return A.semantic_diff(side(1), side(2), "k")


@query("estimate_totals", "WITH s AS (SELECT l_returnflag AS stage, sum(l_quantity) AS tokens FROM lineitem GROUP BY 1), p AS (SELECT stage, round(tokens / 1000000.0 * rate, 6) AS usd FROM s LEFT JOIN (VALUES ('A', 1.5), ('N', 0.15)) r(flag, rate) ON flag = stage) SELECT round(sum(usd), 6) AS usd, round(sum(usd) * 1.4, 6) AS high, count_if(usd IS NULL) AS unpriced FROM p")
def estimate_totals(spark, sf_dir):
    """Sum of priced stages, its high end, and how many stages have no price."""
    from quillspan.functions.text import price

    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("tokens"))
    rates = spark.sql("VALUES ('A', 1.5D), ('N', 0.15D)").toDF("flag", "rate")
    s = li.join(rates, F.col("flag") == F.col("l_returnflag"), "left").select(F.round(price(F.col("rate"), F.col("tokens")), 6).alias("usd"))
    return s.agg(F.round(F.sum("usd"), 6).alias("usd"), F.round(F.sum("usd") * 1.4, 6).alias("high"), F.count_if(F.col("usd").isNull()).alias("unpriced"))


@query("version_statistics", f"WITH {MENTIONS}, a AS (SELECT version_id, count(*) AS chunks, count(DISTINCT concept_id) AS concepts FROM m GROUP BY 1), c AS (SELECT l_suppkey AS version_id, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END), 2) AS usd FROM lineitem GROUP BY 1), s AS (SELECT label AS version_id, count(*) AS measured FROM embeddings GROUP BY 1) SELECT s_suppkey AS version_id, coalesce(chunks, 0) AS chunks, coalesce(concepts, 0) AS concepts, usd, measured FROM supplier LEFT JOIN a ON a.version_id = s_suppkey LEFT JOIN c ON c.version_id = s_suppkey LEFT JOIN s ON s.version_id = s_suppkey")
def version_statistics(spark, sf_dir):
    """Structure, semantics, cost and retrieval of every version; what was not measured is null, not zero."""
    m = mentions(spark, sf_dir)
    a = m.groupBy("version_id").agg(F.count("*").alias("chunks"), F.countDistinct("concept_id").alias("concepts"))
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_extendedprice")
    c = li.groupBy(F.col("l_suppkey").alias("version_id")).agg(F.round(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))), 2).alias("usd"))
    e = table(spark, sf_dir, "embeddings", "label").groupBy(F.col("label").alias("version_id")).agg(F.count("*").alias("measured"))
    v = table(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "version_id")
    return v.join(a, "version_id", "left").join(c, "version_id", "left").join(e, "version_id", "left").fillna(0, ["chunks", "concepts"])


@query("project_summary", "SELECT (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM supplier) AS versions, (SELECT count(*) FROM part) AS concepts, (SELECT count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem) AS mentions, (SELECT count(*) FROM orders) AS runs, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus <> 'P') AS usd")
def project_summary(spark, sf_dir):
    """Deterministic and semantic graph totals beside the catalog's."""
    n = lambda name, col, alias: table(spark, sf_dir, name, col).agg(F.count("*").alias(alias))
    m = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct().agg(F.count("*").alias("mentions"))
    usd = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice").where("o_orderstatus <> 'P'").agg(F.round(F.sum("o_totalprice"), 2).alias("usd"))
    return one_row([n("lineitem", "l_orderkey", "chunks"), n("supplier", "s_suppkey", "versions"), n("part", "p_partkey", "concepts"), m, n("orders", "o_orderkey", "runs"), usd])
