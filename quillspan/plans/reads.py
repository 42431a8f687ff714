"""Registered named reads of one version and library: suppliers stand for versions, parts for
concepts, line items for chunks, mentions and claims, orders for sections, regions for tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.plans import templates as N
from quillspan.plans.graph import MENTIONS, mentions, versions
from quillspan.registry import query
from quillspan.sources.tables import table

#: The version, library and tenant that the reads ask for.
VERSION, LIBRARY, TENANT = 7, 0, 0
ROWS = f"{MENTIONS}, me AS (SELECT m.*, tenant_id FROM m JOIN ver USING (version_id)), li AS (SELECT l_suppkey AS version_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber AS ordinal, l_linestatus AS kind, 'sec' || l_orderkey % 50 AS section_id, l_partkey AS about, l_partkey % 100 + 1 AS involves, l_returnflag AS status, CASE WHEN l_tax > 0.04 THEN 'quoted' ELSE '' END AS quote, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS claim_id, round(1 - 4 * l_discount, 6) AS confidence, l_shipdate FROM lineitem), lt AS (SELECT li.*, tenant_id, library_id FROM li JOIN ver USING (version_id))"


def entities(spark, sf_dir):
    """The entity tables that the templates read, with tenants."""
    v = versions(spark, sf_dir).withColumn("active", F.lit(True))
    who = v.select("version_id", "tenant_id", "library_id")
    li = table(spark, sf_dir, "lineitem").join(who, F.col("l_suppkey") == F.col("version_id"))
    base = [F.col("version_id"), F.col("tenant_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")]
    chunks = li.select(*base, F.col("l_linenumber").alias("ordinal"), F.col("l_linestatus").alias("kind"), F.concat(F.lit("sec"), (F.col("l_orderkey") % 50).cast("string")).alias("section_id"))
    claims = li.select(
        *base, F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("claim_id"), F.col("l_partkey").alias("about"), (F.col("l_partkey") % 100 + 1).alias("involves"),
        F.col("l_returnflag").alias("status"), F.when(F.col("l_tax") > 0.04, "quoted").otherwise("").alias("quote"), F.round(1 - 4 * F.col("l_discount"), 6).alias("confidence"), F.col("l_linestatus").alias("text"),
    )
    sections = chunks.groupBy("version_id", "tenant_id", "section_id").agg(F.min("ordinal").alias("level")).withColumn("path", F.col("section_id"))
    citations = chunks.select("tenant_id", "chunk_id", F.concat(F.lit("cit"), F.col("chunk_id").cast("string")).alias("citation_id")).distinct()
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("concept_id"), F.lower("p_name").alias("key"), F.lit(TENANT).alias("tenant_id"))
    m = mentions(spark, sf_dir).join(who.select("version_id", "tenant_id"), "version_id")
    return {"chunks": chunks, "claims": claims, "sections": sections, "citations": citations, "concepts": p, "versions": v, "mentions": m}


def _asked(spark, sf_dir):
    """Tenant and library of the version that the reads ask for; it is one row."""
    row = versions(spark, sf_dir).where(F.col("version_id") == VERSION).first()
    return {"tenant_id": row["tenant_id"], "library_id": row["library_id"]}


def read(name, spark, sf_dir, **args):
    t = N.TEMPLATES[name]
    known = _asked(spark, sf_dir) | {"version_id": VERSION}
    given = {k: known[k] for k in t.params if k in known} | args
    return N.run(name, {k: df.withColumn("tenant_id", F.col("tenant_id").cast("string")) for k, df in entities(spark, sf_dir).items()}, **{k: str(v) if t.params.get(k) in ("id", "string") else v for k, v in given.items()})


OF = f"version_id = {VERSION}"
OUTLINE = f"WITH {ROWS} SELECT section_id, min(ordinal) AS level FROM lt WHERE {OF} GROUP BY 1 ORDER BY section_id LIMIT 25"


@query("read_document_outline", OUTLINE)
def read_document_outline(spark, sf_dir):
    """First 25 sections of a version by path."""
    return read("document_outline", spark, sf_dir, limit=25).select("section_id", "level")


@query("read_claims_between", f"WITH {ROWS}, t AS (SELECT tenant_id FROM ver WHERE {OF}) SELECT claim_id FROM lt WHERE about IN (3, 4) AND involves IN (3, 4) AND about <> involves AND confidence >= 0.6 AND tenant_id = (SELECT tenant_id FROM t) ORDER BY confidence DESC, claim_id LIMIT 200")
def read_claims_between(spark, sf_dir):
    """Claims that relate two concepts."""
    return read("claims_between_concepts", spark, sf_dir, concept_a="3", concept_b="4").select("claim_id")


@query("read_citations", f"WITH {ROWS}, t AS (SELECT tenant_id FROM ver WHERE {OF}) SELECT DISTINCT chunk_id, 'cit' || chunk_id AS citation_id FROM lt WHERE chunk_id IN (11, 12, 21, 22, 31, 41, 51, 61, 71) AND tenant_id = (SELECT tenant_id FROM t)")
def read_citations(spark, sf_dir):
    """Citations of named chunks that belong to the tenant."""
    return read("citations_for_chunks", spark, sf_dir, chunk_ids=[11, 12, 21, 22, 31, 41, 51, 61, 71]).select("chunk_id", "citation_id")


@query("read_library_mentions", f"WITH {ROWS}, e AS (SELECT version_id, concept_id, count(*) AS weight, round(max(confidence), 6) AS strength FROM m WHERE confidence >= 0.6 AND version_id IN (SELECT version_id FROM ver WHERE (library_id, tenant_id) = (SELECT (library_id, tenant_id) FROM ver WHERE {OF})) GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY concept_id) AS documents FROM e) SELECT * FROM d WHERE documents >= 1 ORDER BY weight DESC, version_id, concept_id LIMIT 60000".replace("(library_id, tenant_id) = (SELECT (library_id, tenant_id) FROM ver WHERE " + OF + ")", "library_id = (SELECT library_id FROM ver WHERE " + OF + ")"))
def read_library_mentions(spark, sf_dir):
    """Mention edges of the library that holds the version."""
    return read("library_mentions", spark, sf_dir).select("version_id", "concept_id", "weight", "strength", "documents")


@query("read_node_counts", f"WITH {ROWS}, t AS (SELECT tenant_id FROM ver WHERE {OF}) SELECT 'chunks' AS label, count(*) AS n FROM lt WHERE tenant_id = (SELECT tenant_id FROM t) UNION ALL SELECT 'claims', count(*) FROM lt WHERE tenant_id = (SELECT tenant_id FROM t) UNION ALL SELECT 'versions', count(*) FROM ver WHERE tenant_id = (SELECT tenant_id FROM t) UNION ALL SELECT 'concepts', CASE WHEN (SELECT tenant_id FROM t) = {TENANT} THEN (SELECT count(*) FROM part) ELSE 0 END")
def read_node_counts(spark, sf_dir):
    """Nodes of the tenant by label."""
    return read("graph_node_counts", spark, sf_dir)


@query("read_edge_counts", f"WITH {ROWS} SELECT 'MENTIONS' AS type, count(*) AS n FROM me WHERE tenant_id = (SELECT tenant_id FROM ver WHERE {OF})")
def read_edge_counts(spark, sf_dir):
    """Edges of the tenant by type."""
    return read("graph_edge_counts", spark, sf_dir)


@query("read_version_counts", f"WITH {ROWS} SELECT label, (SELECT count(*) FROM lt WHERE {OF}) AS n FROM (VALUES ('chunks'), ('claims'), ('mentions')) l(label)")
def read_version_counts(spark, sf_dir):
    """Chunks, claims and mentions of a version."""
    return read("version_counts", spark, sf_dir)


@query("read_chunk_kinds", f"WITH {ROWS} SELECT kind, count(*) AS n FROM lt WHERE {OF} GROUP BY kind")
def read_chunk_kinds(spark, sf_dir):
    """Chunks of a version by kind."""
    return read("version_chunk_kinds", spark, sf_dir)


@query("read_section_levels", f"WITH {ROWS}, s AS (SELECT section_id, min(ordinal) AS level FROM lt WHERE {OF} GROUP BY 1) SELECT level, count(*) AS n FROM s GROUP BY level")
def read_section_levels(spark, sf_dir):
    """Sections of a version by level."""
    return read("version_section_levels", spark, sf_dir)


@query("read_claim_shape", f"WITH {ROWS} SELECT status, count(*) AS claims, count(nullif(quote, '')) AS with_quote FROM lt WHERE {OF} GROUP BY status")
def read_claim_shape(spark, sf_dir):
    """Claims of a version and those with a quote by status."""
    return read("version_claim_shape", spark, sf_dir)


@query("read_claim_keys", f"WITH {ROWS} SELECT claim_id, chunk_id || ' ' || kind AS claim_key FROM lt WHERE {OF} ORDER BY claim_id LIMIT 20000")
def read_claim_keys(spark, sf_dir):
    """Audit keys of a version's claims."""
    return read("version_claim_keys", spark, sf_dir, claim_limit=20_000)


REACHED = f"SELECT about AS concept_id FROM lt WHERE {OF} UNION SELECT involves FROM lt WHERE {OF}"


@query("read_concept_ids", f"WITH {ROWS} SELECT concept_id FROM ({REACHED}) ORDER BY 1 LIMIT 20000")
def read_concept_ids(spark, sf_dir):
    """Concepts that a version reaches by three routes."""
    return read("version_concept_ids", spark, sf_dir, concept_limit=20_000)


@query("read_concepts_reached", f"WITH {ROWS} SELECT count(*) AS concepts FROM ({REACHED})")
def read_concepts_reached(spark, sf_dir):
    """How many those are."""
    return read("version_concepts_reached", spark, sf_dir)


@query("read_mention_pairs", f"WITH {ROWS} SELECT chunk_id, concept_id FROM m WHERE {OF} ORDER BY chunk_id, concept_id LIMIT 60000")
def read_mention_pairs(spark, sf_dir):
    """Mention edges of a version."""
    return read("version_mention_pairs", spark, sf_dir, mention_limit=60_000)


@query("read_library_documents", f"WITH {ROWS} SELECT version_id, title FROM ver WHERE library_id = (SELECT library_id FROM ver WHERE {OF}) ORDER BY title, version_id LIMIT 1000")
def read_library_documents(spark, sf_dir):
    """Active versions of the library in order of title."""
    return read("library_documents", spark, sf_dir, document_limit=1000).select("version_id", "title")


@query("read_chunk_neighbours", f"WITH {ROWS}, c AS (SELECT version_id, ordinal FROM lt WHERE chunk_id = 71 AND tenant_id = (SELECT tenant_id FROM ver WHERE {OF})) SELECT DISTINCT lt.version_id, lt.ordinal FROM lt JOIN c ON lt.version_id = c.version_id AND abs(lt.ordinal - c.ordinal) <= 1 ORDER BY ordinal LIMIT 200")
def read_chunk_neighbours(spark, sf_dir):
    """Places beside a chunk in its version."""
    return read("chunk_neighbours", spark, sf_dir, chunk_id="71").select("version_id", "ordinal").distinct()


@query("read_section_chunks", f"WITH {ROWS} SELECT ordinal, count(*) AS n FROM (SELECT * FROM lt WHERE section_id = 'sec7' AND tenant_id = (SELECT tenant_id FROM ver WHERE {OF}) ORDER BY ordinal LIMIT 200) GROUP BY ordinal")
def read_section_chunks(spark, sf_dir):
    """Chunks under a section by ordinal, as they are counted for display."""
    return read("section_chunks", spark, sf_dir, section_id="sec7").groupBy("ordinal").agg(F.count("*").alias("n"))
