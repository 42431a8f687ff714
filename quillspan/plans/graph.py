"""Registered graph queries: suppliers stand for document versions, parts for concepts,
line items for mentions, nations for libraries, regions for tenants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import community as C
from quillspan.operators import graph as G
from quillspan.registry import query
from quillspan.sources.store import settled
from quillspan.sources.tables import table

MENTIONS = "m AS (SELECT l_suppkey AS version_id, l_partkey AS concept_id, l_orderkey * 10 + l_linenumber AS chunk_id, 1 - 4 * l_discount AS confidence FROM lineitem), ver AS (SELECT s_suppkey AS version_id, s_name AS title, s_nationkey AS library_id, n_regionkey AS tenant_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
STRONG = "st AS (SELECT * FROM m WHERE round(confidence, 6) >= 0.7)"


def mentions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_discount")
    return li.select(F.col("l_suppkey").alias("version_id"), F.col("l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), (1 - 4 * F.col("l_discount")).alias("confidence"))


def strong(spark, sf_dir):
    return G.confident(mentions(spark, sf_dir), 0.7)


def versions(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("version_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("library_id"), F.col("n_regionkey").alias("tenant_id"))


@query("concepts_in_version", f"WITH {MENTIONS}, {STRONG} SELECT version_id, concept_id, count(*) AS mentions, round(max(confidence), 6) AS confidence FROM st GROUP BY ALL")
def concepts_in_version(spark, sf_dir):
    """Mentions and best confidence of every concept of every version."""
    return G.concepts_in_version(strong(spark, sf_dir))


@query("chunks_for_concepts", f"WITH {MENTIONS}, {STRONG} SELECT library_id, tenant_id, concept_id, count(DISTINCT chunk_id) AS chunks, round(max(confidence), 6) AS confidence FROM st JOIN ver USING (version_id) GROUP BY ALL")
def chunks_for_concepts(spark, sf_dir):
    """Chunks that mention each concept within each library and tenant."""
    j = strong(spark, sf_dir).join(versions(spark, sf_dir), "version_id")
    return j.groupBy("library_id", "tenant_id", "concept_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.round(F.max("confidence"), 6).alias("confidence"))


@query("related_documents", f"WITH {MENTIONS}, {STRONG}, d AS (SELECT DISTINCT version_id, concept_id FROM st) SELECT a.version_id, b.version_id AS other_id, count(*) AS shared, list_slice(list_sort(list(a.concept_id)), 1, 200) AS concepts FROM d a JOIN d b ON a.concept_id = b.concept_id AND a.version_id <> b.version_id JOIN ver x ON x.version_id = a.version_id JOIN ver y ON y.version_id = b.version_id WHERE x.library_id = y.library_id GROUP BY ALL")
def related_documents(spark, sf_dir):
    """Versions of one library that share concepts, with up to 200 of them."""
    return G.related_versions(strong(spark, sf_dir), versions(spark, sf_dir), 200)


@query("library_mentions", f"WITH {MENTIONS}, {STRONG}, e AS (SELECT library_id, version_id, concept_id, count(*) AS weight, round(max(confidence), 6) AS strength FROM st JOIN ver USING (version_id) GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY library_id, concept_id) AS documents FROM e) SELECT * FROM g WHERE documents >= 3")
def library_mentions(spark, sf_dir):
    """Weighted version-concept edges of concepts that three versions of a library share."""
    return G.library_mentions(strong(spark, sf_dir), versions(spark, sf_dir), 3)


@query("concept_rollup", f"WITH {MENTIONS}, {STRONG}, e AS (SELECT version_id, concept_id, count(*) AS weight, max(confidence) AS strength FROM st GROUP BY ALL) SELECT concept_id, p_name AS label, p_type AS type, sum(weight) AS mentions, count(*) AS documents, round(max(strength), 6) AS strength FROM e JOIN part ON p_partkey = concept_id GROUP BY ALL")
def concept_rollup(spark, sf_dir):
    """Concepts with mentions summed over versions, label and type."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"))
    e = strong(spark, sf_dir).groupBy("version_id", "concept_id").agg(F.count("*").alias("weight"), F.max("confidence").alias("strength"))
    return e.join(p, "concept_id").groupBy("concept_id", "label", "type").agg(F.sum("weight").alias("mentions"), F.count("*").alias("documents"), F.round(F.max("strength"), 6).alias("strength"))


DEG = f"{MENTIONS}, {STRONG}, e AS (SELECT DISTINCT version_id, concept_id FROM st), dg AS (SELECT concept_id, count(*) AS degree FROM e GROUP BY 1)"


@query("degree_histogram", f"WITH {DEG} SELECT t AS threshold, count_if(degree >= t) AS concepts, CAST(coalesce(sum(CASE WHEN degree >= t THEN degree END), 0) AS BIGINT) AS edges FROM dg, (VALUES (1), (2), (3), (5), (10)) v(t) GROUP BY t")
def degree_histogram(spark, sf_dir):
    """Concepts and edges at or above each degree threshold."""
    return G.degree_histogram(strong(spark, sf_dir), [1, 2, 3, 5, 10])


@query("threshold_subgraph", f"WITH {DEG} SELECT version_id, concept_id, degree FROM e JOIN dg USING (concept_id) WHERE degree >= 5")
def threshold_subgraph(spark, sf_dir):
    """Edges of concepts with five versions or more."""
    return G.subgraph(strong(spark, sf_dir), 5)


@query("isolated_nodes", f"WITH {DEG} SELECT p_partkey AS concept_id FROM part WHERE NOT EXISTS (SELECT 1 FROM e JOIN dg USING (concept_id) WHERE degree >= 5 AND concept_id = p_partkey)")
def isolated_nodes(spark, sf_dir):
    """Concepts without an edge at threshold five."""
    nodes = table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("concept_id"))
    return G.isolated(nodes, G.subgraph(strong(spark, sf_dir), 5), "concept_id")


@query("adjacency", f"WITH {DEG}, b AS (SELECT 'v' || version_id AS node, 'c' || concept_id AS other FROM e UNION ALL SELECT 'c' || concept_id, 'v' || version_id FROM e) SELECT node, count(*) AS degree, min(other) AS first, max(other) AS last FROM b GROUP BY node")
def adjacency(spark, sf_dir):
    """Undirected neighbours: degree and extremes for every node."""
    return G.undirected(strong(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"), F.min("other").alias("first"), F.max("other").alias("last"))


@query("concept_search", "SELECT p_partkey AS concept_id, p_name AS label FROM part WHERE contains(lower(p_name), lower('Widget')) OR contains(lower(p_name), lower('7'))")
def concept_search(spark, sf_dir):
    """Concepts whose label holds a needle in any case."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("label"))
    return p.where(G.matches(F.col("label"), "Widget") | G.matches(F.col("label"), "7"))


@query("concept_by_name", "SELECT p_partkey AS concept_id, trim(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS canonical FROM part")
def concept_by_name(spark, sf_dir):
    """Canonical key of every concept."""
    from quillspan.functions.text import canonical_name

    return table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("concept_id"), canonical_name(F.col("p_name")).alias("canonical"))


@query("node_counts", "SELECT 'chunk' AS label, count(*) AS n FROM lineitem UNION ALL SELECT 'concept', count(*) FROM part UNION ALL SELECT 'version', count(*) FROM supplier UNION ALL SELECT 'library', count(*) FROM nation UNION ALL SELECT 'tenant', count(*) FROM region")
def node_counts(spark, sf_dir):
    """Nodes by label."""
    tables = {"chunk": ("lineitem", "l_orderkey"), "concept": ("part", "p_partkey"), "version": ("supplier", "s_suppkey"), "library": ("nation", "n_nationkey"), "tenant": ("region", "r_regionkey")}
    return G.label_counts({k: table(spark, sf_dir, *v) for k, v in tables.items()})


@query("edge_counts", f"WITH {MENTIONS}, {STRONG} SELECT tenant_id, 'MENTIONS' AS type, count(*) AS n FROM st JOIN ver USING (version_id) WHERE concept_id IN (SELECT p_partkey FROM part) GROUP BY tenant_id")
def edge_counts(spark, sf_dir):
    """Mention edges with both ends present, by tenant."""
    p = table(spark, sf_dir, "part", "p_partkey")
    e = strong(spark, sf_dir).join(p, F.col("concept_id") == F.col("p_partkey"), "left_semi").join(versions(spark, sf_dir), "version_id")
    return e.groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit("MENTIONS").alias("type"), "n")


@query("neighbours", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def neighbours(spark, sf_dir):
    """Each turn with the one before and after in reading order."""
    return G.reading_order(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "previous", "next", "next_role")


@query("outline", "SELECT source, lang, count(*) AS chunks, row_number() OVER (PARTITION BY source ORDER BY min(doc_id)) AS ordinal FROM documents GROUP BY source, lang")
def outline(spark, sf_dir):
    """Two-level outline with ordinals by first appearance."""
    return G.outline(table(spark, sf_dir, "documents", "source", "lang", "doc_id"), "source", "lang", "doc_id")


@query("claims_about_concept", "SELECT p_partkey AS concept_id, count(*) AS claims, count_if(l_returnflag = 'A') AS asserted, count_if(l_returnflag NOT IN ('A', 'R')) AS unknown FROM part JOIN lineitem ON l_partkey = p_partkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY 1")
def claims_about_concept(spark, sf_dir):
    """Claims with evidence (semi join) by status for each concept."""
    li, o, p = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_returnflag"), table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "part", "p_partkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_partkey").alias("concept_id")).agg(F.count("*").alias("claims"), F.count_if(F.col("l_returnflag") == "A").alias("asserted"), F.count_if(~F.col("l_returnflag").isin("A", "R")).alias("unknown"))


@query("claims_between_concepts", "SELECT least(a.l_partkey, b.l_partkey) AS low, greatest(a.l_partkey, b.l_partkey) AS high, count(*) AS claims FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey GROUP BY ALL")
def claims_between_concepts(spark, sf_dir):
    """Claims that relate two concepts, whichever way round."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return G.undirected_pairs(li, "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("n", "claims")


@query("version_counts", "SELECT s_suppkey AS version_id, coalesce(c, 0) AS chunks, coalesce(o, 0) AS citations, coalesce(p, 0) AS concepts FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def version_counts(spark, sf_dir):
    """Chunks, citations and concepts of every version, zero where there are none."""
    s, li = table(spark, sf_dir, "supplier", "s_suppkey"), table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_partkey")
    a = li.groupBy("l_suppkey").agg(F.count("*").alias("c"), F.countDistinct("l_orderkey").alias("o"), F.countDistinct("l_partkey").alias("p"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return s.join(a, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("version_id"), zero("c", "chunks"), zero("o", "citations"), zero("p", "concepts"))


@query("claim_shape", "SELECT lang, coalesce(CAST(toxic AS VARCHAR), 'unlabelled') AS status, count(*) AS claims, count(quality) AS with_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def claim_shape(spark, sf_dir):
    """Status histogram that keeps what has no status apart."""
    j = table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.groupBy("lang", F.coalesce(F.col("toxic").cast("string"), F.lit("unlabelled")).alias("status")).agg(F.count("*").alias("claims"), F.count("quality").alias("with_quality"))


ROUTES = "SELECT l_suppkey AS version_id, l_partkey AS concept_id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_suppkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'"


@query("concepts_by_three_routes", f"SELECT version_id, count(DISTINCT concept_id) AS concepts FROM ({ROUTES}) GROUP BY 1")
def concepts_by_three_routes(spark, sf_dir):
    """Concepts that a version reaches by any of three routes."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'")
    pair = [F.col("l_suppkey").alias("version_id"), F.col("l_partkey").alias("concept_id")]
    routes = [li.where("l_returnflag = 'A'"), li.where("l_linestatus = 'O'"), li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")]
    return G.reached([r.select(*pair) for r in routes]).groupBy("version_id").agg(F.count("*").alias("concepts"))


@query("orphan_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti_join(spark, sf_dir):
    """Documents that no label refers to."""
    return table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


@query("community_weights", f"WITH {DEG}, k AS (SELECT e.version_id, p_brand AS community, count(*) AS n FROM e JOIN part ON p_partkey = concept_id GROUP BY ALL) SELECT a.community AS a, b.community AS b, CAST(sum(a.n * b.n) AS BIGINT) AS weight FROM k a JOIN k b ON a.version_id = b.version_id AND a.community < b.community GROUP BY ALL")
def community_weights(spark, sf_dir):
    """Co-occurrence weight of communities by shared versions."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.col("p_partkey").alias("concept_id"), F.col("p_brand").alias("community"))
    return G.community_weights(strong(spark, sf_dir).select("version_id", "concept_id").distinct().join(p, "concept_id"))


@query("clusters")
def clusters(spark, sf_dir):
    """Communities of the version-concept graph by multi-level modularity."""
    return C.communities(strong(spark, sf_dir))


def envelope(spark, sf_dir):
    """Nodes and edges of the library graph by dense numbers."""
    docs = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").toDF("id", "label")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name").toDF("id", "label")
    return C.graph_index(docs, parts, strong(spark, sf_dir))


NODES = f"{DEG}, nd AS (SELECT row_number() OVER (ORDER BY kind, id) - 1 AS node, * FROM (SELECT 0 AS kind, s_suppkey AS id, s_name AS label, 0 AS degree FROM supplier UNION ALL SELECT 1, p_partkey, p_name, coalesce(degree, 0) FROM part LEFT JOIN dg ON concept_id = p_partkey))"
EDGES = f"{NODES}, ed AS (SELECT a.node AS src, b.node AS dst, count(*) AS mentions, round(max(confidence), 6) AS confidence, b.degree FROM st JOIN nd a ON a.kind = 0 AND a.id = version_id JOIN nd b ON b.kind = 1 AND b.id = concept_id GROUP BY ALL)"


@query("graph_nodes", f"WITH {NODES} SELECT node, CAST(kind AS INTEGER) AS kind, id, label, degree FROM nd")
def graph_nodes(spark, sf_dir):
    """Nodes of the library graph by dense numbers, documents first."""
    return envelope(spark, sf_dir)[0]


@query("graph_edges", f"WITH {EDGES} SELECT * FROM ed")
def graph_edges(spark, sf_dir):
    """Edges of the library graph between node numbers."""
    return envelope(spark, sf_dir)[1]


VIEWS = {
    "all": {}, "threshold": {"threshold": 5}, "concepts": {"books": False}, "found": {"only_found": True, "threshold": 2},
    "book": {"only_book": 7}, "joined": {"threshold": 6, "hide_isolated": True}, "found_joined": {"only_found": True, "hide_isolated": True},
}


def view_sql(name: str, threshold=1, books=True, only_found=False, only_book=None, hide_isolated=False) -> str:
    """One view as SQL over ``nd`` and ``ed``."""
    keep = [f"(kind = 0 OR degree >= {threshold})"] + ["kind = 1"] * (not books) 
    if only_found:
        keep.append("contains(lower(label), 'an')")
    nodes = f"SELECT * FROM nd WHERE {' AND '.join(keep)}"
    if only_book is not None:
        book = f"(SELECT node FROM ({nodes}) WHERE kind = 0 AND id = {only_book})"
        nodes = f"SELECT * FROM ({nodes}) WHERE node IN {book} OR node IN (SELECT dst FROM ed WHERE src IN {book})"
    edges = f"SELECT * FROM ed WHERE degree >= {threshold} AND src IN (SELECT node FROM ({nodes})) AND dst IN (SELECT node FROM ({nodes}))"
    shown = f"SELECT * FROM ({nodes}) WHERE node IN (SELECT src FROM ({edges}) UNION ALL SELECT dst FROM ({edges}))" if hide_isolated else nodes
    return f"SELECT '{name}' AS view, (SELECT count(*) FROM ({shown}) WHERE kind = 0) AS books, (SELECT count(*) FROM ({shown}) WHERE kind = 1) AS concepts, (SELECT count(*) FROM ({edges})) AS edges"


@query("graph_views", f"WITH {EDGES} " + " UNION ALL ".join(view_sql(k, **v) for k, v in VIEWS.items()))
def graph_views(spark, sf_dir):
    """What several views of the library graph show."""
    nodes, edges = envelope(spark, sf_dir)
    found = nodes.where(G.matches(F.col("label"), "an"))
    parts = []
    for name, how in VIEWS.items():
        shown, kept = C.visible(nodes, edges, matched=found, **how)
        parts.append(shown.select(F.lit(name).alias("view"), (F.col("kind") == 0).cast("long").alias("books"), F.col("kind").cast("long").alias("concepts"), F.lit(0).cast("long").alias("edges")))
        parts.append(kept.select(F.lit(name).alias("view"), F.lit(0).cast("long").alias("books"), F.lit(0).cast("long").alias("concepts"), F.lit(1).cast("long").alias("edges")))
        parts.append(spark.createDataFrame([(name, 0, 0, 0)], "view string, books long, concepts long, edges long"))
    return reduce(DataFrame.unionByName, parts).groupBy("view").agg(*[F.sum(c).alias(c) for c in ("books", "concepts", "edges")])


@query("merged_clusters")
def merged_clusters(spark, sf_dir):
    """Concepts of the library graph in ten clusters or as near as sizes and links allow."""
    nodes, edges = envelope(spark, sf_dir)
    pairs = settled(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w")), "pairs")
    label, _, _ = C.louvain(pairs)
    out = C.merged_clusters(pairs, label, 10)
    return out.join(nodes, "node").select(F.col("id").alias("concept_id"), "cluster")
