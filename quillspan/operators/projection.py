"""Graph projections of a version: nodes and edges from chunks, and removal of what went stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import digest


def project_structure(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of versions from chunks (document_id, version_id, index, section, locator).

    Nodes: document, version, section, chunk, citation. Edges: HAS_VERSION, HAS_SECTION,
    HAS_CHUNK, IN_SECTION, NEXT (in reading order) and CITES. Ids derive from content, so
    projecting twice gives the same rows; ``section`` and ``locator`` may be null.
    """
    # Dealt once, by version and before the longer ids are made; all ids but a document's belong to one version, so what repeats is found there.
    raw = chunks.select("document_id", "version_id", "index", "section", "locator").repartition("version_id").distinct()
    doc, ver = F.concat(F.lit("doc_"), F.col("document_id").cast("string")), F.concat(F.lit("ver_"), F.col("version_id").cast("string"))
    c = raw.select(
        doc.alias("doc"), ver.alias("ver"), F.when(F.col("section").isNotNull(), F.concat(F.lit("sec_"), digest(ver, F.col("section")))).alias("sec"),
        F.concat(F.lit("chk_"), digest(ver, F.col("index").cast("string"))).alias("chunk"), "version_id", "index",
        F.when(F.col("locator").isNotNull(), F.concat(F.lit("cit_"), digest(ver, F.col("index").cast("string"), F.col("locator")))).alias("cit"),
    )
    follows = F.lead("chunk").over(Window.partitionBy("version_id").orderBy("index"))
    node = lambda label, col: F.struct(F.lit(label).alias("label"), F.col(col).alias("id"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    within = lambda df, rows, *cols: df.select("version_id", F.inline(F.array(*rows))).dropna(subset=list(cols)).distinct().select(*cols)
    nodes = within(c, [node(*x) for x in (("version", "ver"), ("section", "sec"), ("chunk", "chunk"), ("citation", "cit"))], "label", "id")
    documents = chunks.select(F.lit("document").alias("label"), doc.alias("id")).dropna().distinct()
    pairs = (("HAS_VERSION", "doc", "ver"), ("HAS_SECTION", "ver", "sec"), ("HAS_CHUNK", "ver", "chunk"), ("IN_SECTION", "chunk", "sec"), ("NEXT", "chunk", "after"), ("CITES", "cit", "chunk"))
    edges = within(c.withColumn("after", follows), [edge(*x) for x in pairs], "type", "source_id", "target_id")
    return nodes.unionByName(documents), edges


def prune_citations(citations: DataFrame, projected: DataFrame) -> DataFrame:
    """Citations (id, chunk_id) without those of projected chunks that bear another id than the new one."""
    chunks = projected.select("chunk_id").distinct().withColumn("_touched", F.lit(True))
    fresh = projected.select("id", F.lit(True).alias("_fresh")).distinct()
    j = citations.join(chunks, "chunk_id", "left").join(fresh, "id", "left")
    return j.where(F.col("_touched").isNull() | F.col("_fresh").isNotNull()).select(citations.columns)


def prune_semantics(held: DataFrame, produced: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Semantic rows (version_id and ``keys``) without those of re-extracted ``versions`` that the run did not produce.

    Chunks for which the run produced nothing lose all their rows; other versions keep theirs.
    """
    again = versions.select("version_id", F.lit(True).alias("_again")).distinct()
    made = produced.select("version_id", *keys, F.lit(True).alias("_made")).distinct()
    j = held.join(again, "version_id", "left").join(made, ["version_id", *keys], "left")
    return j.where(F.col("_again").isNull() | F.col("_made").isNotNull()).select(held.columns)


def orphans(candidates: DataFrame, supports: list[DataFrame]) -> DataFrame:
    """Concepts (concept_id) that none of the remaining rows supports any more."""
    return reduce(lambda df, s: df.join(s.select("concept_id"), "concept_id", "left_anti"), supports, candidates.select("concept_id").distinct())


def set_descriptions(concepts: DataFrame, condensed: DataFrame) -> DataFrame:
    """Concepts with their condensed description where there is one; the raw ones stay."""
    j = concepts.join(condensed.select("concept_id", F.col("description").alias("_new")), "concept_id", "left")
    return j.withColumn("description", F.coalesce("_new", "description")).select(concepts.columns)


def link_duplicates(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, version_id, first_holder: documents whose content another holds already.

    They need a node, an edge and an activation, but no chunks of their own.
    """
    w = Window.partitionBy("version_id").orderBy("document_id")
    held = documents.join(versions.select("version_id"), "version_id", "left_semi")
    return held.withColumn("first_holder", F.first("document_id").over(w)).where(F.col("document_id") != F.col("first_holder")).select("document_id", "version_id", "first_holder")


def stamp(rows: DataFrame, tenant: Column, library: Column) -> DataFrame:
    """Rows whose tenant and library are set by the server, whatever they came with."""
    return rows.withColumns({"tenant_id": tenant, "library_id": library})


def sparse_drift(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Per document: terms only stored, only rebuilt, and of another weight (doc_id, term, weight, 6 digits).

    A dry run of a sparse rebuild; a reproducible one gives no rows.
    """
    s, r = stored.select("doc_id", "term", F.round("weight", 6).alias("a")), rebuilt.select("doc_id", "term", F.round("weight", 6).alias("b"))
    j = s.join(r, ["doc_id", "term"], "full").where("a is null or b is null or a <> b")
    return j.groupBy("doc_id").agg(F.count_if(F.col("b").isNull()).alias("only_stored"), F.count_if(F.col("a").isNull()).alias("only_rebuilt"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("changed"))
