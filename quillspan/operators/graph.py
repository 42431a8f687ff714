"""Reads over node and edge DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE_FLOOR = 0.6


def scoped(df: DataFrame, tenant: str | int, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; every tenant-facing read starts here."""
    if column not in df.columns:
        raise ValueError(f"a scoped read needs {column}")
    return df.where(F.col(column) == tenant)


def confident(edges: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Edges at or above a confidence floor."""
    return edges.where(F.round("confidence", 6) >= floor)


def concepts_in_version(mentions: DataFrame) -> DataFrame:
    """Mentions and best confidence for each version and concept."""
    return mentions.groupBy("version_id", "concept_id").agg(F.count("*").alias("mentions"), F.round(F.max("confidence"), 6).alias("confidence"))


def related_versions(mentions: DataFrame, versions: DataFrame, cap: int) -> DataFrame:
    """Pairs of versions of one library that share concepts; lists stop at ``cap``.

    The library is part of the join key, so that only pairs within a library meet.
    """
    d = mentions.join(versions.select("version_id", "library_id"), "version_id").select("library_id", "version_id", "concept_id").distinct()
    other = d.withColumnRenamed("version_id", "other_id")
    pairs = d.join(other, ["library_id", "concept_id"]).where("version_id <> other_id")
    # Numbered before they are listed, so that no list grows beyond the cap.
    w = Window.partitionBy("version_id", "other_id")
    listed = pairs.withColumn("shared", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("concept_id"))).where(F.col("k") <= cap)
    return listed.groupBy("version_id", "other_id", "shared").agg(F.array_sort(F.collect_list("concept_id")).alias("concepts"))


def library_mentions(mentions: DataFrame, versions: DataFrame, min_documents: int) -> DataFrame:
    """Edges (weight, strength) of concepts held by enough versions of their library."""
    e = mentions.join(versions.select("version_id", "library_id"), "version_id").groupBy("library_id", "version_id", "concept_id")
    e = e.agg(F.count("*").alias("weight"), F.round(F.max("confidence"), 6).alias("strength"))
    w = Window.partitionBy("library_id", "concept_id")
    return e.withColumn("documents", F.count("*").over(w)).where(F.col("documents") >= min_documents)


def subgraph(mentions: DataFrame, threshold: int) -> DataFrame:
    """Distinct edges whose concept has at least ``threshold`` versions, with that degree."""
    e = mentions.select("version_id", "concept_id").distinct()
    return e.withColumn("degree", F.count("*").over(Window.partitionBy("concept_id"))).where(F.col("degree") >= threshold)


def degree_histogram(mentions: DataFrame, thresholds: list[int]) -> DataFrame:
    """Concepts and edges at or above every threshold, in one pass over the degrees."""
    deg = mentions.select("version_id", "concept_id").distinct().groupBy("concept_id").agg(F.count("*").alias("degree"))
    steps = deg.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    at = F.col("degree") >= F.col("threshold")
    return steps.groupBy("threshold").agg(F.count_if(at).alias("concepts"), F.coalesce(F.sum(F.when(at, F.col("degree"))), F.lit(0)).alias("edges"))


def isolated(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(edges, key, "left_anti")


def undirected(mentions: DataFrame) -> DataFrame:
    """Both directions of every distinct edge as (node, other)."""
    e = mentions.select(F.concat(F.lit("v"), F.col("version_id").cast("string")).alias("node"), F.concat(F.lit("c"), F.col("concept_id").cast("string")).alias("other")).distinct()
    return e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other")))


def matches(label: Column, needle: str) -> Column:
    """Case-insensitive substring test; an empty needle matches nothing."""
    return F.contains(F.lower(label), F.lit(needle.lower())) if needle else F.lit(False)


def label_counts(nodes: dict[str, DataFrame]) -> DataFrame:
    """Number of nodes by label."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, df in nodes.items()]
    return reduce(DataFrame.unionByName, parts)


def reading_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Previous and next of the first order column, and the next role."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"previous": F.lag(order[0]).over(w), "next": F.lead(order[0]).over(w), "next_role": F.lead("role").over(w)})


def outline(rows: DataFrame, parent: str, child: str, position: str) -> DataFrame:
    """Children of every parent with sizes, numbered by first appearance."""
    g = rows.groupBy(parent, child).agg(F.count("*").alias("chunks"), F.min(position).alias("first"))
    return g.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy("first")).cast("long")).drop("first")


def undirected_pairs(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """(low, high, n): pairs of different items of a group, without direction."""
    a, b = rows.alias("a"), rows.alias("b")
    j = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")) & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    return j.groupBy(F.least(f"a.{item}", f"b.{item}").alias("low"), F.greatest(f"a.{item}", f"b.{item}").alias("high")).agg(F.count("*").alias("n"))


def reached(routes: list[DataFrame]) -> DataFrame:
    """Distinct pairs over several routes, nulls left out."""
    return reduce(DataFrame.unionByName, routes).dropna().distinct()


def community_weights(members: DataFrame) -> DataFrame:
    """Weight between communities: product of their sizes in each version, summed."""
    k = members.groupBy("version_id", "community").agg(F.count("*").alias("n"))
    a, b = k.select("version_id", F.col("community").alias("a"), F.col("n").alias("na")), k.select("version_id", F.col("community").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "version_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("weight"))
