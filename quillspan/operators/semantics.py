"""Folding of per-chunk model output into concepts, mentions and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import canonical_name, collapse, digest, quote_span

OUTPUT = "concepts array<struct<name:string,type:string,description:string>>, claims array<struct<text:string,status:string,quote:string,about:string,involves:array<string>>>"


def parse_output(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """chunk_id, text and the parsed concepts and claims; unreadable output is null."""
    return rows.withColumn("out", F.from_json(payload, OUTPUT)).select("chunk_id", "text", "out.*")


def concepts(parsed: DataFrame) -> DataFrame:
    """concept_id, name, type, descriptions: first name and first given type win, descriptions once each."""
    c = parsed.select("chunk_id", F.posexplode("concepts").alias("pos", "c")).select("chunk_id", "pos", "c.*").withColumn("key", canonical_name(F.col("name"))).where("key <> ''")
    at = F.struct("chunk_id", "pos")
    g = c.groupBy("key").agg(F.min_by("name", at).alias("name"), F.min_by("type", F.when(F.col("type").isNotNull(), at)).alias("type"), F.array_sort(F.collect_set("description")).alias("descriptions"))
    return g.select(digest(F.col("key")).alias("concept_id"), "key", "name", "type", "descriptions")


def mentions(parsed: DataFrame) -> DataFrame:
    """Distinct (chunk_id, concept_id)."""
    c = parsed.select("chunk_id", F.explode("concepts").alias("c")).withColumn("key", canonical_name(F.col("c.name"))).where("key <> ''")
    return c.select("chunk_id", digest(F.col("key")).alias("concept_id")).distinct()


def claims(parsed: DataFrame, statuses: list[str]) -> DataFrame:
    """claim_id, chunk_id, text, status (closed set or null), byte span of the quote, relations.

    Of claims with one id the one with a quote's place, then of the least text and status, stays.
    """
    c = parsed.select("chunk_id", F.col("text").alias("chunk_text"), F.explode("claims").alias("c")).select("chunk_id", "chunk_text", "c.*")
    about = canonical_name(F.col("about"))
    others = F.filter(F.transform("involves", canonical_name), lambda k: (k != "") & (k != F.coalesce(about, F.lit(""))))
    out = c.select(
        digest(F.col("chunk_id").cast("string"), collapse(F.col("text"))).alias("claim_id"), "chunk_id", "text", F.when(F.col("status").isin(statuses), F.col("status")).alias("status"),
        quote_span(F.col("quote"), F.col("chunk_text")).alias("span"), about.alias("about"), F.array_distinct(others).alias("involves"),
    )
    order = [F.col("span").isNull(), "span.begin", "text", F.asc_nulls_last("status"), F.asc_nulls_last("about"), F.array_join("involves", "|")]
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order))).where("_k = 1").drop("_k")


def glean(passes: DataFrame) -> DataFrame:
    """Claims of several passes: one row for an id, and none whose span an earlier pass has had."""
    first = passes.withColumn("_k", F.row_number().over(Window.partitionBy("claim_id").orderBy("pass"))).where("_k = 1").drop("_k")
    earliest = F.min("pass").over(Window.partitionBy("chunk_id", "begin", "end"))
    return first.withColumn("_first", earliest).where(F.col("begin").isNull() | (F.col("pass") == F.col("_first"))).drop("_first")


def condense(concepts_: DataFrame, chars: int = 600, sources: int = 12) -> DataFrame:
    """What to do with a concept's descriptions: keep joined, leave alone, or ask a model."""
    joined = F.array_join("descriptions", " ")
    action = F.when(F.char_length(joined) <= chars, "join").when((F.size("descriptions") > sources) & F.col("condensed").isNotNull(), "leave").otherwise("model")
    return concepts_.withColumn("action", action).withColumn("joined", F.when(action == "join", joined))
