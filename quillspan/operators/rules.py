"""Checks of learned document rules and the parts of profile handling that need no model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import jaccard, normal_header
from quillspan.operators.chunking import heading_level, in_sequence, is_question

# Bounds of a useful kind pattern.
HIT_LOW, HIT_HIGH, PURITY, MIN_HEADINGS, MAX_ATTEMPTS = 0.003, 0.20, 0.7, 2, 3


def compiles(pattern: str) -> bool:
    """Whether a proposed pattern is a valid expression."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def header_pattern_check(paras: DataFrame, pattern: str, key: str = "doc_id", long: int = 200) -> DataFrame:
    """Anchored pattern, lines it matches that repeat, and hits in long paragraphs, by document."""
    hit = F.col("text").rlike(pattern)
    n = F.count("*").over(Window.partitionBy(key, normal_header(F.col("text"))))
    return paras.withColumn("_n", n).groupBy(key).agg(
        F.lit(pattern.startswith("^")).alias("anchored"), F.count_if(hit & (F.col("_n") > 1)).alias("repeated"), F.count_if(hit & (F.char_length("text") > long)).alias("in_prose")
    )


def heading_sequence_check(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether level-1 numbers are unique, rising and without gaps; a number may have up to 38 digits."""
    tops = paras.where(heading_level(F.col("text")) == 1).select(key, "idx", F.regexp_extract("text", r"^(\d+)", 1).cast("decimal(38,0)").alias("no"))
    w = Window.partitionBy(key).orderBy("idx")
    steps = tops.withColumn("prev", F.lag("no").over(w))
    return steps.groupBy(key).agg(
        F.count("*").alias("headings"), (F.count("*") == F.countDistinct("no")).alias("unique"),
        F.coalesce(F.bool_and(F.col("no") > F.col("prev")), F.lit(True)).alias("rising"), (F.max("no") - F.min("no") + 1 == F.countDistinct("no")).alias("contiguous"),
    )


def heading_pattern_check(paras: DataFrame, pattern: str, key: str = "doc_id", cap: int = 120) -> DataFrame:
    """A pattern for unnumbered headings: enough matches, not too many, short, no questions."""
    hit = F.col("text").rlike(f"^(?:{pattern})")
    g = paras.groupBy(key).agg(F.count("*").alias("paragraphs"), F.count_if(hit).alias("hits"), F.count_if(hit & (F.char_length("text") > cap)).alias("too_long"), F.count_if(hit & is_question(F.col("text"))).alias("questions"))
    ok = (F.col("hits") >= MIN_HEADINGS) & (F.col("hits") <= 0.2 * F.col("paragraphs")) & (F.col("too_long") == 0) & (F.col("questions") == 0)
    return g.withColumn("accepted", ok)


def kind_pattern_check(paras: DataFrame, pattern: str, signal, key: str = "doc_id") -> DataFrame:
    """Share of paragraphs that a kind pattern hits, and how pure the hits are by a signal."""
    hit = F.col("text").rlike(pattern)
    g = paras.groupBy(key).agg(F.avg(hit.cast("double")).alias("ratio"), F.avg(F.when(hit, signal.cast("double"))).alias("purity"))
    return g.withColumn("accepted", F.coalesce(F.col("ratio").between(HIT_LOW, HIT_HIGH) & (F.col("purity") >= PURITY), F.lit(False)))


def resolve_profiles(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Newest profile of each document's fingerprint, with token overlap as collision measure."""
    newest = profiles.groupBy("fingerprint").agg(F.max_by(F.struct("profile_id", "tokens"), "learned_at").alias("p"))
    j = documents.join(newest, "fingerprint", "left")
    return j.select("doc_id", "fingerprint", F.col("p.profile_id").alias("profile_id"), F.when(F.col("p").isNotNull(), jaccard(F.col("tokens"), F.col("p.tokens"))).alias("overlap"))


def correction_batches(paras: DataFrame, key: str = "doc_id", limit: int = 24_000) -> DataFrame:
    """(key, idx, batch): paragraphs in order, greedily packed up to a number of characters."""

    def step(k, rows):
        batch, size = 0, 0
        for _, idx, n in rows:
            if size and size + n > limit:
                batch, size = batch + 1, 0
            size += n
            yield k, idx, batch

    kind = paras.schema[key].dataType.simpleString()
    return in_sequence(paras.select(key, "idx", F.char_length("text").alias("n")), key, ["idx"], f"`{key}` {kind}, idx int, batch int", step)
