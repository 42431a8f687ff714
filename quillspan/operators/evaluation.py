"""Evaluation sets, score comparison and tuning decisions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sample sizes, seed, accepted margin multiple, gap that hints at leaked questions.
SAMPLE, TUNING_SAMPLE, SEED, ACCEPT, LEAK_GAP, RECALL_TARGET = 40, 80, 20260726, 1.0, 0.02, 0.85


def stratified(chunks: DataFrame, key: str, kind: str, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Equal quota of each kind by a seeded hash order, topped up from the rest (a sampling operator)."""
    h = F.xxhash64(key, F.lit(seed))
    kinds = chunks.agg(F.countDistinct(kind)).first()[0] or 1
    quota = max(1, sample // kinds)
    ranked = chunks.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(h, key)))
    return ranked.withColumn("_spare", F.col("_k") > quota).orderBy("_spare", h, key).limit(sample).drop("_k", "_spare")


def anchors(chunks: DataFrame) -> DataFrame:
    """Byte midpoint of each chunk, -1 where it has a cell reference instead."""
    return chunks.withColumn("char_mid", F.when(F.col("cell_ref").isNotNull(), -1).otherwise(F.floor((F.col("char_from") + F.col("char_to")) / 2)))


def anchor_matches(mid: Column, cell: Column, index: Column, begin: Column, end: Column, own_cell: Column, own_index: Column) -> Column:
    """Whether a hit is the target: by byte, else by cell, else by index."""
    return F.when(mid >= 0, (mid >= begin) & (mid < end)).when(cell.isNotNull(), cell == own_cell).otherwise(index == own_index)


def is_improvement(baseline: Column, candidate: Column, margin: Column) -> Column:
    """Accept a candidate only beyond the noise margin."""
    return (candidate - baseline) > margin * ACCEPT


def leakage_note(hybrid: Column, dense: Column) -> Column:
    """Hint that questions share words with their chunks."""
    return F.when(hybrid - dense >= LEAK_GAP, "lexical leakage suspected").otherwise("")


def compare_scores(measured: DataFrame, recorded: DataFrame, margin: float) -> DataFrame:
    """metric, measured, recorded, verdict: what moved by more than the margin, or was never recorded."""
    j = measured.join(recorded.withColumnRenamed("value", "recorded"), "metric", "left")
    gap = F.col("value") - F.col("recorded")
    verdict = F.when(F.col("recorded").isNull(), "unrecorded").when(F.abs(gap) <= margin, "same").when(gap > 0, "better").otherwise("worse")
    return j.select("metric", F.col("value").alias("measured"), "recorded", verdict.alias("verdict"))


def floor_verdict(floor: Column, noise: Column) -> Column:
    """Whether a score floor lies above the noise floor."""
    return F.when(noise.isNull(), "unmeasured").when(floor > noise, "above noise").otherwise("within noise")


def tuning_grid(questions: DataFrame, candidates: list[dict]) -> DataFrame:
    """Every question under every candidate setting, the settings being a short stated list."""
    rows = F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.lit(v).alias(k) for k, v in c.items()]) for i, c in enumerate(candidates)])
    return questions.withColumn("_c", F.explode(rows)).select("*", "_c.*").drop("_c")
