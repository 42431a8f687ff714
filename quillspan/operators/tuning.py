"""Rounds of tuning: stored ranks, paired resampling, judged candidates, and what to try next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.evaluation import is_improvement
from quillspan.operators.retrieval import poisson_draw

# Settings that cost no new index, and those of chunking in the order they are tried.
RETRIEVAL_CANDIDATES = [
    {"config": "baseline", "per_section": 2, "min_score": 0.60}, {"config": "per_section=1", "per_section": 1, "min_score": 0.60},
    {"config": "per_section=3", "per_section": 3, "min_score": 0.60}, {"config": "min_score=0.55", "per_section": 2, "min_score": 0.55},
    {"config": "min_score=0.65", "per_section": 2, "min_score": 0.65},
]
CHUNK_CANDIDATES = [("target=900", 900, None), ("target=1600", 1600, None), ("overlap=300", None, 300), ("overlap=0", None, 0)]
ROUNDS, SEED, CUT = 400, 7, 10


def configured_ranks(hits: DataFrame, questions: DataFrame, candidates: list[dict], *, cut: int = CUT) -> DataFrame:
    """config, q, rank of the first right hit under every setting; null where none is delivered.

    ``hits``: q, id, score, rank, section, right; ``questions``: q. One search serves the whole
    grid: its hits are repeated once a setting, cut by the setting's floor and spread over
    sections by its number of hits a section, before backfill.
    """
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates])
    each = hits.withColumn("_c", F.explode(grid)).select("*", "_c.*").where(F.col("score") >= F.col("min_score"))
    spare = F.row_number().over(Window.partitionBy("config", "q", "section").orderBy("rank")) > F.col("per_section")
    delivered = F.row_number().over(Window.partitionBy("config", "q").orderBy("_spare", "rank"))
    placed = each.withColumn("_spare", spare).withColumn("_at", delivered).where(F.col("right") & (F.col("_at") <= cut))
    first = placed.groupBy("config", "q").agg(F.min("_at").alias("rank"))
    names = F.explode(F.array(*[F.lit(c["config"]) for c in candidates])).alias("config")
    return questions.select("q", names).join(first, ["config", "q"], "left")


def baseline_from(ranks: DataFrame, config: str = "baseline") -> DataFrame:
    """One row of a configuration's stored ranks: questions, hits_at_1, hits_at_5, mrr and ``usable``.

    Without stored ranks there is no margin and so nothing to judge by: ``usable`` is false.
    """
    mine = ranks.where(F.col("config") == config)
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return mine.agg(F.count("*").alias("questions"), F.count_if(F.col("rank") == 1).alias("hits_at_1"), F.count_if(F.col("rank") <= 5).alias("hits_at_5"), F.round(F.avg(rr), 6).alias("mrr"), (F.count("*") > 0).alias("usable"))


def judged(ranks: DataFrame, *, baseline: str = "baseline", rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """config, questions, mrr, recall_at_5, delta, margin, wins, accepted of every setting but the baseline.

    The margin is the deviation of the baseline's mean over resamples, and is known before a
    candidate is looked at. Draws depend on question and round alone, so that all settings
    meet the same resamples: ``wins`` is the share of rounds in which the candidate's mean is
    above the baseline's. No baseline, no rows.
    """
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    held = ranks.withColumn("rr", rr)
    base = held.where(F.col("config") == baseline).select("q", F.col("rr").alias("base"))
    pairs = held.where(F.col("config") != baseline).join(base, "q")
    times = poisson_draw("q", "round", seed)
    drawn = lambda df: df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("t", times)
    mean = lambda c: F.sum(F.col("t") * F.col(c)) / F.nullif(F.sum("t"), F.lit(0))
    margin = drawn(base).groupBy("round").agg(mean("base").alias("m")).agg(F.stddev_pop("m").alias("margin"))
    wins = drawn(pairs).groupBy("config", "round").agg(mean("rr").alias("a"), mean("base").alias("b")).groupBy("config").agg(F.avg((F.round("a", 9) > F.round("b", 9)).cast("double")).alias("wins"))
    scores = pairs.groupBy("config").agg(F.count("*").alias("questions"), F.avg("rr").alias("mrr"), F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))).alias("recall_at_5"), F.avg("base").alias("before"))
    out = scores.join(wins, "config").join(F.broadcast(margin))  # margin is one row
    digits = lambda c: F.round(c, 6).alias(c)
    accepted = is_improvement(F.round("before", 6), F.round("mrr", 6), F.round("margin", 6))
    return out.withColumn("delta", F.col("mrr") - F.col("before")).select("config", "questions", digits("mrr"), digits("recall_at_5"), digits("delta"), digits("margin"), digits("wins"), accepted.alias("accepted"))


def next_chunk_candidates(profiles: DataFrame, history: DataFrame, candidates: list[tuple] = CHUNK_CANDIDATES) -> DataFrame:
    """profile_id, candidate: the next chunking setting of every profile; null where none is left.

    ``profiles``: profile_id, target_chars, overlap_chars; ``history``: profile_id, candidate.
    What was tried is not tried again, and a setting that the profile has already is none.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("candidate"), F.lit(t).cast("int").alias("t"), F.lit(o).cast("int").alias("o")) for i, (c, t, o) in enumerate(candidates)])
    rows = profiles.withColumn("_c", F.explode(listed)).select("profile_id", "target_chars", "overlap_chars", "_c.*")
    no_op = F.coalesce(F.col("t") == F.col("target_chars"), F.lit(False)) | F.coalesce(F.col("o") == F.col("overlap_chars"), F.lit(False))
    left = rows.where(~no_op).join(history.select("profile_id", "candidate").distinct(), ["profile_id", "candidate"], "left_anti")
    first = left.groupBy("profile_id").agg(F.min_by("candidate", "place").alias("candidate"))
    return profiles.select("profile_id").join(first, "profile_id", "left")


def promoted(profiles: DataFrame, verdicts: DataFrame, candidates: list[tuple] = CHUNK_CANDIDATES) -> DataFrame:
    """Profiles with the settings of accepted candidates, their revision raised; others as they were.

    ``verdicts``: profile_id, candidate, mrr, accepted; of several accepted ones of a profile
    that of the best mrr counts, then the first by name.
    """
    best = verdicts.where("accepted").groupBy("profile_id").agg(F.min_by("candidate", F.struct(-F.col("mrr"), F.col("candidate"))).alias("candidate"))
    listed = profiles.sparkSession.createDataFrame(candidates, "candidate string, t int, o int")
    j = profiles.join(best.join(F.broadcast(listed), "candidate"), "profile_id", "left")  # a stated short list
    set_ = {"target_chars": F.coalesce("t", "target_chars"), "overlap_chars": F.coalesce("o", "overlap_chars"), "revision": F.col("revision") + F.col("candidate").isNotNull().cast("int")}
    return j.withColumns(set_).select(profiles.columns)
