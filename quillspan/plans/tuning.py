"""Registered tuning queries: vectors stand for chunks, their labels for sections and right answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import retrieval as R
from quillspan.operators import tuning as U
from quillspan.plans.retrieval import RANKED, TIMES, VEC, nearest, vectors
from quillspan.registry import query
from quillspan.sources.store import settled
from quillspan.sources.tables import table

CONFIGS = ", ".join(f"('{c['config']}', {c['per_section']}, {c['min_score']})" for c in U.RETRIEVAL_CANDIDATES)
GRID = f"""{VEC}, {RANKED}, cfg AS (SELECT * FROM (VALUES {CONFIGS}) c(config, per_section, min_score)),
d AS (SELECT config, q, ql, label, rank, row_number() OVER (PARTITION BY config, q, label ORDER BY rank) > per_section AS spare FROM r, cfg WHERE rank <= 50 AND score >= min_score),
o AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY spare, rank) AS delivered FROM d),
f AS (SELECT config, q, (SELECT min(delivered) FROM o WHERE o.config = cfg.config AND o.q = s.q AND ql = label AND delivered <= 10) AS rank FROM cfg, (SELECT vec_id AS q FROM v WHERE vec_id % 20 = 0) s)"""


def measured(spark, sf_dir):
    """The grid's ranks, kept as a table."""
    hits = nearest(spark, sf_dir, R.PREFETCH).select("q", "id", "score", "rank", F.col("label").alias("section"), (F.col("label") == F.col("ql")).alias("right"))
    questions = vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("q"))
    return settled(U.configured_ranks(hits, questions, U.RETRIEVAL_CANDIDATES), "ranks")


@query("tuning_ranks", f"WITH {GRID} SELECT config, q, CAST(rank AS INTEGER) AS rank FROM f")
def tuning_ranks(spark, sf_dir):
    """Rank of the first right hit of every question under every retrieval setting."""
    return measured(spark, sf_dir)


@query("stored_baseline", f"WITH {GRID} SELECT count(*) AS questions, count(*) FILTER (WHERE rank = 1) AS hits_at_1, count(*) FILTER (WHERE rank <= 5) AS hits_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) > 0 AS usable FROM f WHERE config = 'baseline'")
def stored_baseline(spark, sf_dir):
    """The baseline's scores, from its stored ranks alone."""
    return U.baseline_from(measured(spark, sf_dir))


JUDGED = f"""{GRID}, rr AS (SELECT config, q, rank, coalesce(1.0 / rank, 0) AS rr FROM f), ba AS (SELECT q, rr AS base FROM rr WHERE config = 'baseline'),
pa AS (SELECT config, q, rank, rr, base FROM rr JOIN ba USING (q) WHERE config <> 'baseline'),
u AS (SELECT q, round, u FROM (SELECT q, round, CAST('0x' || substr(md5(q || ':' || round || ':7'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM ba, (SELECT unnest(generate_series(0, 399)) AS round))),
t AS (SELECT q, round, {TIMES} AS t FROM u),
mg AS (SELECT stddev_pop(m) AS margin FROM (SELECT round, sum(t * base) / nullif(sum(t), 0) AS m FROM t JOIN ba USING (q) GROUP BY round)),
wi AS (SELECT config, avg(CAST(round(a, 9) > round(b, 9) AS DOUBLE)) AS wins FROM (SELECT config, round, sum(t * rr) / nullif(sum(t), 0) AS a, sum(t * base) / nullif(sum(t), 0) AS b FROM t JOIN pa USING (q) GROUP BY config, round) GROUP BY config),
sc AS (SELECT config, count(*) AS questions, avg(rr) AS mrr, avg(coalesce(CAST(rank <= 5 AS DOUBLE), 0)) AS recall_at_5, avg(base) AS before FROM pa GROUP BY config)"""


@query("judged_candidates", f"WITH {JUDGED} SELECT config, questions, round(mrr, 6) AS mrr, round(recall_at_5, 6) AS recall_at_5, round(mrr - before, 6) AS delta, round(margin, 6) AS margin, round(wins, 6) AS wins, round(mrr, 6) - round(before, 6) > round(margin, 6) AS accepted FROM sc JOIN wi USING (config), mg")
def judged_candidates(spark, sf_dir):
    """Every retrieval setting against the baseline's noise margin, over the same resamples."""
    return U.judged(measured(spark, sf_dir))


def profiles(spark, sf_dir):
    """Parts stand for profiles, their sizes for settings."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select(F.col("p_partkey").alias("profile_id"), (F.lit(700) + F.col("p_size") % 10 * 100).cast("int").alias("target_chars"), (F.col("p_size") % 3 * 150).cast("int").alias("overlap_chars"), F.lit(1).alias("revision"))


def history(spark, sf_dir):
    """Line items stand for rounds: which candidate was tried for which profile."""
    names = F.array(*[F.lit(c) for c, *_ in U.CHUNK_CANDIDATES])
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_quantity")
    tried = F.get(names, (F.col("l_linenumber") - 1).cast("int"))
    return li.where("l_linenumber <= 4 and l_quantity <= 8").select(F.col("l_partkey").alias("profile_id"), tried.alias("candidate"), (F.col("l_quantity") / 100).alias("mrr"), (F.col("l_quantity") > 5).alias("accepted"))


PROFILES = "pr AS (SELECT p_partkey AS profile_id, CAST(700 + p_size % 10 * 100 AS INTEGER) AS target_chars, CAST(p_size % 3 * 150 AS INTEGER) AS overlap_chars FROM part), ca AS (SELECT * FROM (VALUES (0, 'target=900', 900, NULL), (1, 'target=1600', 1600, NULL), (2, 'overlap=300', NULL, 300), (3, 'overlap=0', NULL, 0)) c(place, candidate, t, o)), hi AS (SELECT l_partkey AS profile_id, candidate, l_quantity / 100 AS mrr, l_quantity > 5 AS accepted FROM lineitem JOIN ca ON place = l_linenumber - 1 WHERE l_quantity <= 8)"


@query("next_chunk_candidates", f"WITH {PROFILES} SELECT profile_id, (SELECT arg_min(candidate, place) FROM ca WHERE coalesce(t <> target_chars, true) AND coalesce(o <> overlap_chars, true) AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.profile_id = pr.profile_id AND hi.candidate = ca.candidate)) AS candidate FROM pr")
def next_chunk_candidates(spark, sf_dir):
    """What chunking setting to try next for every profile."""
    return U.next_chunk_candidates(profiles(spark, sf_dir), history(spark, sf_dir))


@query("promoted_profiles", f"WITH {PROFILES}, be AS (SELECT profile_id, arg_min(candidate, (-mrr, candidate)) AS candidate FROM hi WHERE accepted GROUP BY profile_id) SELECT profile_id, coalesce(t, target_chars) AS target_chars, coalesce(o, overlap_chars) AS overlap_chars, 1 + CAST(be.candidate IS NOT NULL AS INTEGER) AS revision FROM pr LEFT JOIN be USING (profile_id) LEFT JOIN ca ON ca.candidate = be.candidate")
def promoted_profiles(spark, sf_dir):
    """Profiles once the accepted settings are in force."""
    return U.promoted(profiles(spark, sf_dir), history(spark, sf_dir))
