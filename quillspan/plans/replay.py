"""Registered replay queries: line items stand for an artifact's mentions, suppliers for versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import replay as P
from quillspan.registry import query
from quillspan.sources import store
from quillspan.sources.tables import table


def semantic_tables(spark, sf_dir, flag: str, day: int, model: str) -> dict:
    """An extraction over the line items of a return flag: concepts, mentions, claims and edges; rows may repeat."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag").where(F.col("l_returnflag") == flag)
    text = lambda c: F.col(c).cast("string")
    made = [F.lit(model).alias("model"), F.lit(day).alias("created_at")]
    version, part = F.col("l_suppkey").cast("int").alias("version_id"), text("l_partkey")
    return {
        "concepts": li.select(part.alias("concept_id"), F.concat(F.lit(f"{model} "), part).alias("name"), F.lit(flag).alias("kind")),
        "mentions": li.select(version, F.col("l_linenumber").cast("int").alias("chunk_id"), part.alias("concept_id"), *made),
        "claims": li.select(version, F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), F.lit(flag)).alias("claim_id"), *made, F.lit(flag).alias("quote")),
        "edges": li.select(version, part.alias("source_id"), F.lit("holds").alias("type"), text("l_linenumber").alias("target_id"), *made),
    }


def snapshots(spark, sf_dir) -> P.Snapshots:
    """The semantics of flags N and R, then suppliers of odd number replayed from flag R's artifact, twice."""
    s = P.Snapshots(spark, f"{store.shared_dir(spark)}/semantics-{P.FORMAT}-{store.fingerprint(table(spark, sf_dir, 'lineitem'))}")
    if s.newest() < 1:
        a, b = semantic_tables(spark, sf_dir, "N", 1, "m1"), semantic_tables(spark, sf_dir, "R", 1, "m1")
        s.publish({n: a[n].unionByName(b[n]).dropDuplicates(P.TABLES[n][0]) for n in a})
    while s.newest() < 3:
        again = semantic_tables(spark, sf_dir, "R", 2, "m2")
        odd = {n: df.where("version_id % 2 = 1") if "version_id" in df.columns else df for n, df in again.items()}
        odd["concepts"] = odd["concepts"].join(odd["mentions"].select("concept_id"), "concept_id", "left_semi")
        s.replay(odd)
    return s


HELD = "li AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS r FROM lineitem WHERE l_returnflag IN ('N', 'R')), me AS (SELECT DISTINCT l_suppkey AS version_id, l_linenumber AS chunk_id, CAST(l_partkey AS VARCHAR) AS concept_id FROM li), ar AS (SELECT DISTINCT l_suppkey AS version_id, l_linenumber AS chunk_id, CAST(l_partkey AS VARCHAR) AS concept_id FROM li WHERE r = 1 AND l_suppkey % 2 = 1), mentions AS (SELECT * FROM me WHERE version_id NOT IN (SELECT version_id FROM ar) UNION SELECT * FROM ar)"


@query("replayed_mentions", f"WITH {HELD} SELECT CAST(version_id AS INTEGER) AS version_id, CAST(chunk_id AS INTEGER) AS chunk_id, concept_id, 'm1' AS model, 1 AS created_at FROM mentions")
def replayed_mentions(spark, sf_dir):
    """Mentions after two replays: stale ones gone, what stays bears its first model and day."""
    return snapshots(spark, sf_dir).read()["mentions"]


@query("replayed_claims", f"WITH {HELD} SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS version_id, l_orderkey || '-' || l_linenumber || '-' || l_returnflag AS claim_id, 'm1' AS model, 1 AS created_at, l_returnflag AS quote FROM li WHERE l_suppkey NOT IN (SELECT version_id FROM ar) OR r = 1")
def replayed_claims(spark, sf_dir):
    """Claims after two replays."""
    return snapshots(spark, sf_dir).read()["claims"]


@query("replayed_concepts", f"WITH {HELD} SELECT concept_id, 'm1 ' || concept_id AS name FROM (SELECT DISTINCT concept_id FROM mentions)")
def replayed_concepts(spark, sf_dir):
    """Concepts after two replays: those that a mention is left of, under their first name."""
    return snapshots(spark, sf_dir).read()["concepts"].select("concept_id", "name")
