"""Registered artifact reads: documents stand for stored files, events for their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.registry import query
from quillspan.sources import artifacts as S
from quillspan.sources.tables import table


@query("artifact_inventory", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines FROM documents")
def artifact_inventory(spark, sf_dir):
    """Hash, size and line breaks of every stored text."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return S.inventory(d.select("doc_id", F.col("text").alias("content")), "doc_id")


@query("verified_artifacts", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'altered' END AS fault, CASE WHEN doc_id % 5 > 1 THEN sha256(text) END AS digest FROM documents")
def verified_artifacts(spark, sf_dir):
    """Stored texts against their recorded hash, with planted losses and changes."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    stored = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    out = S.verified(stored, d.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")
    return out.select("doc_id", "fault", F.sha2("content", 256).alias("digest"))


@query("artifact_ranges", "SELECT doc_id, hex(encode(text)[11:20]) AS piece FROM documents")
def artifact_ranges(spark, sf_dir):
    """Bytes 10 to 20 of every stored text."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.hex(S.byte_range(F.col("text"), F.lit(10), F.lit(20))).alias("piece"))


@query("artifact_pages", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n BETWEEN 6 AND 10")
def artifact_pages(spark, sf_dir):
    """Second page of five rows of every user's events."""
    return S.page(table(spark, sf_dir, "events", "user_id", "event_id"), "user_id", ["event_id"], 5, 5)


RECORDS = "r AS (SELECT page_id, 'v' || page_id AS asked, 'v' || CASE WHEN page_id % 11 = 0 THEN page_id + 1 ELSE page_id END AS got, page_id % 13 AS duration, (array['manual', 'auto', NULL, 'other'])[page_id % 4 + 1] AS kind, (array['https://www.youtube.com/api/timedtext?v=1', '', 'https://evil.example/api/timedtext', 'http://youtube.com/api/timedtext', 'https://youtube.com/watch'])[page_id % 5 + 1] AS url FROM pages)"


@query("resolved_records", f"WITH {RECORDS} SELECT page_id, CASE WHEN asked <> got THEN 'id' WHEN duration <= 0 THEN 'duration' WHEN kind IS NULL THEN CASE WHEN url <> '' THEN 'address without track' END WHEN kind = 'other' THEN 'kind' WHEN url = '' THEN 'track without address' WHEN page_id % 5 IN (2, 3) THEN 'host' WHEN page_id % 5 = 4 THEN 'path' END AS fault FROM r")
def resolved_records(spark, sf_dir):
    """Planted video records and why each can't be trusted."""
    p = table(spark, sf_dir, "pages", "page_id")
    n, name = F.col("page_id"), lambda c: F.concat(F.lit("v"), c.cast("string"))
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    urls = ["https://www.youtube.com/api/timedtext?v=1", "", "https://evil.example/api/timedtext", "http://youtube.com/api/timedtext", "https://youtube.com/watch"]
    got = name(F.when(n % 11 == 0, n + 1).otherwise(n))
    return p.select("page_id", S.resolved_fault(name(n), got, n % 13, at(["manual", "auto", None, "other"]), at(urls)).alias("fault"))
