"""Reads of stored artifacts: verified content, pages, byte ranges, inventories and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verified(files: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Content whose SHA-256 is the recorded one; ``fault`` says missing or altered otherwise."""
    j = expected.select(key, F.col("sha256").alias("_want")).join(files.select(key, "content"), key, "left")
    got = F.sha2("content", 256)
    fault = F.when(F.col("content").isNull(), "missing").when(got != F.col("_want"), "altered")
    return j.select(key, F.when(fault.isNull(), F.col("content")).alias("content"), fault.alias("fault"))


def inventory(files: DataFrame, key: str = "path") -> DataFrame:
    """Hash, size and line breaks of every artifact."""
    raw = F.col("content").cast("binary")
    breaks = F.length(F.hex(raw)) / 2 - F.octet_length(F.replace(raw.cast("string"), F.lit("\n"), F.lit("")))
    return files.select(key, F.sha2(raw, 256).alias("sha256"), F.length(raw).cast("long").alias("bytes"), breaks.cast("long").alias("lines"))


def byte_range(content: Column, begin: Column, end: Column) -> Column:
    """Bytes [begin, end) of a content."""
    return F.substring(content.cast("binary"), begin + 1, end - begin)


def page(rows: DataFrame, key: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of every artifact in order (a page for display)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def stage(files: DataFrame, root: str, formats: list[str]) -> DataFrame:
    """path, sha256 and ``fault`` of sources: outside the tenant's root, or of no known format."""
    inside = F.startswith("path", F.lit(root.rstrip("/") + "/")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    known = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(formats)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.when(~inside, "outside").when(~known, "format").alias("fault"))


# Where captions may come from.
CAPTION_HOSTS, CAPTION_PATH = ("www.youtube.com", "youtube.com"), "/api/timedtext"


def resolved_fault(asked_id: Column, video_id: Column, duration: Column, kind: Column, url: Column) -> Column:
    """Why a resolved video record can't be trusted; null if it can.

    It must be for the asked id and have a duration; a caption address and a chosen track
    come together, of a known kind, from a known host and path by https.
    """
    address = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^\w+://([^/:?#]*)", 1))
    path = F.regexp_extract(address, r"^\w+://[^/?#]*([^?#]*)", 1)
    return (
        F.when(~video_id.eqNullSafe(asked_id), "id").when(F.coalesce(duration, F.lit(0)) <= 0, "duration")
        .when(kind.isNull(), F.when(address != "", "address without track"))
        .when(~kind.isin("manual", "auto"), "kind").when(address == "", "track without address")
        .when(~F.startswith(address, F.lit("https://")) | ~host.isin(*CAPTION_HOSTS), "host").when(path != CAPTION_PATH, "path")
    )
