"""Snapshot transforms for upserts, merges and removals; callers write the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equality(filters: dict) -> Column:
    """Conjunction of equalities; an empty one is refused, as it would hit everything."""
    if not filters:
        raise ValueError("an empty filter is refused")
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in sorted(filters.items())])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key; the rest of the snapshot stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_where(rows: DataFrame, filters: dict) -> DataFrame:
    """Rows outside an equality filter."""
    return rows.where(~equality(filters))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those that go."""
    return rows.join(gone, keys, "left_anti")


def set_payload(rows: DataFrame, filters: dict, payload: dict) -> DataFrame:
    """Named columns set on the rows of a filter."""
    hit = equality(filters)
    return rows.select(*[F.when(hit, F.lit(payload[c])).otherwise(F.col(c)).alias(c) if c in payload else F.col(c) for c in rows.columns])


def prune_tail(rows: DataFrame, index: str, keep: int) -> DataFrame:
    """Rows below an index; by index rather than count, so that holes hide nothing."""
    return rows.where(F.col(index) < keep)


def activate_newest(versions: DataFrame, document: str, version: str) -> DataFrame:
    """``active`` on the newest version of each document and on no other."""
    return versions.withColumn("active", F.col(version) == F.max(version).over(Window.partitionBy(document)))


def orphans_without(edges: DataFrame, removed: DataFrame, owner: str, item: str) -> DataFrame:
    """Items that only the removed owners hold."""
    held = edges.join(removed, owner, "left_semi").select(item).distinct()
    others = edges.join(removed, owner, "left_anti").select(item)
    return held.join(others, item, "left_anti")


def merge_sets(old: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """Full outer merge that appends new array elements without repeats, sorted."""
    a, b = old.select(key, F.col(values).alias("_a")), new.select(key, F.col(values).alias("_b"))
    none = F.array().cast("array<string>")
    return a.join(b, key, "full_outer").select(key, F.array_sort(F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))).alias(values))


def merge_keeping(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge in which a new null does not erase an old value."""
    a, b = old.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns]), new.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in columns])


def last_writer(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One edge for each key: the last written."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def backfill(rows: DataFrame, column: str, value) -> tuple[DataFrame, int]:
    """Nulls of a column filled, and how many there were."""
    return rows.fillna({column: value}), rows.where(F.col(column).isNull()).count()
