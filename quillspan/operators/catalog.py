"""Catalog reads: totals, pages, latest rows and cost folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row aggregates side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # each side is one row


def before(rows: DataFrame, keys: list[str], cursor: list[Column]) -> DataFrame:
    """Rows before a cursor by row-value comparison."""
    return rows.where(F.struct(*keys) < F.struct(*[c.alias(k) for k, c in zip(keys, cursor, strict=True)]))


def where_in(rows: DataFrame, allowed: dict[str, list | None]) -> DataFrame:
    """Optional membership filters; None or an empty list means no filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).isin(kv[1])) if kv[1] else df, allowed.items(), rows)


def money(costs: DataFrame, key: str) -> DataFrame:
    """Token and money totals; the sum stays null where nothing is priced."""
    return costs.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("usd"), 2).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key by the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def last_turns(turns: DataFrame, key: str, turn: str, keep: int) -> DataFrame:
    """Last ``keep`` turns of a conversation, with the number the next one takes."""
    w = Window.partitionBy(key).orderBy(F.desc(turn), F.desc("role"), F.desc("text"))
    out = turns.withColumn("_k", F.row_number().over(w)).withColumn("next_turn", F.max(turn).over(Window.partitionBy(key)) + 1)
    return out.where(F.col("_k") <= keep).drop("_k")


def clamp_limit(asked: int | None, ceiling: int = 200) -> int:
    """Row limit within [1, ceiling]."""
    return ceiling if asked is None else max(1, min(int(asked), ceiling))
