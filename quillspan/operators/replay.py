"""Semantics of a version replayed from an artifact: several tables as one published snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources import store

#: Raised whenever what is stored changes, so that snapshots of an older form are not taken up.
FORMAT = 2
#: Tables in the order they are written, with their keys and the columns that stay as first written.
TABLES = {
    "concepts": (["concept_id"], ["name"]),
    "mentions": (["version_id", "chunk_id", "concept_id"], ["model", "created_at"]),
    "claims": (["version_id", "claim_id"], ["model", "created_at"]),
    "edges": (["version_id", "source_id", "type", "target_id"], ["model", "created_at"]),
}


def replayed(held: dict[str, DataFrame], produced: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables once the artifact's rows are the semantics of the versions it speaks of.

    Rows that the artifact has are taken over with its values, but those columns that tell
    where a row comes from stay as they were first written, so that a replay never claims a
    new extraction. Rows of the replayed versions that the artifact lacks go; other versions
    keep theirs. A concept stays while any mention is left or the artifact names it; concepts
    that nothing mentions any more go. Doing it twice gives the same rows. What several of the
    tables are made from passes ``keep`` first, which may store it.
    """
    produced = {name: keep(produced[name].select(held[name].columns).dropDuplicates(keys)) for name, (keys, _) in TABLES.items()}
    spoken = [df.select("version_id") for n, df in produced.items() if "version_id" in df.columns]
    versions = spoken[0]
    for more in spoken[1:]:
        versions = versions.unionByName(more)
    versions = keep(versions.distinct())
    out = {}
    for name, (keys, first) in TABLES.items():
        old, new = held[name], produced[name]
        if name != "concepts":
            # Only the versions that are replayed can lose rows.
            other = old.join(versions, "version_id", "left_anti").select(old.columns)
            mine = old.join(versions, "version_id", "left_semi")
        else:
            other, mine = old.join(new.select(keys), keys, "left_anti").select(old.columns), old
        kept = mine.select(*keys, *[F.col(c).alias(f"_{c}") for c in first])
        taken = new.join(kept, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in first})
        out[name] = other.unionByName(taken.select(old.columns))
    out["mentions"] = keep(out["mentions"])
    used = out["mentions"].select("concept_id").unionByName(produced["concepts"].select("concept_id"))
    out["concepts"] = out["concepts"].join(used, "concept_id", "left_semi").select(held["concepts"].columns)
    return out


@dataclass(frozen=True)
class Snapshots:
    """A folder of numbered snapshots of several tables; the newest published one counts.

    A snapshot's tables are written one after another, and its ``published`` marker last: a
    run that breaks in between leaves the snapshot before in force, and is written over.
    """

    spark: SparkSession
    path: str

    def newest(self) -> int:
        """Number of the snapshot in force; 0 if there is none."""
        n = 0
        while store.exists(self.spark, f"{self.path}/published/{n + 1}"):
            n += 1
        return n

    def read(self) -> dict[str, DataFrame]:
        """The tables of the snapshot in force."""
        return {name: self.spark.read.parquet(f"{self.path}/{self.newest()}/{name}") for name in TABLES}

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write the tables as the next snapshot and put it in force."""
        n = self.newest() + 1
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.path}/{n}/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/published/{n}")
        return n

    def replay(self, produced: dict[str, DataFrame]) -> int:
        """Publish what :func:`replayed` makes of the snapshot in force; the artifact is read once."""
        kept = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(store.settled(df, "replay"))
            return kept[-1]

        try:
            return self.publish(replayed(self.read(), produced, keep))
        finally:
            for df in kept:
                store.dropped(df)
