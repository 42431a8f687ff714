"""Catalog writes as snapshot transforms: keyed merges, guarded updates and removals.

Every function takes the current snapshot and gives the next one; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def keep_old(old: Column, new: Column) -> Column:
    """Insert only: what is there stays."""
    return old


def take_new(old: Column, new: Column) -> Column:
    """Overwrite."""
    return new


def fill(old: Column, new: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(new, old)


def fill_text(old: Column, new: Column) -> Column:
    """The new text where it is not empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule], guard: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Upsert ``new`` (each key once) into ``old``.

    A row of one side only passes as it is. Where both have a key, each column follows its
    rule (default: overwrite); where a ``guard`` on both rows fails, the old row stays.
    """
    side = lambda df, name: df.select(*keys, F.struct(*[F.col(c).alias(c) for c in old.columns]).alias(name))
    j = side(old, "o").join(side(new.select(*old.columns), "n"), keys, "full")
    refused = F.lit(False) if guard is None else ~guard(F.col("o"), F.col("n"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    pick = lambda c: F.when(both & ~refused, rules.get(c, take_new)(F.col("o")[c], F.col("n")[c])).when(F.col("o").isNotNull(), F.col("o")[c]).otherwise(F.col("n")[c])
    return j.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def refused(old: DataFrame, new: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys of ``new`` that belong to another owner in ``old``."""
    return new.join(old.select(*keys, F.col(owner).alias("_owner")), keys).where(F.col("_owner") != F.col(owner)).select(*keys)


def ensure_libraries(libraries: DataFrame, asked: DataFrame) -> DataFrame:
    """Create or rename libraries (library_id, name, language, tenant_id).

    An empty name leaves the old one, or falls back to the id of a new library; a library of
    another tenant stays untouched (:func:`refused` names those).
    """
    j = merge(libraries, asked, ["library_id"], {"name": fill_text}, lambda o, n: o["tenant_id"] == n["tenant_id"])
    return j.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "library_id"))


def set_styles(styles: DataFrame, edits: DataFrame) -> DataFrame:
    """Override answer styles (tenant_id, effort, body); a blank body deletes the override."""
    out = merge(styles, edits.withColumn("body", F.trim("body")), ["tenant_id", "effort"], {})
    return out.where(F.col("body") != "")


def upsert_documents(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents seen by a scan: title is overwritten, author, folder and path only filled; absent ones revive."""
    return merge(documents, seen, ["document_id"], {"author": fill, "folder_id": fill, "path": fill})


def mark_absent(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose file a scan did not find, marked; the rows stay."""
    marked = documents.join(gone.select("document_id", F.lit(True).alias("_gone")).distinct(), "document_id", "left")
    return marked.withColumn("present", F.col("present") & F.col("_gone").isNull()).drop("_gone")


def register_versions(versions: DataFrame, links: DataFrame, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, links) after documents arrive with content: one version for equal content.

    ``arrived``: document_id, sha256, bytes. A version is new only where its content is.
    """
    made = arrived.groupBy("sha256").agg(F.min("bytes").alias("bytes")).select(F.substring("sha256", 1, 24).alias("version_id"), "sha256", "bytes", F.lit("registered").alias("state"))
    out = merge(versions, made, ["version_id"], {c: keep_old for c in versions.columns})
    pairs = arrived.select("document_id", F.substring("sha256", 1, 24).alias("version_id"))
    return out, links.select("document_id", "version_id").unionByName(pairs).distinct()


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """Insert runs that are not there; the first start of an id wins."""
    first = started.withColumn("_k", F.row_number().over(Window.partitionBy("run_id").orderBy("started_at", "kind"))).where("_k = 1").drop("_k")
    return merge(runs, first, ["run_id"], {c: keep_old for c in runs.columns})


def finish_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """Set state and end of known runs; ends of unknown ones are dropped."""
    j = runs.join(ends.select("run_id", F.col("state").alias("_state"), F.col("ended_at").alias("_at")), "run_id", "left")
    return j.withColumn("state", F.coalesce("_state", "state")).withColumn("ended_at", F.coalesce("_at", "ended_at")).select(runs.columns)


def unknown_runs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that name no known run."""
    return rows.join(runs.select("run_id"), "run_id", "left_anti")


def record_events(events: DataFrame, arrived: DataFrame, runs: DataFrame) -> DataFrame:
    """Append events of known runs, each (run, seq) once, with the run's tenant.

    What is recorded wins over a replay; of new ones with one number the earliest wins.
    """
    known = arrived.join(runs.select("run_id", "tenant_id"), "run_id").select(events.columns)
    first = Window.partitionBy("run_id", "seq").orderBy("at", "stage")
    fresh = known.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return events.unionByName(fresh.join(events.select("run_id", "seq"), ["run_id", "seq"], "left_anti"))


def record_artifacts(artifacts: DataFrame, written: DataFrame) -> DataFrame:
    """Upsert artifacts by run and name; the last one written (by ``seq``) stays."""
    rest = [F.desc(c) for c in sorted(set(written.columns) - {"run_id", "name", "seq"})]  # ties in seq
    last = written.withColumn("_k", F.row_number().over(Window.partitionBy("run_id", "name").orderBy(F.desc("seq"), *rest))).where("_k = 1").drop("_k")
    return merge(artifacts, last, ["run_id", "name"], {})


def latest_run_with_artifact(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """version_id, name, run_id: the newest run of each version that wrote each artifact."""
    j = artifacts.select("run_id", "name").distinct().join(runs.select("run_id", "version_id", "started_at"), "run_id")
    return j.groupBy("version_id", "name").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def acknowledge(warnings: DataFrame, seen: DataFrame) -> DataFrame:
    """Warnings with those of ``seen`` (warning_id) no longer open."""
    j = warnings.join(seen.select("warning_id", F.lit(True).alias("_seen")).distinct(), "warning_id", "left")
    return j.withColumn("open", F.col("open") & F.col("_seen").isNull()).drop("_seen")


def set_titles(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """Set titles; a generated one never replaces what a person wrote (``generated`` false)."""
    return merge(conversations, titles, ["conv_id"], {"started_at": keep_old}, lambda o, n: o["generated"] | ~n["generated"])


def open_turns(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Append a question to each conversation as its next turn, open until settled."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    fresh = questions.join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + 1).alias("turn"), "question", F.lit("open").alias("state"), F.lit(None).cast("string").alias("answer"))
    return turns.unionByName(fresh.select(turns.columns))


def settle_turns(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Give open turns their state and answer; settled ones stay as they are."""
    j = turns.join(answers.select("conv_id", "turn", F.col("state").alias("_s"), F.col("answer").alias("_a")), ["conv_id", "turn"], "left")
    opened = (F.col("state") == "open") & F.col("_s").isNotNull()
    return j.withColumns({"answer": F.when(opened, F.col("_a")).otherwise(F.col("answer")), "state": F.when(opened, F.col("_s")).otherwise(F.col("state"))}).select(turns.columns)


def publish(deltas: DataFrame, rows: DataFrame) -> DataFrame:
    """Append deltas of a turn; a (conversation, turn, chunk) is published once."""
    return deltas.unionByName(rows.select(deltas.columns).join(deltas, ["conv_id", "turn", "chunk_seq"], "left_anti").dropDuplicates(["conv_id", "turn", "chunk_seq"]))


def relay(deltas: DataFrame, turns: DataFrame, since: int) -> DataFrame:
    """Deltas after a position, with whether their turn has settled (the reader may stop then)."""
    ended = turns.select("conv_id", "turn", (F.col("state") != "open").alias("ends"))
    return deltas.where(F.col("chunk_seq") > since).join(ended, ["conv_id", "turn"])


def clear_deltas(deltas: DataFrame, turns: DataFrame) -> DataFrame:
    """Deltas without those of settled turns."""
    return deltas.join(turns.where("state <> 'open'").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


def remove_versions(documents: DataFrame, links: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, versions) without the versions of ``gone``; pointers to them are cleared first."""
    named = gone.select("version_id").distinct()
    cleared = documents.join(named.select(F.col("version_id").alias("active_version"), F.lit(True).alias("_gone")), "active_version", "left")
    cleared = cleared.withColumn("active_version", F.when(F.col("_gone").isNull(), F.col("active_version"))).select(documents.columns)
    return cleared, links.join(named, "version_id", "left_anti").select(links.columns), versions.join(named, "version_id", "left_anti").select(versions.columns)


def remove_documents(documents: DataFrame, links: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, versions) without the documents of ``gone`` and the versions that only they held."""
    named = gone.select("document_id").distinct()
    left = links.join(named, "document_id", "left_anti").select(links.columns)
    orphaned = links.join(named, "document_id", "left_semi").select("version_id").distinct().join(left, "version_id", "left_anti")
    return documents.join(named, "document_id", "left_anti").select(documents.columns), left, versions.join(orphaned, "version_id", "left_anti").select(versions.columns)
