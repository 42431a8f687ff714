"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, as in tests, may it be absent; a temporary folder is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of this session that still exist, and those made in each open scratch scope.
_MADE: set[str] = set()
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Shuffle files of the written plan are of no use afterwards; Spark may drop them at once.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path
    _MADE.add(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _MADE.discard(name)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that no later plan reads."""
    _delete(df.sparkSession, df._quillspan_path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables that are materialized inside, at its end, but those given to what is yielded."""
    made: list[str] = []
    _SCOPES.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df._quillspan_path)
        return df

    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for name in made:
            if name in _MADE:
                _delete(spark, name)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that :func:`materialize` has left; call it once results are written."""
    for name in list(_MADE):
        _delete(spark, name)


def row_key(*columns: Column | str) -> Column:
    """16 bytes that name the columns' values, nulls told from empty: two hashes of 64 bits."""
    marked = [part for c in (F.col(c) if isinstance(c, str) else c for c in columns) for part in (c.isNull(), c)]
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), *marked)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


#: Bits of the sketch that tells keys; it has a 64th as many rows at most, of two numbers.
SKETCH_BITS = 1 << 23


def marked(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with a boolean ``_likely``: true if ``columns`` stand in ``keys``, else false but for a share by chance.

    Each key sets one bit of a sketch of fixed size, which is broadcast; so rows that a join
    with ``keys`` would not match need mostly not be dealt, however many keys there are.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(SKETCH_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    sketch = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"))
    sketch = sketch.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(sketch), word == F.col("_word"), "left")  # at most SKETCH_BITS / 64 rows
    return met.withColumn("_likely", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))).drop("_word", "_bits")


def matching(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``columns`` stand in ``keys``: a semi-join that deals few others."""
    return marked(rows, keys, *columns).where("_likely").drop("_likely").join(keys, list(columns), "left_semi")


def lacking(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``columns`` do not stand in ``keys``: an anti-join that deals few of them."""
    both = marked(rows, keys, *columns)
    apart, near = (both.where(c).drop("_likely") for c in ("not _likely", "_likely"))
    return apart.unionByName(near.join(keys, list(columns), "left_anti"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, per_label: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded, deterministic sample of documents labelled 0 or 1, and the full counts by label.

    ``docs``: doc_id, text; ``labels``: doc_id and ``label``; ``learn`` tells of a doc_id
    whether it may be used. At most ``per_label`` ids of each label, one text an id (that of
    smallest hash; of several labels the largest), whole texts of up to a 64th of
    ``max_bytes``, and ``max_bytes`` in all, taken in the order of the id's CRC-32 until the
    sum is reached. All bounds are applied in Spark, before anything comes to the driver.
    Returns doc_id, label, turn (the CRC-32) and text; call it inside :func:`scratch`.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias(label)).where(learn)
    counts = {int(r[0]): r["n"] for r in marked.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for y in (0, 1):  # a top-n per label is a bounded merge in Spark
        part = marked.where(F.col(label) == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    size = F.octet_length("text")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (size <= max_bytes // 64))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows of two numbers
    rows = materialize(rows.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    # One window over at most 2 * per_label rows of numbers.
    so_far = F.sum("size").over(Window.orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.select("doc_id", size.alias("size"), F.crc32(F.col("doc_id").cast("string")).alias("turn")).withColumn("so_far", so_far)
    taken = taken.where(F.col("so_far") <= max_bytes).select("doc_id", "turn")
    return rows.join(F.broadcast(taken), "doc_id").select("doc_id", label, "turn", "text"), counts


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected graph.

    ``edges``: long columns ``a`` and ``b``; returns ``node``, ``component`` for nodes of
    ``edges`` only. Alternates large-star and small-star steps (each a groupBy-min and an
    equi-join, so no adjacency list is gathered in one place) until no edge changes; every
    round's edges are written to the shared folder, so that lost executors cost one round.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(both, "cc")
    if state.isEmpty():
        return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    signature = None
    for _ in range(max_rounds):
        sym = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        discard(state)
        state = new
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
