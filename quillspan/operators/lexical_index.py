"""A stored inverted index: postings by bucket of the term, kept up by signed deltas.

A folder of Parquet tables, each in one part a segment: ``postings`` (scope, id, term, tf, dl,
by bucket of the term), ``documents`` (scope, id, dl), ``removed`` (id), and the statistics
``frequencies`` (scope, term, df) and ``totals`` (scope, n, terms). The first segment is the
build. A delta writes one more: postings of what was added, ids of what went, and by how much
the statistics change, so that no stored document is tokenised again. ``segments`` is written
last and names what counts; a broken delta leaves nothing that is read, and is written over
by the next. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import tokenize
from quillspan.operators.retrieval import B, K1
from quillspan.sources import store

#: Buckets of terms, and files that a segment's bucket is spread over at least, so that no frequent term fills one task.
BUCKETS, SPREAD = 32, 2
#: Bytes of text, or as many terms at eight bytes each, whose postings of one bucket go to one task and file.
FILE_BYTES = 8_000_000
#: Raised whenever what is stored changes, so that an index of an older form is not taken up.
FORMAT = 2
DOCUMENT, TOTALS = "scope string, id long, dl int", "scope string, n long, measured long, terms long"
POSTING, FREQUENCY = "scope string, id long, term string, tf int, dl int", "scope string, term string, df long"


@dataclass(frozen=True)
class LexicalIndex:
    """An index at ``path``; every read takes the segments that are complete at that time."""

    spark: SparkSession
    path: str

    def segments(self) -> dict[int, int]:
        """Segment number -> buckets; one row a delta."""
        if not store.exists(self.spark, f"{self.path}/segments/segment=0"):
            return {}
        rows = self.spark.read.schema("segment int, buckets int").parquet(f"{self.path}/segments").collect()
        return {r["segment"]: r["buckets"] for r in rows}

    def table(self, name: str, schema: str) -> DataFrame:
        """A table's rows of all complete segments, removed ones included."""
        held = list(self.segments())
        return self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.path}/{name}").where(F.col("segment").isin(held))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows whose document no later segment removed."""
        gone = self.table("removed", "id long").groupBy("id").agg(F.max("segment").alias("until")).withColumnRenamed("id", "gone")
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("until")), "left_anti")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """Live postings; with ``buckets`` only their folders are read."""
        rows = self.table("postings", f"{POSTING}, bucket int")
        return self._live(rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("segment")

    def documents(self) -> DataFrame:
        """Live documents with their lengths in terms."""
        return self._live(self.table("documents", DOCUMENT)).drop("segment")

    def frequencies(self) -> DataFrame:
        """scope, term, df: summed over the deltas."""
        return self.table("frequencies", FREQUENCY).groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df <> 0")

    def totals(self) -> DataFrame:
        """scope, n, measured, terms: documents, those with a text, and their length, summed over the deltas."""
        return _summed(self.table("totals", TOTALS)).where("n <> 0")


def _summed(totals: DataFrame) -> DataFrame:
    return totals.groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("n", "measured", "terms")])


def _measures(documents: DataFrame, sign: int = 1) -> DataFrame:
    """Totals of documents, or with -1 what their removal takes away."""
    sums = F.count("*"), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))
    return documents.groupBy("scope").agg(*[(x * sign).alias(c) for x, c in zip(sums, ("n", "measured", "terms"), strict=True)])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _dealt(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Postings dealt by bucket and document; the more there are of them, the more tasks share a bucket."""
    spread = max(SPREAD, -(-size // (buckets * FILE_BYTES)))
    return rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(spread)))


def counted_terms(terms: Column) -> Column:
    """(term, tf) of an array of terms, counted in the row; the first, of a null term, stands for the document itself."""
    bind = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda j: (j <= 1) | (F.get(s, j) != F.get(s, j - 1)))
        pairs = lambda at: F.transform(at, lambda j, k: F.struct(F.get(s, j).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - j).alias("tf")))
        return bind(starts, pairs)

    return bind(F.concat(F.array(F.lit(None).cast("string")), F.array_sort(F.coalesce(terms, F.array().cast("array<string>")))), runs)


def _put(index: LexicalIndex, segment: int, buckets: int, docs: DataFrame | None, removed: DataFrame) -> LexicalIndex:
    """Write one segment: ``docs`` (scope, id, text) in, ``removed`` (id) out."""
    spark, at = index.spark, lambda name: f"{index.path}/{name}/segment={segment}"
    removed.write.mode("overwrite").parquet(at("removed"))
    gone = spark.read.schema("id long").parquet(at("removed"))
    before = index.segments()
    if docs is None:
        docs = spark.createDataFrame([], "scope string, id long, text string")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    repeats = not docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tokens = docs.select("scope", "id", tokenize(F.col("text")).alias("t"))
    # One pass over the texts gives both tables, as a null term stands for the document itself.
    each = tokens.select("scope", "id", F.when(F.col("t").isNotNull(), F.size("t")).alias("dl"), F.inline(counted_terms(F.col("t"))))
    bucket = F.when(F.col("term").isNull(), -1).otherwise(_bucket(buckets))
    rows = _dealt(each.withColumn("bucket", bucket), size, buckets)
    if repeats:
        rows = rows.groupBy("bucket", "scope", "id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
        rows = _dealt(rows.select("scope", "id", "dl", "term", "tf", "bucket"), size, buckets)
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    # What stands in the folder of bucket -1 are the documents, rows that repeat one as its count.
    put = spark.read.schema(f"{POSTING}, bucket int").parquet(at("postings"))
    found = put.where("bucket = -1").withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("tf"))))
    found.select("scope", "id", "dl").write.mode("overwrite").parquet(at("documents"))
    docs_in = spark.read.schema(DOCUMENT).parquet(at("documents"))
    df = put.where("bucket >= 0").groupBy("scope", "term").agg(F.count("*").alias("df"))
    totals = _measures(docs_in)
    if before:
        lost = index.postings().where("bucket >= 0").join(gone, "id", "left_semi").groupBy("scope", "term").agg((-F.count("*")).alias("df"))
        df = df.unionByName(lost).groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = _summed(totals.unionByName(_measures(index.documents().join(gone, "id", "left_semi"), -1)))
    df.write.mode("overwrite").parquet(at("frequencies"))
    totals.write.mode("overwrite").parquet(at("totals"))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(at("segments"))
    return index


def build(docs: DataFrame, path: str, *, buckets: int = BUCKETS) -> LexicalIndex:
    """A new index of ``docs`` (scope, id, text) at ``path``, in place of any that stands there.

    ``id`` names a document; rows that repeat one are one document each for the statistics, so
    give distinct ids. Null texts count as documents but not towards the mean length.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], "buckets int, segment int").write.mode("overwrite").partitionBy("segment").parquet(f"{path}/segments")
    return _put(LexicalIndex(spark, path), 0, buckets, docs, spark.createDataFrame([], "id long"))


def delta(index: LexicalIndex, added: DataFrame | None = None, removed: DataFrame | None = None) -> LexicalIndex:
    """Add documents (scope, id, text), and remove those of the ids in ``removed``; an id in both is replaced.

    Costs a pass over ``added``, and for the statistics one over the stored postings' ids where
    something is removed.
    """
    held = index.segments()
    ids = removed.select(F.col("id").cast("long")).distinct() if removed is not None else index.spark.createDataFrame([], "id long")
    return _put(index, max(held) + 1, held[0], added, ids)


def compact(index: LexicalIndex, path: str) -> LexicalIndex:
    """The live rows of all segments as the one segment of a new index; nothing is tokenised again."""
    spark, buckets = index.spark, index.segments()[0]
    spark.createDataFrame([], "buckets int, segment int").write.mode("overwrite").partitionBy("segment").parquet(f"{path}/segments")
    at = lambda name: f"{path}/{name}/segment=0"
    size = 8 * (index.totals().agg(F.sum("terms")).first()[0] or 0)
    live = _dealt(index.postings(), size, buckets).sortWithinPartitions("bucket", "term")
    live.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    index.documents().write.mode("overwrite").parquet(at("documents"))
    index.frequencies().write.mode("overwrite").parquet(at("frequencies"))
    index.totals().write.mode("overwrite").parquet(at("totals"))
    spark.createDataFrame([], "id long").write.mode("overwrite").parquet(at("removed"))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(at("segments"))
    return LexicalIndex(spark, path)


def weights(index: LexicalIndex, postings: DataFrame, *, by_scope: bool = False) -> DataFrame:
    """scope, id, term, weight: the BM25 document side, mean length over all or over each scope."""
    totals = index.totals()
    if by_scope:
        mean = totals.select(F.col("scope").alias("_s"), (F.col("terms") / F.col("measured")).alias("avgdl"))
        j = postings.join(mean, F.col("scope").eqNullSafe(F.col("_s")))
    else:
        j = postings.join(F.broadcast(totals.agg((F.sum("terms") / F.sum("measured")).alias("avgdl"))))  # one row
    norm = 1 - B + B * F.col("dl") / F.col("avgdl")
    return j.select("scope", "id", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("weight"))


#: Distinct query terms up to which they are broadcast, and pairs of a query and a document that one task adds up.
BROADCAST_TERMS = 200_000
TASK_PAIRS = 1_000_000


def search(index: LexicalIndex, queries: DataFrame, *, query_id: str, query_text: str, scope: str | None = None) -> DataFrame:
    """query_id, id, score of every document that shares a term with a query.

    Each distinct query term counts once, by its inverse document frequency in the collection,
    or in ``scope`` alone. Only the asked terms' buckets are read; their postings meet the
    queries' terms by equality, broadcast up to BROADCAST_TERMS of them. Then the postings are
    dealt by document first, so that pairs of a query and a document are made and added up in
    one place, at most about TASK_PAIRS in each task.
    """
    mine = (lambda df: df.where(F.col("scope") == scope)) if scope is not None else (lambda df: df)
    buckets = next(iter(index.segments().values()))
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term"))
    terms = asked.groupBy("term").agg(F.count("*").alias("_asked")).select("term", _bucket(buckets).alias("bucket"))
    few, wanted = terms.agg(F.count("*"), F.collect_set("bucket")).first()  # at most one number a bucket
    if not few:
        return queries.where("false").select(query_id, F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"))
    hint = F.broadcast if few <= BROADCAST_TERMS else (lambda df: df)
    n = mine(index.totals()).agg(F.sum("n").alias("n"))
    df = mine(index.frequencies()).groupBy("term").agg(F.sum("df").alias("df"))
    idf = df.join(hint(terms.select("term")), "term", "left_semi").join(F.broadcast(n))  # n is one row
    idf = idf.select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    found = mine(index.postings(sorted(wanted))).join(hint(terms.select("term")), "term", "left_semi")
    side = weights(index, found, by_scope=scope is not None)
    if few <= BROADCAST_TERMS:
        asking, documents = queries.count(), mine(index.totals()).agg(F.sum("n")).first()[0] or 0
        side = side.select("id", "term", "weight").repartition(max(1, -(-asking * documents // TASK_PAIRS)), "id")
    hits = side.join(hint(asked.join(hint(idf), "term")), "term")
    return hits.groupBy("q", "id").agg(F.sum(F.col("idf") * F.col("weight")).alias("score")).select(F.col("q").alias(query_id), "id", "score")
