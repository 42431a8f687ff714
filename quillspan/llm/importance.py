"""Importance resampling towards a target corpus, by word tries and hashed feature buckets."""

from __future__ import annotations

import math
import re
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize, scratch

#: A word, in UTF-8 with A-Z lower-cased: ASCII letters and digits, and all that is not ASCII.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text whose words are held at once, and nodes that a trie may have before it starts anew.
STRETCH, NODES = 1 << 20, 1 << 20


def words(text: bytes):
    """Lists of the words of a text, in order; long texts are cut between words."""
    text, at = text.lower(), 0  # bytes: A-Z only
    while at < len(text):
        cut = GAP.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = cut.start() if cut else len(text)
        yield WORD.findall(text, at, end)
        at = end


class Trie:
    """Paths of ``low`` to ``high`` words. A node holds [value, CRC state, children].

    The CRC state is that of the path's words joined by one space, so that a child's state
    follows from its parent's and the child's own bytes. ``value`` is a count of features, or
    the gain of the node's bucket where ``gains`` are given.
    """

    def __init__(self, low: int, high: int, buckets: int, gains: list[int] | None = None):
        self.low, self.high, self.buckets, self.gains = low, high, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.root, self.size = [0, 0, {}], 0

    def _grow(self, parent: list, word: bytes) -> list:
        state = zlib.crc32(word if parent is self.root else b" " + word, parent[1])
        node = parent[2][word] = [0 if self.gains is None else self.gains[state % self.buckets], state, {}]
        self.size += 1
        return node

    def walk(self, text: bytes):
        """For every word, the nodes of the runs of 1, 2, ... up to ``high`` words that end there."""
        root, longer = self.root, []
        for stretch in words(text):
            for word in stretch:
                found = [(node[2].get(word) or self._grow(node, word)) for node in (root, *longer)]
                yield found
                longer = found[: self.high - 1]

    def add(self, text: bytes) -> None:
        """Count the features of a text."""
        first = self.low - 1
        for found in self.walk(text):
            for node in found[first:]:
                node[0] += 1

    def score(self, text: bytes) -> tuple[int, int, int]:
        """Words, features and the sum of the features' gains."""
        n = features = total = 0
        first = self.low - 1
        for found in self.walk(text):
            n += 1
            for node in found[first:]:
                features += 1
                total += node[0]
        return n, features, total

    def totals(self) -> dict[int, int]:
        """Counts by bucket."""
        out: dict[int, int] = {}
        level = [(1, node) for node in self.root[2].values()]
        while level:
            depth, (count, state, children) = level.pop()
            if depth >= self.low and count:
                out[state % self.buckets] = out.get(state % self.buckets, 0) + count
            level += [(depth + 1, child) for child in children.values()]
        return out


def bucket_counts(docs: DataFrame, *, text_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts by the CRC-32 of their bytes modulo ``buckets``.

    Each partition grows one trie and sends its totals, at most ``buckets`` rows, whenever the
    trie is full and at its end; sums are merged by bucket. Buckets without features are absent.
    """

    def count(batches):
        trie = Trie(low, high, buckets)

        def sent():
            totals = trie.totals()
            trie.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(totals.keys(), pa.int32()), "n": pa.array(totals.values(), pa.int64())})

        for batch in batches:
            for value in batch.column(0):
                trie.add(value.as_py() or b"")
                if trie.size >= NODES:
                    yield sent()
        yield sent()

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, **features) -> list[int]:
    """Gain of every bucket: floor of 1000 times the log ratio of its smoothed shares.

    Only the bucket table, ``buckets`` rows of two numbers, comes to the driver.
    """
    both = bucket_counts(docs, buckets=buckets, **features).withColumn("side", F.lit(0))
    both = both.unionByName(bucket_counts(target, buckets=buckets, **features).withColumn("side", F.lit(1)))
    counts = [[0] * buckets, [0] * buckets]
    for r in both.collect():
        counts[r["side"]][r["bucket"]] = r["n"]
    s_all, t_all = sum(counts[0]), sum(counts[1])
    return [math.floor(1000 * math.log((t + 1) * float(s_all + buckets) / ((s + 1) * float(t_all + buckets)))) for s, t in zip(*counts, strict=True)]


def weigh(docs: DataFrame, gains: list[int], *, text_col: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """Append n_words, n_features and weight, the floored mean of the features' gains (none: 0).

    Only the text goes to Python; columns of these names are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(low, high, len(shared.value), shared.value)
        kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
        for texts in batches:
            out = []
            for value in texts:
                n, features, total = trie.score(value.as_py() or b"")
                out.append({"n_words": n, "n_features": features, "weight": total // features if features else 0})
                if trie.size >= NODES:
                    trie.clear()
            yield pa.array(out, kind)

    taken = {"n_words", "n_features", "weight"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    judged = docs.select(*rest, judge(F.col(text_col).cast("binary")).alias("_judged"))
    return judged.select(*rest, "_judged.n_words", "_judged.n_features", "_judged.weight")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), where u comes from the first 32 bits of SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, *, id_col: str = "doc_id", percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Append score and rank (1, 2, 3, ...; null where not drawn) to rows with n_words and weight.

    Drawn are the floor(percent * N / 100) highest scores of the N rows of ``min_words`` words
    or more: weighted sampling without replacement by Gumbel noise that the id decides. Ties
    go to the smaller id, null ids last, then to any row. Ranks come from one range partitioning
    by score and each partition's count; a row number of its own keeps equal rows divisible.
    """
    spark = weighed.sparkSession
    own = {c: f"_own_{c}" for c in weighed.columns if c.lower() in ("score", "rank")}
    rows = weighed.withColumnsRenamed(own).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)).withColumn("_row", F.monotonically_increasing_id())
    eligible = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    order = [(~eligible).asc(), F.desc("score"), F.col(id_col).asc_nulls_last(), F.col("_row").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as keep:
        rows = materialize(rows, "weighed")
        # Within a partition these numbers follow the order; the upper bits are the partition's.
        placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        placed = keep(materialize(placed, "placed"))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if(eligible).alias("e")).collect()  # one row a partition
    before, so_far = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        before.append((r["part"], so_far))
        so_far += r["n"]
    drawn = percent * sum(r["e"] for r in counts) // 100
    starts = spark.createDataFrame(before, "part long, before long")
    at = F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(starts), "part")  # one row a partition
    kept = [F.col(own.get(c, c)).alias(c) for c in weighed.columns if c not in own]
    return out.select(*kept, "score", F.when(at <= drawn, at).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """The rows of ``docs`` drawn to look like ``target``, with all their columns, score and rank.

    Null and empty texts have no words and are not drawn; texts of any length are read whole;
    rows that repeat an id share their noise and, where texts are equal, their score, and each
    counts for itself; an empty ``docs`` gives an empty result and an empty ``target`` draws by
    the rarity of features alone. Columns named as the result's own are replaced.
    """
    features = {"text_col": text_col, "low": low, "high": high}
    gains = bucket_gains(docs, target, buckets=buckets, **features)
    return draw(weigh(docs, gains, **features), id_col=id_col, percent=percent, min_words=min_words, seed=seed).where("rank is not null")


def op11_importance_resample(spark, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document against all benchmark texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    weighed = weigh(docs, bucket_gains(docs, target)).drop("text")
    return draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")
