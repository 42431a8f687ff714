"""A training-data pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from quillspan.llm.common import discard, lacking, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows, does not reject.

    Null and empty texts score 0 and stay, as do rows without id; rows that repeat a text
    share its fate. Without labels of both kinds nothing can be learned and all rows stay.
    Texts of any length are read whole, an empty table gives none, other columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    kinds = {r[0] for r in labels.where("toxic in (0, 1)").select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return docs
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    clashing = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("score", "offending")}
    scored = toxicity.score(docs.withColumnsRenamed(clashing), model).where("score < 0.5")
    return scored.select(*[F.col(clashing.get(c, c)).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that the corpus has had before; n_chars follows.

    Null texts stay null, documents whose lines all go stay with an empty text. The first
    line of a class is the one of the smallest id (rows without id come before all), then of
    the first place; rows that repeat id and text keep the same lines. Texts of any length are
    read whole, an empty table gives none, other columns stay.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", row.alias("row")), max_edits=2)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of five-word-shingle similarity 0.8 or more.

    Texts without words, null ones too, are one group: an empty document of a corpus is kept
    once. Rows that repeat an id stand or fall together. Rows without id are judged by their
    text: they go where a row with an id is of their group, otherwise one of equal text stays.
    Texts of any length are compared whole, an empty table gives none, other columns stay.
    """
    key = "_near_key"
    # Above all ids in use, so that a row with an id is kept before one without.
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    kept = simhash.near_duplicates_removed(docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), nameless)), id_col=key)
    return kept.where("doc_id is not null").unionByName(kept.where("doc_id is null").dropDuplicates([key])).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Rows are judged by their text, so that rows that repeat a text go together, with an id or
    without one; null and empty texts hold no passage and stay. Texts of any length are
    searched whole, an empty table gives none, other columns stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    key = "_digest"
    named = docs.withColumn(key, F.sha2("text", 256))
    hits = decontaminate.contaminated(named.select(key, "text"), items, id_col=key).select(key).distinct()
    # Written, so that its size is known when the join is planned.
    return lacking(named, materialize(hits, "contaminated"), key).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gave the text back.

    The columns of the document but its text, then n_tokens, ids and lossless. Null and empty
    texts have no tokens; rows that repeat a text are encoded each for itself.
    """
    out = bpe.encode_texts(docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    taken = {"n_tokens", "ids", "lossless"}
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != "text" and c.lower() not in taken]
    return out.select(*rest, "n_tokens", "ids", same.alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
