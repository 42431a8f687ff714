"""Document toxicity by multiple-instance learning over sentences."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import labelled_sample, scratch

#: Hash buckets of the word features; a power of two.
BUCKETS = 1 << 18
#: Lengths of the word beginnings and endings that are features beside the whole word.
AFFIXES = (3, 4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
STRIP = "\"'()[]{}<>,;:*#$%&-_/\\|«»„“”’‘…"
#: Words whose features or scores a worker remembers before it starts anew.
CACHE_ENTRIES = 100_000


def word_features(token: str) -> list[int]:
    """Buckets of a lower-case token: itself, its beginnings and its endings."""
    word = token.strip(STRIP)
    if not word:
        return []
    out = [zlib.crc32(b"w" + word.encode())]
    for n in AFFIXES:
        if len(word) >= n:
            out.append(zlib.crc32(b"p" + word[:n].encode()))
            out.append(zlib.crc32(b"s" + word[-n:].encode()))
    return [x & (BUCKETS - 1) for x in out]


class NoisyOr:
    """Sentence scorer whose noisy-or over a document's sentences is the document's score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "words": {}}

    def word(self, token: str) -> float:
        found = self.words.get(token)
        if found is None:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            found = self.words[token] = float(sum(self.weights[f] for f in word_features(token)))
        return found

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans (in characters) and logits of a text's sentences."""
        spans, logits, word = [], [], self.word
        for m in SENTENCE.finditer(text):
            spans.append(m.span())
            logits.append(sum(map(word, m[0].lower().split())))
        return spans, np.array(logits, np.float64) + self.bias

    @staticmethod
    def combine(logits: np.ndarray) -> float:
        """Probability that at least one sentence is toxic."""
        return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, *, rounds: int = 150, min_docs: int = 3, l1: float = 7e-5, rate: float = 0.1) -> NoisyOr:
    """Penalised likelihood of the document labels under noisy-or, by full-batch Adam.

    Word features are evidence for toxicity only: weights stay at or above zero, so that one
    offending word is not outweighed by the rest of a long sentence. Features seen in fewer than ``min_docs`` documents stay at zero. Without documents of
    both labels the model is constant.
    """
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        return NoisyOr(np.zeros(BUCKETS, np.float32), 20.0 if share == 1.0 else -20.0)
    vocabulary: dict[str, int] = {}
    ids, starts, owner = [], [], []
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            words = m[0].lower().split()
            if words:
                starts.append(len(ids))
                owner.append(d)
                ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
    ids, starts, owner = np.array(ids, np.int64), np.array(starts, np.int64), np.array(owner, np.int64)
    width = 1 + 2 * len(AFFIXES)
    table = np.full((len(vocabulary), width), BUCKETS, np.int64)
    for w, i in vocabulary.items():
        found = word_features(w)
        table[i, : len(found)] = found
    sizes = np.diff(np.append(starts, len(ids)))
    doc_of_word = np.repeat(owner, sizes)
    pairs = np.unique(doc_of_word * len(vocabulary) + ids)
    seen = np.zeros(BUCKETS + 1, np.int64)
    for d in np.split(pairs % len(vocabulary), np.flatnonzero(np.diff(pairs // len(vocabulary))) + 1):
        seen[np.unique(table[d])] += 1
    live = (seen >= min_docs).astype(np.float64)
    live[BUCKETS] = 0.0
    w = np.zeros(BUCKETS + 1)
    bias = float(np.log(share / max(1.0, len(starts) / len(texts))))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    norm = weights / weights.sum()
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[table].sum(1)[ids], starts) + bias
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), len(texts)))
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-12), 1.0) * norm
        gz = pull[owner] * p
        gw = np.bincount(ids, np.repeat(gz, sizes), len(vocabulary))
        g = np.bincount(table.ravel(), np.repeat(gw, width), BUCKETS + 1) * live + l1
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = np.maximum(w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6), 0.0) * live
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return NoisyOr(w[:BUCKETS].astype(np.float32), bias)


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """:func:`labelled_sample` of the rows whose crc32(doc_id) mod 5 is not 0."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return labelled_sample(docs, labels, "toxic", learn, per_label=per_label, max_bytes=max_bytes)


def train(docs: DataFrame, labels: DataFrame, *, per_label: int = 2000, max_bytes: int = 48 << 20) -> NoisyOr:
    """Fit on labelled documents whose crc32(doc_id) mod 5 is not 0.

    At most ``per_label`` documents of each label are used, those first by a hash of the id,
    whole texts only, up to ``max_bytes`` in all (texts over a 64th of that are passed over);
    they are weighted to the label's share among all labelled documents. Null ids, null texts
    and labels but 0 and 1 take no part; of several labels of one id the largest counts, of
    several texts of one id the one of smallest hash; with no document, or documents of one
    label only, the model is constant.
    """
    with scratch(docs.sparkSession):
        rows, counts = training_rows(docs, labels, per_label, max_bytes)
        got = sorted(rows.collect(), key=lambda r: (r["turn"], r["doc_id"]))
    y = np.array([int(r["toxic"]) for r in got], np.int64)
    per = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return fit([r["text"] for r in got], y, np.where(y == 1, per[1], per[0]).astype(float))


def score(docs: DataFrame, model: NoisyOr, *, text_col: str = "text", spans: bool = False) -> DataFrame:
    """Append ``score`` (and with ``spans``, ``offending``) to the rows' columns.

    ``offending`` lists (begin, end, score) of sentences of 0.5 or more, in characters. Null
    and empty texts, having no sentence, score as the noisy-or over none: 0. Texts of any
    length are read whole; repeated rows are scored alike; an empty table gives an empty
    result; other columns are kept, but ``score`` and ``offending``, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 1 MB table
    rows = docs.select(*[c for c in docs.columns if c.lower() not in ("score", "offending")])
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    # Only the text goes to Python, and only numbers come back.
    @F.arrow_udf("struct<score:double,offending:array<struct<begin:int,end:int,score:double>>>" if spans else "double")
    def judge(texts: pa.Array) -> pa.Array:
        m, totals, found = shared.value, [], []
        for value in texts:
            at, z = m.sentences(value.as_py() or "")
            totals.append(m.combine(z))
            if spans:
                p = np.exp(-np.logaddexp(0, -z))
                found.append([{"begin": a, "end": b, "score": float(s)} for (a, b), s in zip(at, p, strict=True) if s >= 0.5])
        scores = pa.array(totals, pa.float64())
        return pa.StructArray.from_arrays([scores, pa.array(found, kind[1].type)], fields=list(kind)) if spans else scores

    out = rows.withColumn("score", judge(F.col(text_col)))
    return out.select(*rows.columns, "score.score", "score.offending") if spans else out


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score(docs, train(docs, labels)).withColumn("held_out", held)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
