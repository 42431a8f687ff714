"""Document quality by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import labelled_sample, scratch

#: Hash buckets of words and word shapes (a power of two), bins of a statistic, and latent factors.
BUCKETS, BINS, RANK = 1 << 16, 12, 8
#: Tokens whose buckets a worker remembers before it starts anew, and the longest it remembers.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 64
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
#: Class of a byte: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 mark, 7 first of several, 8 further.
CLASSES = np.zeros(256, np.uint8)
for _class, _bytes in ((6, range(33, 127)), (1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (9, 32)), (5, (10, 13)), (7, range(192, 256)), (8, range(128, 192))):
    CLASSES[list(_bytes)] = _class
STATISTICS = 13


def token_buckets(token: str) -> tuple[int, int]:
    """Buckets of a token's lower-case word and of its shape."""
    word = "".join(LETTERS.findall(token.lower()))[:40]
    shape = LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", DIGITS.sub("9", token))[:40]
    return zlib.crc32(b"w" + word.encode()) % BUCKETS, zlib.crc32(b"s" + shape.encode()) % BUCKETS


def statistics(text: str, counts: Counter) -> list[float]:
    """Structure of a text, and its sizes as the document's metadata; counts are of its tokens."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = np.bincount(CLASSES[raw], minlength=9).astype(float)
    chars = max(1.0, len(raw) - kind[8])
    letters = max(1.0, kind[1] + kind[2] + kind[7])
    tokens = sum(counts.values())
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(len(raw))), kind[2] / letters, kind[3] / chars, kind[6] / chars, (kind[4] + kind[5]) / chars, kind[7] / chars,
        kind[0] / chars, chars / max(1, tokens), max(map(len, counts), default=0), len(counts) / max(1, tokens), max(counts.values(), default=0) / max(1, tokens),
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(chars / max(1, len(lines)))),
    ]


class Featurizer:
    """Sparse features of a text: L2-normed token buckets, then one bin of each statistic."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges
        self.known: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return {"edges": self.edges, "known": {}}

    def buckets(self, token: str) -> tuple[int, int]:
        found = self.known.get(token)
        if found is None:
            found = token_buckets(token)
            if len(token) <= CACHE_CHARS:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[token] = found
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(text.split())
        at = np.array([b for t in counts for b in self.buckets(t)], np.int64)
        size = np.repeat(np.array(list(counts.values()), float), 2)
        norm = np.sqrt((size**2).sum()) or 1.0
        stats = statistics(text, counts)
        bins = [BUCKETS + i * BINS + int(np.searchsorted(self.edges[i], x, side="right")) for i, x in enumerate(stats)]
        return np.concatenate([at, bins]).astype(np.int64), np.concatenate([size / norm, np.full(len(bins), len(bins) ** -0.5)])


class Machine:
    """Score = sigmoid(bias + sum w x + 1/2 (|sum v x|^2 - sum |v|^2 x^2))."""

    def __init__(self, features: Featurizer, bias: float, w: np.ndarray, v: np.ndarray):
        self.features, self.bias, self.w, self.v = features, bias, w, v
        self.squares = (v.astype(float) ** 2).sum(1)

    def logit(self, text: str) -> float:
        at, x = self.features(text)
        together = x @ self.v[at]
        return float(self.bias + self.w[at] @ x + 0.5 * (together @ together - self.squares[at] @ (x * x)))

    def score(self, text: str) -> float:
        return float(np.exp(-np.logaddexp(0, -self.logit(text))))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, *, rounds: int = 60, min_docs: int = 3, rate: float = 0.1, l2: float = 5e-5, seed: int = 5) -> Machine:
    """Penalised logistic likelihood by full-batch Adam.

    Statistics are cut into bins at quantiles of the sample. Buckets met in fewer than
    ``min_docs`` documents stay at zero. Without documents of both labels the model is
    constant: the share of label 1, or one half where there is none at all.
    """
    size = BUCKETS + STATISTICS * BINS
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        constant = Featurizer(np.zeros((STATISTICS, BINS - 1)))
        return Machine(constant, {0.0: -6.0, 1.0: 6.0}.get(share, 0.0), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    found = np.array([statistics(t, Counter(t.split())) for t in texts])
    features = Featurizer(np.quantile(found, np.arange(1, BINS) / BINS, axis=0).T.copy())
    rows = [features(t) for t in texts]
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows]).astype(np.float32)
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    pairs = np.unique(doc * size + at)
    live = np.bincount(pairs % size, minlength=size) >= min_docs
    # Only live features are trained; they are numbered anew.
    names = np.flatnonzero(live)
    keep = live[at]
    at, x, doc = np.searchsorted(names, at[keep]), x[keep], doc[keep]
    starts = np.searchsorted(doc, np.arange(len(rows)))  # every row keeps its statistics' bins or has none alive
    filled = np.diff(np.append(starts, len(doc))) > 0
    by_feature = np.argsort(at, kind="stable")
    firsts = np.searchsorted(at[by_feature], np.arange(len(names)))
    add = lambda rowwise: np.where(filled.reshape(-1, *[1] * (rowwise.ndim - 1)), np.add.reduceat(rowwise, np.minimum(starts, len(doc) - 1), axis=0), 0.0)
    rng = np.random.default_rng(seed)
    params = [np.zeros(len(names)), rng.normal(0, 0.02, (len(names), RANK)), np.array(np.log(share / (1 - share)))]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    norm, x1, square = weights / weights.sum(), x[:, None], (x * x)[:, None]
    for t in range(1, rounds + 1):
        w, v, bias = params
        gathered = v.astype(np.float32)[at]
        together = add(gathered * x1).astype(np.float32)
        z = bias + add(w[at] * x) + 0.5 * ((together**2).sum(1) - add((gathered**2).sum(1) * x * x))
        pull = (1 / (1 + np.exp(-z)) - labels) * norm
        by_entry = pull.astype(np.float32)[doc]
        gw = np.add.reduceat((by_entry * x)[by_feature], firsts) + l2 * w
        gv = np.add.reduceat((by_entry[:, None] * (x1 * together[doc] - square * gathered))[by_feature], firsts, axis=0) + l2 * v
        for i, g in enumerate((gw, gv, np.array(pull.sum()))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    w, v = np.zeros(size, np.float32), np.zeros((size, RANK), np.float32)
    w[names], v[names] = params[0], params[1]
    return Machine(features, float(params[2]), w, v)


def train(docs: DataFrame, labels: DataFrame, *, per_label: int = 1500, max_bytes: int = 24 << 20) -> Machine:
    """Fit on labelled documents whose crc32(doc_id) mod 4 is not 2.

    The sample is bounded by ``per_label`` ids of each label and ``max_bytes`` of texts
    (:func:`labelled_sample`) and weighted to the labels' shares among all that may be used.
    """
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    with scratch(docs.sparkSession):
        rows, counts = labelled_sample(docs, labels, "quality", learn, per_label=per_label, max_bytes=max_bytes)
        got = sorted(rows.collect(), key=lambda r: (r["turn"], r["doc_id"]))
    y = np.array([int(r["quality"]) for r in got], np.int64)
    per = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return fit([r["text"] for r in got], y, np.where(y == 1, per[1], per[0]).astype(float))


def score(docs: DataFrame, model: Machine, *, text_col: str = "text") -> DataFrame:
    """Append ``score``, the likelihood of label 1, to the rows' columns.

    Null and empty texts have no tokens and are scored by their statistics alone; texts of any
    length are read whole; repeated rows are scored alike; an empty table gives an empty
    result; other columns are kept, a column ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one weight and RANK factors a bucket

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = shared.value
        for texts in batches:
            yield pa.array([machine.score(value.as_py() or "") for value in texts], pa.float64())

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"], judge(F.col(text_col)).alias("score"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = score(docs, train(docs, labels)).withColumn("held_out", held)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
