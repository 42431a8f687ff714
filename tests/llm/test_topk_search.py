import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import topk_search as K


def brute(rows, k, query):
    ints = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q in {i for i, _ in ints if query(i)}:
        asked = {v for i, v in ints if i == q}
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for v in asked for c, w in ints if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.0, 0.25, 0.5003]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0, 0, 0, 0]), (302, [math.nan] * 6), (303, [math.inf, 0.0]), (None, [1.0] * 6), (304, []), (305, [0.5]), (5, [9.0] * 6)]
    df = spark.createDataFrame([(a, [float(x) if x is not None else None for x in b] if b is not None else None, "c") for a, b in rows], "vec_id long, embedding array<float>, score string")
    for blocks in ({}, {"query_block": 3, "candidate_block": 17}):
        got = K.exact_topk(df, F.col("vec_id") % 10 == 0, 5, **blocks).collect()
        floats = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in df.collect()]
        assert sorted(map(tuple, got)) == brute(floats, 5, lambda i: i % 10 == 0)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.exact_topk(df, F.lit(True), 5).orderBy("query_id").collect()] == [(0, 1, 1, 131072), (1, 1, 0, 131072)]
    assert K.exact_topk(df.where("false"), F.lit(True), 5).count() == 0
    long = spark.createDataFrame([(0, [1.0] * 50_000), (1, [0.5] * 50_000)], "vec_id long, embedding array<float>")
    assert K.exact_topk(long, F.col("vec_id") == 0, 5).first().score == 50_000 * 256 * 128


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [3.0])] + [(2, [0.5])] * 40 + [(0, [1.0])] * 3 + [(0, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, K.exact_topk(df, F.col("vec_id") % 2 == 0, 5, query_block=2, candidate_block=4).collect()))
    assert got == brute(rows, 5, lambda i: i % 2 == 0)
    assert got[0] == (0, 1, 1, 196608) and got[1] == (0, 2, 1, 131072)


def test_scores_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="64 bits"):
        K.exact_topk(df, F.lit(True))
    near = spark.createDataFrame([(0, [11863283.0]), (1, [11863282.0])], "vec_id long, embedding array<double>")
    assert K.exact_topk(near, F.lit(True)).first().score == 11863283 * 11863282 * 65536
