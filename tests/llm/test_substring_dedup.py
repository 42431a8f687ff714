import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import substring_dedup as S


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(1, 3))
def test_two_stage_order(data, letters):
    data = bytes(b % letters for b in data)
    order = S.suffix_order(np.frombuffer(data, np.uint8), 32)
    key = lambda i: data[i : i + 32].ljust(32, b"\0")
    assert sorted(order.tolist()) == list(range(len(data)))
    assert [key(i) for i in order] == sorted(key(i) for i in range(len(data)))


def brute(docs, size):
    seen = collections.Counter()
    for _, x in docs:
        b = (x or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for i, x in docs:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def run(df, size):
    out = S.remove_repeats(df, min_bytes=size).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    return {r[0]: tuple(r[1:]) for r in out.collect()}


def sample(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(600)) for _ in range(5)]
    docs = []
    for i in range(60):
        x = ""
        for _ in range(rnd.randint(0, 4)):
            b, a = rnd.choice(base), rnd.randrange(300)
            x += b[a : a + rnd.randint(50, 300)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 30)))
        docs.append((i, x))
    return [*docs, (100, None), (101, ""), (102, "q" * 3000), (103, docs[3][1]), (104, "ab" * 400), (105, "\0" * 500)]


@pytest.mark.parametrize(("size", "seed"), [(100, 1), (200, 2)])
def test_equals_brute_force(spark, size, seed):
    docs = sample(seed)
    assert run(spark.createDataFrame(docs, "doc_id long, text string"), size) == brute(docs, size)


def test_groups_are_sorted_exactly():
    rnd = random.Random(3)
    common = "".join(rnd.choice("abcdefghij ") for _ in range(300))
    text = lambda n: "".join(rnd.choice("klmnopqrst ") for _ in range(n))
    pieces = []
    for i in range(80):
        d = (text(5) + common + text(240)).encode()
        pieces.append((i, 0, 40, 7, True, d[:400]))
    groups = collections.defaultdict(list)
    for key, _, _, h, single, d in pieces:
        for g, begin, offset, part in S.cut_pieces(d, 0, 201, 100, h, 200, S.SPAN):
            groups[g].append((key, begin, offset, h, single, part))
    got = collections.defaultdict(set)
    for g in groups.values():
        if len(g) > 1:
            for key, a, b in S._sorted_hits(g, 200):
                got[key].update(range(a, b))
    want = brute([(p[0], p[5].decode()) for p in pieces], 200)
    assert {k: len(v) for k, v in got.items()} == {k: w[1] for k, w in want.items() if w[1]}


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string, key string"
    assert run(spark.createDataFrame([], schema), 200) == {}
    long = "".join(random.Random(5).choices("abcdefghij", k=1_300_000))
    rows = [(1, "z" * 10 + long, "k"), (2, "short", None), (2, "short", None), (3, long[500_000:500_300], "k")]
    out = {r.doc_id: r.n_removed for r in S.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: 300, 2: 0, 3: 300}


def test_no_task_gathers_a_heavy_group(spark, monkeypatch):
    # Every document holds one passage between texts of its own, so edge pieces share a group.
    rnd = random.Random(12)
    common = "".join(rnd.choice("abcdefghij ") for _ in range(300))
    docs = [(i, "".join(rnd.choices("klmnop", k=rnd.randint(210, 260))) + common[: rnd.randint(240, 300)] + "".join(rnd.choices("qrstuv", k=230))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 200)
    assert run(frame, 200) == want
    labels = []
    sort_rows, limit = S._sort_rows, 5000

    def spied(size):
        def rows(batches):
            groups = collections.Counter()
            for batch in batches:
                for g, piece in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist(), strict=True):
                    groups[g] += len(piece)
                assert max(groups.values(), default=0) <= limit
                yield batch

        return lambda batches: sort_rows(size)(rows(batches))

    monkeypatch.setattr(S, "GROUP_BYTES", limit)
    monkeypatch.setattr(S, "_sort_rows", spied)
    counted = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, label: labels.append(label) or counted(df, label))
    assert run(frame, 200) == want
    assert "windows" in labels


def test_query_equals_brute_force(spark, tmp_path):
    docs = sample(7)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(docs, 200)
    out = S.remove_repeats(spark.createDataFrame([(1, "x", 2)], "runs long, text string, kept long"), id_col="runs").collect()
    assert [(r.runs, r.n_bytes) for r in out] == [(1, 1)]


def test_runs_of_repeated_rows_are_one_set(spark):
    rows = [(None, "abc def ghi " * 40)] * 500 + [(1, "abc def ghi " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(df).collect()
    assert len(got) == 501 and all(r.n_removed == r.n_bytes == 480 for r in got)
    runs = S._repeated_runs(df.select(S.row_key("doc_id", "text").alias("key"), "text"), 200).collect()
    assert len(runs) == 2 and max(len(r.runs) for r in runs) <= 480
