import pytest

from quillspan.operators import lexical_index as L
from quillspan.operators import retrieval as R

DOCS = [("x", 1, "alpha beta beta gamma"), ("x", 2, "beta delta"), ("y", 3, None), ("y", 4, ""), ("y", 5, "alpha juan 10:6 delta"), ("x", 6, "gamma " * 50)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "scope string, id long, text string")


def state(index):
    terms = index.postings().where("bucket >= 0").select("scope", "id", "term", "tf", "dl").collect()
    return sorted(map(tuple, terms)), sorted(map(tuple, index.documents().collect())), sorted(map(tuple, index.frequencies().collect())), sorted(map(tuple, index.totals().collect()))


def test_deltas_and_compaction_equal_a_rebuild(spark, tmp_path):
    at = lambda n: f"{tmp_path}/{n}"
    index = L.build(frame(spark, DOCS[:3]), at("a"), buckets=4)
    L.delta(index, frame(spark, DOCS[3:]))
    L.delta(index, frame(spark, [("x", 1, "beta epsilon"), ("z", 7, "omega")]), spark.createDataFrame([(1,), (2,), (2,), (99,)], "id long"))
    L.delta(index, None, spark.createDataFrame([(7,)], "id int"))
    L.delta(index, frame(spark, [("z", 7, "omega alpha")]))
    now = [("x", 1, "beta epsilon"), DOCS[2], DOCS[3], DOCS[4], DOCS[5], ("z", 7, "omega alpha")]
    want = state(L.build(frame(spark, now), at("b"), buckets=8))
    assert state(index) == want and state(L.compact(index, at("c"))) == want


def test_a_broken_delta_is_not_read(spark, tmp_path, monkeypatch):
    index = L.build(frame(spark, DOCS), f"{tmp_path}/a", buckets=4)
    before = state(index)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(L.LexicalIndex, "totals", stop)
        m.setattr(L.LexicalIndex, "documents", stop)
        with pytest.raises(RuntimeError):
            L.delta(index, frame(spark, [("x", 9, "new words")]), spark.createDataFrame([(1,)], "id long"))
    assert state(index) == before
    L.delta(index, frame(spark, [("x", 9, "other words")]))
    assert state(index) == state(L.build(frame(spark, [*DOCS, ("x", 9, "other words")]), f"{tmp_path}/b", buckets=4))


@pytest.mark.parametrize("limit", [0, 1000])
def test_search_equals_the_direct_score(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(L, "BROADCAST_TERMS", limit)
    docs, asked = frame(spark, DOCS), spark.createDataFrame([(1, "beta alpha beta"), (2, "juan 10:6"), (3, ""), (4, "unknown")], "q long, text string")
    index = L.build(docs, f"{tmp_path}/a", buckets=4)
    plain = lambda df: sorted((a, b, round(c, 9)) for a, b, c in df.collect())
    direct = R.bm25(asked, docs, query_id="q", query_text="text", doc_id="id", doc_text="text")
    assert plain(L.search(index, asked, query_id="q", query_text="text")) == plain(direct)
    scoped = R.bm25(asked, docs.where("scope = 'x'"), query_id="q", query_text="text", doc_id="id", doc_text="text")
    assert plain(L.search(index, asked, query_id="q", query_text="text", scope="x")) == plain(scoped)
    assert L.search(index, asked.where("q > 2"), query_id="q", query_text="text").count() == 0


def test_only_asked_buckets_are_read(spark, tmp_path):
    index = L.build(frame(spark, DOCS), f"{tmp_path}/a", buckets=16)
    one = max(r.bucket for r in index.postings().select("bucket").distinct().collect())
    some = index.postings([one])
    assert {r.bucket for r in some.select("bucket").distinct().collect()} == {one}
    filters = [x for x in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:] if "bucket" in x.split("]")[0]]
    assert filters


def test_empty_table(spark, tmp_path):
    index = L.build(frame(spark, []), f"{tmp_path}/a")
    assert state(index) == ([], [], [], []) and L.search(index, spark.createDataFrame([(1, "a b c")], "q long, text string"), query_id="q", query_text="text").count() == 0
