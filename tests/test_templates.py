import pytest
from pyspark.sql import functions as F

from quillspan.functions import policy as P
from quillspan.operators import evaluation as E
from quillspan.plans import templates as T


@pytest.fixture(scope="module")
def entities(spark):
    both = lambda df: df.withColumn("tenant_id", F.lit("t1")).unionByName(df.withColumn("tenant_id", F.lit("t2")))
    make = lambda rows, schema: both(spark.createDataFrame(rows, schema))
    return {
        "versions": make([("A", "L", "Uno", True), ("B", "L", "Dos", True), ("C", "M", "Tres", True), ("D", "L", "Viejo", False)], "version_id string, library_id string, title string, active boolean"),
        "sections": make([("A", "1.10"), ("A", "1.2"), ("B", "1")], "version_id string, path string"),
        "chunks": make([("a0", "A", "s", 0), ("a1", "A", "s", 1), ("a2", "A", "s", 2), ("b0", "B", "s2", 0)], "chunk_id string, version_id string, section_id string, ordinal int"),
        "concepts": make([("c1", "fe"), ("c2", "obra")], "concept_id string, key string"),
        "mentions": make([("A", "c1", "a0", 0.9), ("A", "c1", "a1", 0.7), ("A", "c2", "a1", 0.5), ("B", "c1", "b0", 0.9), ("C", "c1", "z", 0.9)], "version_id string, concept_id string, chunk_id string, confidence double"),
        "claims": make([("k1", "a0", "c1"), ("k2", "zz", "c1"), ("k3", "a1", None)], "claim_id string, chunk_id string, about string"),
    }


def rows(entities, name, *cols, **args):
    return [tuple(r[c] for c in cols) for r in T.run(name, entities, tenant_id="t1", **args).collect()]


def test_results_stay_in_their_tenant(entities):
    assert rows(entities, "document_outline", "path", version_id="A") == [("1.10",), ("1.2",)]
    assert rows(entities, "section_chunks", "chunk_id", section_id="s") == [("a0",), ("a1",), ("a2",)]
    assert rows(entities, "chunk_neighbours", "chunk_id", chunk_id="a0") == [("a0",), ("a1",)]
    assert rows(entities, "concepts_in_version", "concept_id", "mentions", version_id="A") == [("c1", 2)]
    assert rows(entities, "chunks_for_concepts", "chunk_id", concept_ids=["c1", "c2"], library_id="L") == [("a0",), ("b0",), ("a1",)]
    assert rows(entities, "concept_by_name", "concept_id", canonical_names=["fe"]) == [("c1",)]
    assert rows(entities, "related_documents", "other_id", "shared", version_id="A") == [("B", 1)]
    assert rows(entities, "claims_about_concept", "claim_id", concept_id="c1") == [("k1",)]
    assert rows(entities, "claims_for_chunks", "claim_id", "key", chunk_ids=["a0", "a1"]) == [("k1", "fe"), ("k3", None)]
    assert rows(entities, "chunk_texts", "chunk_id", version_id="A", chunk_ids=["a2", "b0"]) == [("a2",)]
    assert rows(entities, "library_documents", "title", library_id="L") == [("Dos",), ("Uno",)]
    assert len(rows(entities, "version_mention_pairs", "chunk_id", version_id="A", mention_limit=2)) == 2


def test_registry_refuses(entities):
    with pytest.raises(ValueError):
        T.register(T.Template("x", {"a": "id"}, None, ("a",)))
    with pytest.raises(ValueError):
        T.run("document_outline", entities, tenant_id="t1")
    with pytest.raises(ValueError):
        T.bind(T.TEMPLATES["document_outline"], {"tenant_id": "t", "version_id": "v", "drop": 1})
    assert T.bind(T.TEMPLATES["document_outline"], {"tenant_id": "t", "version_id": "v", "limit": 10**6})["limit"] == 200
    assert "version_mention_pairs" not in {c["name"] for c in T.catalogue()}


def test_policy(spark):
    df = spark.createDataFrame([("brief", 500), ("odd", None), ("thorough", 0)], "e string, k int")
    got = df.select(P.budget(F.col("e"), "candidates"), P.clamp_top_k(F.col("k"), P.budget(F.col("e"), "top_k"))).collect()
    assert [tuple(r) for r in got] == [(20, 96), (40, 8), (120, 1)]
    one = spark.range(1).select(P.transcription_usd(F.lit(3.0), F.lit(0.6)), P.transcription_usd(F.lit(3.0), F.lit(None).cast("double")), P.projected_characters(F.lit(10.0), True), P.answer_state(F.lit(2), F.lit(True), F.lit(0))).first()
    assert (round(one[0], 6), one[1], one[2], one[3]) == (0.15, None, 203, "no_verified_citation")


def test_evaluation(spark):
    chunks = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("kind"))
    s = E.stratified(chunks, "id", "kind", 40)
    assert s.count() == 40 and s.groupBy("kind").count().where("count < 13").count() == 0
    m = spark.createDataFrame([("mrr", 0.5), ("r1", 0.4), ("r5", 0.9)], "metric string, value double")
    r = spark.createDataFrame([("mrr", 0.45), ("r1", 0.6)], "metric string, value double")
    assert {x.metric: x.verdict for x in E.compare_scores(m, r, 0.1).collect()} == {"mrr": "same", "r1": "worse", "r5": "unrecorded"}
    assert E.tuning_grid(m, [{"k": 5}, {"k": 8}]).count() == 6
