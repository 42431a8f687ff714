import zlib

import duckdb
import numpy as np
import pytest

from quillspan.llm import queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    assert isinstance(queries.ORACLES[name], str)
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = duck.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_toxicity_query_keeps_its_contract(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = queries.QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
        # Noisy-or by its definition: one less the chance that no sentence is toxic.
        _, z = model.sentences(docs[r.doc_id] or "")
        assert abs(r.score - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-9
